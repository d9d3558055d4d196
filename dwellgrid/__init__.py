"""Charging-demand analytics for truck fleets, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
