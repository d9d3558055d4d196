"""Runs the engine on the driver's tables, with an independent SQL statement per query."""
