"""Operators for preparing training text: filtering, near-duplicates, tokens, extraction, archives.

Nothing outside this package imports it. ``queries`` registers each operator on the driver's tables.
"""
