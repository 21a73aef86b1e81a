"""Document analytics on Spark: sources, text functions, operators, plans and streaming."""

__version__ = "0.1.0"
