"""Whole analyses put together from operators, and the queries over the driver's tables."""
