"""Column functions on JSON records."""
