"""Column functions on base strings."""
