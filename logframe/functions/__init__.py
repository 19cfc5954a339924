"""Column functions over lines."""
