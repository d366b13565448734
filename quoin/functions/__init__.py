"""Column functions: no Python runs in them."""
