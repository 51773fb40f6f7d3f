"""Column functions: text, geometry, hashing."""
