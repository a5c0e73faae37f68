"""Column functions and small models."""
