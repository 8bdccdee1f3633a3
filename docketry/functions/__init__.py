"""Column functions: Catalyst expressions without Python in the hot path."""
