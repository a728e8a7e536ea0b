"""Column functions for text and vectors."""
