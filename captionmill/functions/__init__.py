"""Column functions on text, time and similarity."""
