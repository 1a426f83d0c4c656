"""Column functions over source text, names and model answers."""
