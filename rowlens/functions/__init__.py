"""Column-level building blocks: names, text, vectors."""
