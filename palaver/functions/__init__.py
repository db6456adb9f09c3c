"""Column expressions: text, episode names, times, vectors."""
