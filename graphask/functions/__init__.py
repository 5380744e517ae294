"""Column expressions: text handling and answer formatting."""
