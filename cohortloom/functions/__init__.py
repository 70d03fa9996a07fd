"""Column expressions: deterministic draws, vectors, strict parsing."""
