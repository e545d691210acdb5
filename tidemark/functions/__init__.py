"""Column expressions: text, time, vectors, scores and conditions."""
