"""Column expressions: labels, scores, text. All of them stay inside Spark's own functions."""
