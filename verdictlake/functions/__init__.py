"""Column expressions: text scalars, labels, scores, heuristic judges."""
