"""End-to-end jobs composed from the operators, and the projections of the given tables."""
