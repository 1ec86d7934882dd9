"""Column helpers and ordering primitives shared by the operators."""
