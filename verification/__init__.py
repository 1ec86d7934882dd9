"""Registered queries over the given tables and the ANSI SQL each is checked against."""
