"""Operators of a training-data pipeline: tokens, near-duplicates, cleaning, packing, output.

Nothing else in the library imports this package. Every operator reads only the columns
its docstring names, so further columns, whatever they are called, never matter. Rows are
never collected, capped or sampled; groups of copies are reduced to one representative
before any work that grows with a group.
"""
