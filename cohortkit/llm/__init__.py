"""Training-data operators on Spark DataFrames.

Nothing else in the library imports this subpackage. Every operator takes the
columns it needs by name, ignores all others, and returns rows keyed by the
document (or page) id. Columns may hold nulls; each module states what a null,
an empty text or a repeated id gives.
"""
