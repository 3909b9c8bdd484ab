"""Operators for large training corpora, their registered queries and SQL twins."""
