"""Relational operators of similarity search: scoring, ranking, alignment, metrics, splits."""
