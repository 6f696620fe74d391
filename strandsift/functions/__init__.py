"""Scalar functions over sequences and vectors."""
