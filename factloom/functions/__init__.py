"""Scalar functions, as expressions on columns."""
