"""Scalar functions on trees (as parent arrays), polynomials and texts."""
