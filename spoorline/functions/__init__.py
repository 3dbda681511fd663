"""Scalar text and score functions, as column expressions."""
