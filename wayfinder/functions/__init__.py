"""Scalar values and expressions."""
