"""Scalar, boolean, aggregate, window, JSON and extension expressions."""
