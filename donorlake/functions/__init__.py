"""Scalar and column functions that other modules build on."""
