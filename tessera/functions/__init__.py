"""Scalar and array expressions, keyed draws and array kernels."""
