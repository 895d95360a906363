"""Whole computations put together from operators."""
