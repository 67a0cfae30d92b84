"""Alphabets, Column expressions and alignment kernels."""
