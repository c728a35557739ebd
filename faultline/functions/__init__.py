"""Numeric kernels and statistical tails."""
