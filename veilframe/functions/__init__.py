"""Masking and text functions as Column expressions."""
