"""Operators that need more than expressions."""
