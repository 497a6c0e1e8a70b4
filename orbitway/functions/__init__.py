"""Scalar expressions that queries share, in a form that two SQL dialects read."""
