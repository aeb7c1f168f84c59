"""Operators over road networks."""
