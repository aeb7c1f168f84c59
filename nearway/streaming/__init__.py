"""Streams against networks that stand still."""
