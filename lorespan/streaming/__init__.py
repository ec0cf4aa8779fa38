"""Lorespan: streaming."""
