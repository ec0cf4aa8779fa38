"""Lorespan: plans."""
