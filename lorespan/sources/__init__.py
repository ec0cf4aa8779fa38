"""Lorespan: sources."""
