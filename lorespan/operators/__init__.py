"""Lorespan: operators."""
