"""Lorespan: llm."""
