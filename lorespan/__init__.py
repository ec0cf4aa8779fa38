"""Lorespan: analytics over linked document collections, as Spark jobs."""
