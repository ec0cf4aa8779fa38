"""Lorespan: functions."""
