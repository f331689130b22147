"""Operators over whole frames: grouped aggregation and joins."""
