"""Terrain and watershed analytics on Spark."""
