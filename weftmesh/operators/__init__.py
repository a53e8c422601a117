"""Mesh operators over darts, vertices and attribute tables."""
