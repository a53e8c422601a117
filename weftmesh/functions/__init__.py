"""Geometry as column expressions."""
