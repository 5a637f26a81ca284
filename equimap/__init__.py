"""Spatial-equity and text analytics as DataFrame transformations."""
