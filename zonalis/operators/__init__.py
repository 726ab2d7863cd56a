"""Spatial operators on pixel and feature tables."""
