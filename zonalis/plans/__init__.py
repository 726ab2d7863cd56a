"""Raster SQL: parsing, catalogue and planning."""
