"""Raster SQL and zonal analytics as lazy Spark DataFrames."""
