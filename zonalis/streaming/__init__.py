"""Structured Streaming forms of zonal statistics."""
