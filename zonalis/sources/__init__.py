"""Pixel and feature sources, result sinks and the result cache."""
