"""Errors that requests report."""


class QueryParseError(ValueError):
    """The query, or a layer it names, is invalid: status `failed`."""


class InvalidGeometryError(ValueError):
    """A geometry that is no Polygon or MultiPolygon with rings."""
