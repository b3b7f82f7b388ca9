"""Errors that a caller can tell apart."""


class EngineError(Exception):
    """Anything the engine refuses."""


class QueryError(EngineError):
    """A query that names no column, names one ambiguously, or asks for what a plan can't hold."""


class SchemaError(EngineError):
    """Values or types that don't fit a schema."""


class CatalogError(EngineError):
    """A table that is missing, or one that is there already."""
