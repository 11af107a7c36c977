"""Errors of the library."""


class VectorIndexError(Exception):
    """Base of all errors."""


class DimensionMismatch(VectorIndexError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"vectors have {expected} components, got {got}")
        self.expected, self.got = expected, got


class IdAlreadyExists(VectorIndexError):
    """An inserted id is stored, or was stored and deleted, or occurs twice."""


class IdNotFound(VectorIndexError):
    """An id to change or delete is not stored."""


class CorruptIndex(VectorIndexError):
    """Stored files are missing or of an unknown version."""


class ConstructionFailed(VectorIndexError):
    """Data or parameters from which no index can be built."""


class SearchFailed(VectorIndexError):
    """A query that cannot be answered."""


class IndexEmpty(VectorIndexError):
    """There are no vectors."""


class ReadOnly(VectorIndexError):
    """A change was asked of an index that was loaded for reading."""
