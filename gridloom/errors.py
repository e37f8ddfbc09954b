"""What can go wrong with an array store."""


class GridError(Exception):
    """Base of all errors of this package."""


class ColumnRequestError(GridError):
    """A column that isn't there, or not of the type that was asked for."""


class TypeSupportError(GridError):
    """A data type that has no column type."""


class MetadataError(GridError):
    """Array metadata that don't make a table."""


class ComputeError(GridError):
    """Bytes that can't be decoded into the array that the metadata describe."""


class StorageError(GridError):
    """A location that can't be opened or read."""
