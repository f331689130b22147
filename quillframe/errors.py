"""Errors of the library: one base class, one subclass for each kind."""

from __future__ import annotations


class FrameError(Exception):
    """Base of all errors raised here."""


class MismatchedLengths(FrameError):
    def __init__(self, expected: int, found: int, name: str) -> None:
        self.expected, self.found, self.name = expected, found, name
        super().__init__(f"column '{name}' has {found} rows where {expected} are expected")


class DuplicateColumnName(FrameError):
    def __init__(self, name: str) -> None:
        self.name = name
        super().__init__(f"more than one column is named '{name}'")


class ColumnNotFound(FrameError):
    def __init__(self, name: str) -> None:
        self.name = name
        super().__init__(f"there is no column '{name}'")


class TypeError_(FrameError):
    """A value of a type that an operation has no meaning for."""


class TypeMismatch(FrameError):
    def __init__(self, name: str, expected, found) -> None:
        self.name, self.expected, self.found = name, expected, found
        super().__init__(f"column '{name}' is {found}, not {expected}")


class NoColumnsProvided(FrameError):
    pass


class CastError(FrameError):
    pass


class JoinKeyTypeError(FrameError):
    def __init__(self, side: str, name: str, expected, found) -> None:
        self.side, self.name, self.expected, self.found = side, name, expected, found
        super().__init__(f"the {side} join key '{name}' is {found}, not {expected}")


class IndexOutOfBounds(FrameError):
    def __init__(self, index: int, length: int) -> None:
        self.index, self.length = index, length
        super().__init__(f"index {index} is outside of {length} rows")


IndexOutOfRange = IndexOutOfBounds


class ComputeError(FrameError):
    """Arithmetic that has no result: integer overflow, or division of integers by zero."""


class UnsupportedOperation(FrameError):
    pass


class InvalidArgument(FrameError):
    pass


class InternalError(FrameError):
    pass


class CsvError(FrameError):
    pass


class IoError(FrameError):
    pass


class OtherError(FrameError):
    pass
