"""Errors of archives and queries."""


class ArchiveError(Exception):
    """Any error of this package."""


class NotFound(ArchiveError, KeyError):
    """No schema, column or binary of that name."""


class Collision(ArchiveError):
    """The name is taken by something else."""


class TypeMismatch(ArchiveError, TypeError):
    """An operand's or a requested type is not the column's."""


class CrossSource(ArchiveError):
    """Predicates of different sources were combined."""


class Corrupt(ArchiveError):
    """A manifest is damaged or of another version."""


class IndexOverflow(ArchiveError, OverflowError):
    """An index does not fit the requested width."""
