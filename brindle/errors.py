"""Errors by category, for statements that the engine refuses."""

from __future__ import annotations


class EngineError(Exception):
    """Any refusal of a statement."""


class SyntaxRefused(EngineError):
    """The text is not one statement."""


class TypeRefused(EngineError):
    """Types do not fit, or a literal is out of range."""


class SymbolNotFound(EngineError):
    """A table, column or parameter does not exist."""


class AlreadyExists(EngineError):
    """A table or index of that name exists."""


class UniqueViolation(EngineError):
    """A primary key would occur twice."""


class NotNullViolation(EngineError):
    """A column declared NOT NULL would get a null."""


class ValueRefused(EngineError):
    """A value cannot be evaluated or converted."""


class Restricted(EngineError):
    """The operation is known and not allowed."""


class Unsupported(EngineError):
    """The feature does not exist."""
