"""Errors, each with an optional hint on what to do."""

from __future__ import annotations


class LoomError(Exception):
    def __init__(self, message: str, hint: str | None = None) -> None:
        super().__init__(message)
        self.hint = hint

    def __str__(self) -> str:
        return f"{self.args[0]} ({self.hint})" if self.hint else str(self.args[0])


class ConfigError(LoomError, ValueError):
    """A configuration that can't be used."""


class InputError(LoomError):
    """An input that isn't there."""


class UnsupportedFormat(LoomError):
    """No parser for a suffix or name."""


class ParseError(LoomError):
    """A file whose content can't be parsed."""


class MissingDependency(LoomError):
    """An optional package that isn't installed."""


class ExportError(LoomError):
    """A sink that can't be written."""


class EmbeddingError(LoomError):
    """An embedding provider that failed."""
