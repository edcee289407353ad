"""Errors that tell what failed, where, and what to try."""

from __future__ import annotations


class LayoutError(Exception):
    """Base: a message with context values and a suggestion."""

    def __init__(self, message: str, context: dict | None = None, suggestion: str | None = None) -> None:
        super().__init__(message)
        self.message, self.context, self.suggestion = message, dict(context or {}), suggestion

    def __str__(self) -> str:
        told = ", ".join(f"{k}={v}" for k, v in self.context.items())
        return self.message + (f" ({told})" if told else "") + (f". {self.suggestion}" if self.suggestion else "")


class SourceError(LayoutError):
    """An input is missing or can't be read."""


class ShapeError(LayoutError):
    """An input has none of the known shapes."""


class PatternError(LayoutError):
    """A pattern, its set or its name is not valid."""


class AnswerError(LayoutError):
    """A model's answer can't be parsed or lacks a field."""


class WorkflowError(LayoutError):
    """A workflow's graph or run is not valid."""


class ProviderError(LayoutError):
    """A model provider is not configured or failed."""
