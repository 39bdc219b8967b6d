"""Errors of parsing, typing and evaluation, and the diagnostics that a run collects."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


class MorphError(Exception):
    """Base of all errors of the library."""


class ParseError(MorphError):
    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class UnknownVariable(MorphError):
    pass


class UnknownHelper(MorphError):
    pass


class UnknownOperation(MorphError):
    pass


class InvalidOperation(MorphError):
    pass


class TypeMismatch(MorphError):
    pass


class DivisionByZero(MorphError):
    pass


class UnknownFeature(MorphError):
    pass


class UnknownClass(MorphError):
    pass


class MissingModel(MorphError):
    pass


class MetamodelNotFound(MorphError):
    pass


class ReadOnlyModel(MorphError):
    pass


class UnsupportedFormat(MorphError):
    pass


class UnresolvedReference(MorphError):
    pass


@dataclass
class Diagnostics:
    """Errors, warnings and a timeline of (time, level, message); equal if errors and warnings are."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    timeline: list[tuple[float, str, str]] = field(default_factory=list, compare=False)

    def error(self, message: str) -> None:
        self.errors.append(message)
        self.timeline.append((time.time(), "error", message))

    def warning(self, message: str) -> None:
        self.warnings.append(message)
        self.timeline.append((time.time(), "warning", message))

    def event(self, message: str) -> None:
        self.timeline.append((time.time(), "event", message))

    def clear(self) -> None:
        for x in (self.errors, self.warnings, self.timeline):
            x.clear()

    def summary(self) -> str:
        return "\n".join(f"{len(x)} {name}" + "".join(f"\n  {m}" for m in x) for name, x in (("errors", self.errors), ("warnings", self.warnings)) if x)
