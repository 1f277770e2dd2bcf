"""One error hierarchy for every operator."""

from __future__ import annotations


class AnalysisError(ValueError):
    """Base of all errors raised on unsuitable input."""


class EmptyInputError(AnalysisError):
    """The input has no rows."""


class MissingColumnError(AnalysisError):
    """A required column is absent."""

    def __init__(self, missing, available):
        super().__init__(f"missing columns {sorted(missing)}; available: {sorted(available)}")
        self.missing = sorted(missing)


class InsufficientDataError(AnalysisError):
    """Too few rows, keys or days for the analysis."""

    def __init__(self, what: str, needed: int, got: int):
        super().__init__(f"{what}: need at least {needed}, got {got}")
        self.needed, self.got = needed, got


class InsufficientFeaturesError(InsufficientDataError):
    """Too few usable feature columns."""


class NoVarianceError(AnalysisError):
    """The target column is constant."""


class UnsupportedFormatError(AnalysisError):
    """No reader for this file suffix."""
