"""Errors of the engine: a code for programs, a message for people."""

from __future__ import annotations

from dataclasses import dataclass


class SpecError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Finding:
    """One result of a check. ``level``: reject, warn or info."""

    code: str
    level: str
    message: str


def raise_if_rejected(findings: list[Finding]) -> list[Finding]:
    """Raise for the first rejection; return the rest."""
    for f in findings:
        if f.level == "reject":
            raise SpecError(f.code, f.message)
    return findings
