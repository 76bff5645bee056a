"""What is asked: patterns, how they match, and what comes back."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Case(Enum):
    SENSITIVE = "sensitive"
    INSENSITIVE = "insensitive"
    SMART = "smart"


class Mode(Enum):
    """What comes back: matching lines, counts per document, documents, or whether there are any."""

    LINES = "lines"
    COUNT = "count"
    FILES = "files"
    QUIET = "quiet"


@dataclass(frozen=True)
class Query:
    """Immutable; patterns are tried as alternatives."""

    patterns: tuple[str, ...]
    fixed: bool = False
    word: bool = False
    case: Case = Case.SENSITIVE
    mode: Mode = Mode.LINES
    indexed_only: bool = False
    globs: tuple[str, ...] = field(default=())
    hidden: bool = False

    def __post_init__(self):
        if not self.patterns:
            raise ValueError("a query needs a pattern")
        if self.fixed and any("\n" in p for p in self.patterns):
            raise ValueError("a pattern can't match a line break")


def last_mode(flags: list[str]) -> Mode:
    """Of ``-c`` and ``-l`` the last given counts; ``-q`` counts in any place."""
    if "-q" in flags:
        return Mode.QUIET
    chosen = [f for f in flags if f in ("-c", "-l")]
    return {"-c": Mode.COUNT, "-l": Mode.FILES}[chosen[-1]] if chosen else Mode.LINES


def last_case(flags: list[str], config: list[str] = ()) -> Case:
    """The last case flag counts; flags of the command, where there are any, replace the config's."""
    kinds = {"-i": Case.INSENSITIVE, "-S": Case.SMART, "-s": Case.SENSITIVE, "--ignore-case": Case.INSENSITIVE, "--smart-case": Case.SMART, "--case-sensitive": Case.SENSITIVE}
    for given in (flags, config):
        chosen = [kinds[f] for f in given if f in kinds]
        if chosen:
            return chosen[-1]
    return Case.SENSITIVE


def exit_status(matched: bool, failed: bool, quiet: bool = False) -> int:
    """0: a match, 1: none, 2: an error; a quiet match hides an error."""
    if failed and not (quiet and matched):
        return 2
    return 0 if matched else 1
