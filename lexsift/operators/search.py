"""Matching documents and lines, and the forms in which results come back."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_binary, lines
from ..plans.planner import folds
from ..plans.query import Mode, Query
from ..plans.regex import Assertion, can_be_empty, mandatory_literal, parse, to_java

WORD_START, WORD_END = r"(?<!\w)(?:", r")(?!\w)"


def _quote(literal: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in literal)


def matches(text: Column, query: Query) -> Column:
    """Whether a line of ``text`` matches; ``text`` may be one line or a whole document.

    A case-sensitive literal is a plain substring test. Otherwise a regular expression whose classes
    leave line breaks out, behind a substring test for the literal that every match must hold.
    """
    fold = folds(query)
    flags = "(?diuU)" if fold else "(?dU)"
    tests = []
    for pattern in query.patterns:
        if query.fixed and not query.word and not fold:
            tests.append(text.contains(pattern))
            continue
        tree = None if query.fixed else parse(pattern)
        java = _quote(pattern) if query.fixed else to_java(tree)
        test = text.rlike(flags + (WORD_START + java + WORD_END if query.word else java))
        literal = pattern if query.fixed else mandatory_literal(tree)
        tests.append(text.contains(literal) & test if literal and not fold else test)
    return reduce(or_, tests)


def by_line_only(query: Query) -> bool:
    """Whether a whole text can't be asked in place of its lines: matches may be empty or anchored to
    the text's ends."""
    trees = [] if query.fixed else [parse(p) for p in query.patterns]
    return any(can_be_empty(t) or r"\A" in to_java(t) or r"\z" in to_java(t) or isinstance(t, Assertion) for t in trees)


def search(docs: DataFrame, query: Query, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Results in the query's mode: (keep, line_no, line), (keep, n_lines), (keep), or one row (found).

    Counts are of lines, and documents without a match have no row. Documents with a NUL are binary
    and give no lines, counts or names.
    """
    whole = docs.filter(~is_binary(F.col(text)))
    fast = not by_line_only(query)
    if fast:  # a document's text is asked before its lines are made
        whole = whole.filter(matches(F.col(text), query))
    if query.mode in (Mode.FILES, Mode.QUIET) and fast:
        found = whole.select(*keep)
    else:
        found = lines(whole, text, keep).filter(matches(F.col("line"), query))
    if query.mode is Mode.LINES:
        return found.select(*keep, "line_no", "line")
    if query.mode is Mode.COUNT:
        return found.groupBy(*keep).agg(F.count("*").alias("n_lines"))
    if query.mode is Mode.FILES:
        return found.select(*keep).distinct() if not fast else found
    return found.limit(1).agg((F.count("*") > 0).alias("found"))  # the first match is enough


def standard_output(found: DataFrame, path: Column, numbered: bool = False) -> DataFrame:
    """``path:line`` or ``path:number:line``."""
    parts = [path, F.col("line_no").cast("string"), F.col("line")] if numbered else [path, F.col("line")]
    return found.select(F.concat_ws(":", *parts).alias("output"))
