"""Ignore rules and glob overrides, compiled to regular expressions over relative paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: ``base`` is the folder it stands in ('' for the top)."""

    pattern: str
    negated: bool
    number: int
    regex: str


def _glob(glob: str) -> str:
    """The inside of a regular expression for a glob; ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(_glob, glob[i + 1 : end].split(","))) + ")", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + _plain(glob[i + 1]), i + 2
        else:
            out, i = out + _plain(glob[i]), i + 1
    return out


def _plain(c: str) -> str:
    return c if c.isalnum() or c in "_/-" else "\\" + c if c.isascii() else c


def glob_regex(glob: str, base: str = "") -> str:
    """A glob without a slash matches in any folder below ``base``, one with a slash from there."""
    prefix = "".join(map(_plain, base.rstrip("/") + "/")) if base else ""
    anchored = "/" in glob.rstrip("/")
    inner = _glob(glob.strip("/"))
    return f"^{prefix}{'' if anchored else '(?:.*/)?'}{inner}(?:/.*)?$" if not glob.endswith("/") else f"^{prefix}{'' if anchored else '(?:.*/)?'}{inner}/.*$"


def parse_ignore(text: str, base: str = "", first: int = 0) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\!", "\\#") else line
        rules.append(Rule(pattern, negated, first + len(rules), glob_regex(pattern, base)))
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """The last rule that matches decides; deeper ignore files come later in ``rules``."""
    out = F.lit(False)
    for rule in sorted(rules, key=lambda r: r.number):
        out = F.when(path.rlike(rule.regex), F.lit(not rule.negated)).otherwise(out)
    return out


#: Rules that are sent to all tasks at most.
MOST_RULES = 10_000


def by_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with rules as rows (rule_no, regex, negated), for rules that only a table has; the
    path column is ``path``. Paths come back with ``ignored``. Every path is held against every rule,
    so the rules are sent to all tasks; more than MOST_RULES are an error."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hit = paths.join(F.broadcast(rules), F.expr("path rlike regex"), "left")
    last = hit.groupBy("path").agg(F.max_by("negated", "rule_no").alias("negated"))
    return last.select("path", F.coalesce(~F.col("negated"), F.lit(False)).alias("ignored"))


def included(path: Column, globs: list[str]) -> Column:
    """Overrides: ``!glob`` leaves out, others let in; the last that matches decides. Where only
    exclusions are given, the rest stays."""
    out = F.lit(not any(not g.startswith("!") for g in globs))
    for glob in globs:
        out = F.when(path.rlike(glob_regex(glob.removeprefix("!"))), F.lit(not glob.startswith("!"))).otherwise(out)
    return out
