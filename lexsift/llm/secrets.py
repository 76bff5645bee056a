"""Operator 3: secret scans, in DataFrame functions only.

Three patterns give the base spans. The method adds long strings that look random: a window slides
over every candidate string, the counts of its characters are kept by adding the one that enters and
taking off the one that leaves, and the Shannon entropy that follows from the counts is held against
a limit for the string's character class. Strings on the allow list are left out.

All of it is one expression per row: no shuffle, no row identity, nothing leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

# The base patterns, with the group that is measured and its least length.
BASE = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A quick test that must hold wherever the pattern has a match that is long enough.
GUARD = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
#: Character classes of whole candidates, first match decides: name, pattern, bits a character.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.8),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9+/_=-]+$", 3.6),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9+/_=-]+$", 3.6),
)
#: Candidates that are left out though their entropy is high: UUIDs, marked examples, plain
#: alphabets, and paths or names made of words.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy",
    r"(?i)abcdefghijkl|0123456789",
    r"^(?:[A-Za-z]{2,}[/_=-]+|[0-9]{1,4}[/_=-]+)++(?:[A-Za-z]+|[0-9]{1,4})$",  # possessive: no stack for long ones
)

SPAN = "array<struct<start:int,end:int>>"
#: Characters of candidates; their counts in a window are packed by twelve, five bits each.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PACKED, WIDTH = 12, 5
#: Arrays are worked on in blocks: what is appended to stays short, so work is linear in their length.
MATCH_BLOCK, WINDOW_BLOCK = 128, 1024


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


def _blocks(values: Column, size: int) -> Column:
    """``values`` in slices of ``size``."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(size))
    return F.when(F.size(values) > 0, F.transform(starts, lambda i: F.slice(values, i, F.lit(size)))).otherwise(F.array())


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once: what stands in a lambda is computed at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, group: int, least: int, guard: str) -> Column:
    """(start, end, string) of a pattern's leftmost matches whose group is long enough.

    The pieces between matches and the matches themselves, by turns, make up the text; their lengths
    (in code points) give the positions: summed by block, then within each block.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    measured = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(
        F.arrays_zip(hits.alias("string"), measured.alias("measured"), gaps.alias("gap")),
        lambda x: F.struct(x["string"], (F.length(x["measured"]) >= least).alias("counts"), x["gap"], F.length(x["string"]).alias("hit")),
    )
    found = "array<struct<start:int,end:int,string:string>>"

    def add_block(acc, block):
        size = F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["hit"], F.lit(0)))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def add_match(acc, x):
        start = acc["at"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), (start + x["hit"]).alias("end"), x["string"].alias("string")))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["counts"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def place(blocks):
        zero = F.struct(F.lit(0).alias("at"), _none("array<int>").alias("starts"))
        starts = F.aggregate(blocks, zero, add_block, lambda acc: acc["starts"])
        within = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), _none(found).alias("spans")), add_match, lambda acc: acc["spans"])
        return F.flatten(F.zip_with(blocks, starts, within))

    # the piece behind the last match has no match
    placed = _with(F.filter(parts, lambda x: x["string"].isNotNull()), lambda x: _with(_blocks(x, MATCH_BLOCK), place))
    return F.when(text.rlike(guard), placed).otherwise(_none(found))


def _entropy_limit(candidate: Column) -> Column:
    limit = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        limit = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(limit)
    for pattern in ALLOW:
        limit = F.when(candidate.rlike(pattern), F.lit(None).cast("double")).otherwise(limit)
    return limit


def _random_runs(c: Column, window: int) -> Column:
    """Spans within a candidate (codes, limit) that windows of entropy ``limit`` or more cover, joined.

    A step takes in one character and lets one go: both counts change by one, and the sum of n log n
    over the counts by a difference that stands in a table. The window that a step has completed is
    judged by the next.
    """
    if not 2 <= window < 1 << WIDTH:
        raise ValueError("counts of the window must fit their bits")
    gains = F.array(*[F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(window)])
    codes, n = c["codes"], F.size(c["codes"])
    mask = F.lit((1 << WIDTH) - 1).cast("long")
    count = lambda counts, x: F.call_function("shiftright", F.get(counts, x["word"]), x["shift"]).bitwiseAND(mask).cast("int")

    def judged(acc):
        """The runs, with the window that ends before ``acc.at``."""
        start, run = acc["at"] - window, acc["run"]
        random = acc["full"] & (F.lit(math.log2(window)) - acc["total"] / window >= c["limit"] - 1e-9)
        begins = random & (run["end"] < start)
        return (
            F.struct(F.when(begins, start).otherwise(run["start"]).alias("start"), F.when(random, acc["at"]).otherwise(run["end"]).alias("end")),
            F.when(begins & (run["end"] >= 0), F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]),
        )

    def step(begin):
        def slide(acc, i):
            run, runs = judged(acc)
            counts, came, gone, leaves = acc["counts"], F.get(codes, i - 1), F.get(codes, i - 1 - window), i - begin > window
            into = lambda w, k: F.when(k == came["word"], w + came["one"]).otherwise(w)
            changed = F.transform(counts, lambda w, k: F.when(leaves & (k == gone["word"]), into(w, k) - gone["one"]).otherwise(into(w, k)))
            more = F.get(gains, count(counts, came))
            less = F.get(gains, count(counts, gone) - 1)
            same = (came["word"] == gone["word"]) & (came["shift"] == gone["shift"])
            total = F.when(~leaves, acc["total"] + more).when(same, acc["total"]).otherwise(acc["total"] + more - less)
            names = {"at": i, "full": i - begin >= window, "counts": changed, "total": total, "run": run, "runs": runs}
            return F.struct(*[v.alias(k) for k, v in names.items()])

        return slide

    def close(acc):
        run, runs = judged(acc)
        return F.when(run["end"] >= 0, F.concat(runs, F.array(run))).otherwise(runs)

    def block(begin):
        """Runs of the windows that begin at ``begin`` and the WINDOW_BLOCK - 1 places behind it."""
        zero = F.struct(
            begin.alias("at"),
            F.lit(False).alias("full"),
            F.array(*[F.lit(0).cast("long")] * -(-len(ALPHABET) // PACKED)).alias("counts"),
            F.lit(0.0).alias("total"),
            F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")).alias("run"),
            _none().alias("runs"),
        )
        last = F.least(begin + (WINDOW_BLOCK + window - 1), n)
        return F.aggregate(F.sequence(begin + 1, last), zero, step(begin), close)

    def joined(runs):
        """Runs of neighbouring blocks that touch are one."""
        first = F.filter(runs, lambda r, i: F.coalesce(r["start"] > F.get(runs, i - 1)["end"], F.lit(True)))
        last = F.filter(runs, lambda r, i: F.coalesce(r["end"] < F.get(runs, i + 1)["start"], F.lit(True)))
        return F.zip_with(first, last, lambda a, z: F.struct(a["start"].alias("start"), z["end"].alias("end")))

    blocks = F.transform(F.sequence(F.lit(0), n - window, F.lit(WINDOW_BLOCK)), block)
    return _with(F.flatten(blocks), joined)


def _random_strings(candidates: Column, window: int) -> Column:
    """The random runs of all candidates, as spans of the text."""
    limited = F.transform(candidates, lambda c: F.struct(c["start"], c["string"], _entropy_limit(c["string"]).alias("limit")))

    def code(x):
        """Where a character's count stands."""
        at = F.call_function("instr", F.lit(ALPHABET), x) - 1
        shift = (at % PACKED * WIDTH).cast("int")
        word = F.floor(at / PACKED).cast("int")
        return F.struct(word.alias("word"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    coded = F.transform(
        F.filter(limited, lambda c: c["limit"].isNotNull()),
        lambda c: F.struct(c["start"], c["limit"], F.transform(F.split(c["string"], ""), code).alias("codes")),
    )
    shifted = lambda c: F.transform(_random_runs(c, window), lambda r: F.struct((c["start"] + r["start"]).alias("start"), (c["start"] + r["end"]).alias("end")))
    return F.flatten(F.transform(coded, shifted))


def _beyond(found: Column, base: Column) -> Column:
    """The spans of ``found`` that no single span of ``base`` (in order) holds whole."""
    blocks = F.transform(
        _blocks(base, MATCH_BLOCK),
        lambda b: F.struct(b.alias("spans"), F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end")),
    )
    holds = lambda b, s: (b["start"] <= s["start"]) & (s["end"] <= b["end"])
    held = lambda blocks: F.filter(found, lambda s: ~F.exists(blocks, lambda b: holds(b, s) & F.exists(b["spans"], lambda x: holds(x, s))))
    return _with(blocks, held)


def _with_kind(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, text_col: str = "text", window: int = WINDOW, names: tuple[str, str] = ("secret_base", "secret_spans")) -> DataFrame:
    """``docs`` with two columns of ``names``: the base spans and all spans, arrays of (start, rank, end).

    Positions are code points, the end is exclusive; rank 0, 1, 2 stand for the base kinds assign,
    access and hex, 3 for a string found by its entropy. Spans stand in order of start, then rank.
    Base spans are never dropped; a string found by its entropy is left out only where one base span
    holds it whole, so an access key joined to its secret key is reported with the whole of both.
    Null or empty text: no spans. Very long texts and candidates are scanned whole, in linear time.
    Every other column, of whatever name, passes through; columns called as ``names`` are replaced.
    Repeated rows are each scanned; an empty table gives an empty table.
    """
    base, spans = names
    candidates = fresh_name(docs, "secret_candidates")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [_with_kind(_matches(text, p, g, least, GUARD[kind]), i) for i, (kind, p, g, least) in enumerate(BASE)]
    out = docs.withColumns({base: F.array_sort(F.concat(*kinds)), candidates: _matches(text, CANDIDATE, 0, 24, CANDIDATE)})
    found = _with(_random_strings(F.col(candidates), window), lambda found: _beyond(found, F.col(base)))
    return out.withColumn(spans, F.array_sort(F.concat(base, _with_kind(found, len(BASE))))).drop(candidates)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(kind) for kind, *_ in BASE], F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap or touch become one.

    The spans' borders cut the text once: what lies between two joined spans is kept.
    """
    def pieces(spans):
        def cut(acc, s):
            fresh = (s["start"] > acc["at"]) | (acc["at"] == 0)
            gap = F.struct(acc["at"].alias("start"), s["start"].alias("end"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"]).alias("gaps"))

        zero = F.struct(F.lit(0).alias("at"), _none().alias("gaps"))
        return F.aggregate(spans, zero, cut, lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("start"), F.length(text).alias("end")))))

    kept = F.transform(pieces(spans), lambda g: F.substring(text, g["start"] + 1, g["end"] - g["start"]))
    return F.when(F.size(spans) > 0, F.array_join(kept, mark)).otherwise(text)
