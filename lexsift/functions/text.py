"""Lines, byte trigrams and words as columns and as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import gram_codes, gram_name

#: Fixed value: a token is a run of two or more of these characters.
TOKEN = "[0-9A-Za-z_]{2,}"


def lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., line_no, line): ``\\n`` ends a line, so a final one starts none; empty text has no lines."""
    trimmed = F.when(F.col(text).endswith("\n"), F.expr(f"left(`{text}`, length(`{text}`) - 1)")).otherwise(F.col(text))
    split = df.filter(F.col(text) != "").select(*keep, F.posexplode(F.split(trimmed, "\n", -1)).alias("pos", "line"))
    return split.select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def keys_once(df: DataFrame, keep: tuple[str, ...]) -> bool:
    """Whether no two rows have the same key. Reads the keys only, at once."""
    times = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)])
    return times.groupBy(*times.columns).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def gram_code_rows(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), once: bool | None = None) -> DataFrame:
    """(keep..., code): the distinct byte trigrams of every key, as numbers.

    A text's grams are made distinct where the text is. If every key stands ``once`` (None: that is looked
    up) this is all; only repeated keys need a shuffle of (key, gram) pairs.
    """
    once = keys_once(df, keep) if once is None else once
    rows = df.select(*keep, F.explode(gram_codes(F.col(text))).alias("code"))
    return rows if once else rows.distinct()


def gram_lists(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), once: bool | None = None) -> DataFrame:
    """(keep..., codes): the same with a row for each key, which is far less to shuffle; none or an empty
    array where there is no gram."""
    once = keys_once(df, keep) if once is None else once
    if once:
        return df.select(*keep, gram_codes(F.col(text)).alias("codes"))
    return gram_code_rows(df, text, keep, False).groupBy(*keep).agg(F.collect_list("code").alias("codes"))


def gram_rows(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), once: bool | None = None) -> DataFrame:
    """(keep..., gram): the distinct byte trigrams of every key, as six hex digits."""
    return gram_code_rows(df, text, keep, once).select(*keep, gram_name(F.col("code")).alias("gram"))


def short_grams(text: Column) -> Column:
    """The distinct byte trigrams of a short text in order of first occurrence, as six hex digits."""
    raw = F.encode(text, "UTF-8")
    places = F.when(F.octet_length(raw) >= 3, F.sequence(F.lit(1), F.octet_length(raw) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.hex(F.substring(raw, i, F.lit(3)))))


def token_rows(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), once: bool | None = None) -> DataFrame:
    """(keep..., token): the distinct tokens of every key; ``once`` as for grams."""
    once = keys_once(df, keep) if once is None else once
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))
    rows = df.select(*keep, F.explode(found).alias("token"))
    return rows if once else rows.distinct()


def literal_grams(literal: str) -> list[str]:
    """The distinct byte trigrams of a literal in order of first occurrence, as six hex digits."""
    raw = literal.encode()
    return list(dict.fromkeys(raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)))


def is_binary(text: Column) -> Column:
    """Whether a NUL stands in the text; such rows are left out of names, counts and existence."""
    return F.instr(text, "\x00") > 0


def truncate_pattern(pattern: Column, most: int = 30) -> Column:
    """Patterns of up to ``most`` bytes as they are, longer ones cut to whole characters and ``...``."""
    room = most - 3
    # the longest run of whole characters that fits: each character's end, in bytes, up to the room
    ends = F.filter(F.sequence(F.lit(1), F.least(F.length(pattern), F.lit(room))), lambda i: F.octet_length(F.substring(pattern, F.lit(1), i)) <= room)
    cut = F.concat(F.substring(pattern, F.lit(1), F.coalesce(F.array_max(ends), F.lit(0))), F.lit("..."))
    return F.when(F.octet_length(pattern) <= most, pattern).otherwise(cut)


def csv_field(value: Column) -> Column:
    """Quoted where a comma, a quote or a line break makes it necessary; quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\n\r]'), quoted).otherwise(value)
