"""Hashes, flags, sizes and quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats that these functions describe.
TOKEN_OFFSET = 1469598103934665603  # start of the token hash
SIGNATURE_OFFSET = 0xCBF29CE484222325 - (1 << 64)  # start of the query-signature hash, as a signed long
CASE_INSENSITIVE, WHOLE_WORD, FIXED = 1, 2, 4  # bits of a cache key's flags


def varint_length(value: Column) -> Column:
    """Bytes of a number written seven bits at a time."""
    length = F.lit(5)
    for bits, n in ((28, 4), (21, 3), (14, 2), (7, 1)):
        length = F.when(value < (1 << bits), F.lit(n)).otherwise(length)
    return length


def _times_prime(x: Column) -> Column:
    """x times 2**40 + 435 in 64 bits; split in halves, so that nothing overflows."""
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    upper = (high * 435 + F.shiftrightunsigned(low * 435, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(upper, 32).bitwiseOR((low * 435).bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv1a64(raw: Column, offset: int = TOKEN_OFFSET) -> Column:
    """FNV-1a over the bytes of a binary column, as a signed 64-bit number."""
    digits = F.hex(raw)
    codes = F.transform(
        F.sequence(F.lit(0), F.octet_length(raw) - 1),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"),
    )
    folded = F.aggregate(codes, F.lit(offset).cast("long"), lambda h, b: _times_prime(h.bitwiseXOR(b)))
    return F.when(F.octet_length(raw) > 0, folded).otherwise(F.lit(offset).cast("long"))


def query_signature(grams: Column, total_postings: Column) -> Column:
    """One number for a query: its grams in order and how many postings they have."""
    folded = F.aggregate(grams, F.lit(SIGNATURE_OFFSET).cast("long"), lambda h, g: _times_prime(h.bitwiseXOR(g.cast("long"))))
    return _times_prime(folded.bitwiseXOR(total_postings.cast("long")))


def cache_flags(insensitive: Column, word: Column, fixed: Column) -> Column:
    bit = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    return bit(insensitive, CASE_INSENSITIVE) + bit(word, WHOLE_WORD) + bit(fixed, FIXED)


def flags_text(flags: Column) -> Column:
    """``-i -w -F`` as far as they are set, or ``default``."""
    names = [F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in ((1, "-i"), (2, "-w"), (4, "-F"))]
    joined = F.concat_ws(" ", *names)
    return F.when(joined == "", F.lit("default")).otherwise(joined)


def format_size(size: Column) -> Column:
    """B, then KB and MB with one decimal, GB with two, in steps of 1024."""
    steps = ((30, "%.2f GB"), (20, "%.1f MB"), (10, "%.1f KB"))
    out = F.format_string("%d B", size)
    for bits, form in reversed(steps):
        out = F.when(size >= (1 << bits), F.format_string(form, size / float(1 << bits))).otherwise(out)
    return out


# Units of quantities.
UNITS = {
    "": 1, "B": 1,
    "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12,
    "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40,
}


def parse_quantity(value: Column, rate: Column) -> Column:
    """Bytes of ``512MiB`` and the like, as decimal(20,0); rates end in ``/s``. Null: not a quantity,
    zero, or beyond 64 unsigned bits."""
    body = F.when(rate, F.regexp_extract(value, "^(.*)/s$", 1)).otherwise(value)
    digits, unit = F.regexp_extract(body, "^([0-9]+)([A-Za-z]*)$", 1), F.regexp_extract(body, "^([0-9]+)([A-Za-z]*)$", 2)
    times = F.element_at(F.create_map(*[x for u, n in UNITS.items() for x in (F.lit(u), F.lit(n).cast("decimal(13,0)"))]), unit)
    number = F.when((digits != "") & (F.length(F.ltrim(digits, F.lit("0"))) <= 20), digits.try_cast("decimal(24,0)"))
    total = (number * times).cast("decimal(38,0)")
    return F.when((total > 0) & (total <= F.lit("18446744073709551615").cast("decimal(38,0)")), total.cast("decimal(20,0)"))


def xor64(raw: Column) -> Column:
    """The older checksum: the exclusive or of the whole little-endian 64-bit words of a binary column.

    Halves of words are read high byte first, and the bytes turned round once at the end.
    """
    words = F.regexp_extract_all(F.hex(raw), F.lit("[0-9A-F]{16}"), F.lit(0))
    half = lambda w, at: F.conv(F.substring(w, at, 8), 16, 10).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    step = lambda acc, w: F.struct(acc["a"].bitwiseXOR(half(w, 1)).alias("a"), acc["b"].bitwiseXOR(half(w, 9)).alias("b"))

    def turned(x):
        out = F.lit(0).cast("long")
        for i in range(4):
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)))
        return out

    return F.aggregate(words, zero, step, lambda acc: F.shiftleft(turned(acc["b"]), 32).bitwiseOR(turned(acc["a"])))


def progress_json(done: Column, total: Column, elapsed: Column) -> Column:
    """done, total, and eta: the elapsed time in proportion to what is left, null at both ends."""
    eta = F.when((done > 0) & (done < total), F.floor(elapsed * (total - done) / done))
    return F.to_json(F.struct(done.alias("done"), total.alias("total"), elapsed.alias("elapsed"), eta.cast("long").alias("eta")))
