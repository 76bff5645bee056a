import pytest

from lexsift.plans.regex import PatternError, can_be_empty, mandatory_literal, may_fold, parse, to_java


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("orchard", "orchard"), ("plum.*pear", "pear"), ("wal.nut", "nut"), ("(?i:g)rape99", "rape99"), ("[0-9]+", None),
        ("fig|date", None), ("(?i)olive", None), ("(?:mulberry)?q", "q"), (r"\x6delon", "melon"), (r"\u{006D}elon", "melon"),
        (r"sloe\.gin", "sloe.gin"), (r"sloe\(gin\)", "sloe(gin)"), ("(uvw)+k", "uvw"), ("(uvw){0,2}k", "k"), ("", None),
        ("st(anza)uv", "anza"), ("[0-9]+stone", "stone"), (r"(?x) p q r # why", "pqr"),
    ],
)
def test_mandatory_literal(pattern, literal):
    assert mandatory_literal(parse(pattern)) == literal


@pytest.mark.parametrize("pattern", ["orchard", r"\x6Delon", r"\u{006D}elon", "(?U)melon", r"melon\p{Ll}*", "[P-T]lum"])
def test_smart_case_folds(pattern):
    assert may_fold(pattern, fixed=False)


@pytest.mark.parametrize("pattern", ["Orchard", "redPlum", r"\x4Delon", r"\u{004D}elon", "Ñame", "(?:Melon)?q", "Melon|fig"])
def test_smart_case_keeps(pattern):
    assert not may_fold(pattern, fixed=False)


def test_smart_case_fixed():
    assert may_fold("ñame", True) and not may_fold(r"\x6Delon", True) and may_fold("(", False)


@pytest.mark.parametrize("pattern", ["a\nb", r"a\nb", r"\x0a", "(?=a)", "(?<!a)b", r"(a)\1", r"\h", "(a", "a)", "*a", "[a", r"\x{zz}", "a{3,1}", "(?q)a"])
def test_not_in_the_dialect(pattern):
    with pytest.raises(PatternError):
        parse(pattern)


def test_to_java():
    assert to_java(parse("a.b")) == r"a[^\n]b"
    assert to_java(parse("a++")) == "(?:(?:a)+)+"
    assert to_java(parse(r"\p{Greek}")) == r"[\p{IsGreek}&&[^\n]]"
    assert to_java(parse("(?P<name>x)")) == "(?<name>x)"
    assert to_java(parse("(?i)k")) == "(?iu:k)"
    assert can_be_empty(parse("a*")) and not can_be_empty(parse("a+b?"))


@pytest.mark.parametrize(
    "pattern, line, hit",
    [
        ("[a-z--aeiou]{3}", "xyz", True), ("[a-z--aeiou]{3}", "xay", False), ("[a-z&&x-z]+$", "ab z", True), ("[^a]b", "ab", False),
        (r"\bfig\b", "a fig b", True), (r"^x$", "x", True), ("(?i)STRASSE", "strasse", True), (r"\d{2,}", "a12", True), ("[[:digit:]]x", "7x", True),
        ("[a-c~~b-d]x", "bx", False), ("[a-c~~b-d]x", "dx", True), (r"\u{e9}t", "ét", True), ("(?i)milk", "mil\u212a", True),
    ],
)
def test_java_matches(spark, pattern, line, hit):
    from pyspark.sql import functions as F

    from lexsift.operators.search import matches
    from lexsift.plans.query import Query

    row = spark.createDataFrame([(line,)], "line string").select(matches(F.col("line"), Query((pattern,))).alias("m")).first()
    assert row["m"] == hit
