"""Evidence as structs in column expressions: how a fact's value, status and confidence go together."""

from typing import NamedTuple

from pyspark.sql import functions as F

from factloom.catalog import SCORES

TYPE = "struct<target string, status string, value string, confidence string, confidence_score double, path string, source string>"


class Text(NamedTuple):
    """A string column that is a fact's value; `absent` is its JSON text where it is null."""

    column: object
    absent: object = None


class Fact(NamedTuple):
    """A fact before its row is known: its value as JSON text, or as a text to be quoted."""

    target: str
    status: str
    value: object
    text: object
    confidence: str
    path: str
    source: str


RAW = "struct<target: string, status: string, value: string, text: string, confidence: string, confidence_score: double, path: string, source: string>"


def text_json(c):
    return Text(c)


def plain(c):
    """A number or boolean as JSON text."""
    return c.cast("string")


def resolved(target, value, confidence, path, source):
    """A fact with its value (JSON text, or Text); without one it is unknown."""
    status = "resolved" if SCORES[confidence] >= SCORES["high"] else "estimated"
    value, text = (value.absent, value.column) if isinstance(value, Text) else (value, None)
    return Fact(target, status, value, text, confidence, path, source)


def unresolved(target, path, status="unknown"):
    return Fact(target, status, None, None, "none", path, "none")


def or_null(value):
    """A fact that may be absent: the JSON null is its value then."""
    if isinstance(value, Text):
        return Text(value.column, F.when(value.column.isNull(), "null"))
    return F.coalesce(value, F.lit("null"))


def evidence(facts):
    """An array column of facts; each value's expression stands in it once."""
    null = F.lit(None).cast("string")
    lit = lambda x: null if x is None else F.lit(x) if isinstance(x, str) else x
    names = ("target", "status", "value", "text", "confidence", "confidence_score", "path", "source")
    rows = [F.struct(*(lit(c).alias(n) for n, c in zip(names, (f.target, f.status, f.value, f.text, f.confidence, F.lit(SCORES[f.confidence]), f.path, f.source), strict=True))) for f in facts]
    return F.array(*rows).cast(f"array<{RAW}>")


def settled(raw):
    """Facts with texts quoted, and those without a value unknown."""
    quoted = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    valued = F.transform(raw, lambda e: F.struct(e.alias("e"), F.coalesce(e["value"], F.when(e["text"].isNotNull(), quoted(e["text"]))).alias("v")))
    known = lambda x, then, other: F.when(x["v"].isNotNull(), then).otherwise(other)
    status = lambda x: F.when(x["v"].isNotNull() | (x["e"]["status"] == "unsupported"), x["e"]["status"]).otherwise("unknown")
    whole = lambda x: F.struct(x["e"]["target"], status(x), x["v"], known(x, x["e"]["confidence"], "none"), known(x, x["e"]["confidence_score"], 0.0), x["e"]["path"], known(x, x["e"]["source"], "none"))
    return F.transform(valued, whole).cast(f"array<{TYPE}>")


def unsigned(c):
    """Text of a whole number as a decimal, null for anything else."""
    number = F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("decimal(38,0)"))
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(38,0)"), number).cast("decimal(20,0)")


def gcd(a, b):
    """Greatest common divisor of two whole columns; the steps are at most five for each digit of the second, and one."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), 5 * F.length(b.cast("string")) + 1), F.struct(a.alias("a"), b.alias("b")), step)["a"]


def orientation(width, height):
    return F.when(width > height, "landscape").when(width < height, "portrait").when(width == height, "square")


def pinned(df, **columns):
    """`df` with columns that are worked out once a row, even where lambdas of later expressions refer to them.

    The optimizer would write a plain column's expression into each lambda, which runs
    once an element; it does not look through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
