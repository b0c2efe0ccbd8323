"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_MAX = 3.4028234663852886e38


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def marker_kind(v: Column) -> Column:
    """0 finite, 1 NaN, 2 +infinity, 3 -infinity."""
    return F.when(F.isnan(v), 1).when(v == float("inf"), 2).when(v == float("-inf"), 3).otherwise(0)


def presented(v: Column) -> Column:
    """A chart's y: clamped to the 32-bit float range and rounded to it."""
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(FLOAT_MAX)), F.lit(-FLOAT_MAX))).cast("float")


def natural_key(name: Column) -> Column:
    """Sorts runs of ASCII digits by their length, then as text, and all else by bytes: ``b2`` before ``b10`` before ``b007``.

    A run stands behind its length and a zero, which compares with other bytes as any digit does."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(p).cast("string"), 10, "0"), p)).otherwise(p)), "")


def section(metric: Column) -> Column:
    """Text before the last slash; empty without one."""
    return F.when(F.locate("/", metric) > 0, F.regexp_extract(metric, r"^(.*)/[^/]*$", 1)).otherwise("")


def tsv_cell(text: Column) -> Column:
    """Tabs and line breaks become spaces; a cell that a spreadsheet would run as a formula, blanks before it or not, gets an
    apostrophe."""
    flat = F.regexp_replace(text, r"[\t\r\n\u2028\u2029]+", " ")
    return F.when(flat.rlike(r"^[\s\x0B\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\uFEFF]*[=+\-@]"), F.concat(F.lit("'"), flat)).otherwise(flat)


def tsv_number(v: Column) -> Column:
    kind = marker_kind(v)
    return F.when(v.isNull(), "").when(kind == 1, "NaN").when(kind == 2, "Infinity").when(kind == 3, "-Infinity").otherwise(v.cast("string"))


def ema_width(alpha: Column) -> Column:
    """Time constant of an EMA alpha, at least 1; 10 for an alpha outside (0, 1)."""
    return F.when((alpha > 0) & (alpha < 1), F.greatest(-1.0 / F.log(1 - alpha), F.lit(1.0))).otherwise(10.0)


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    raw = text.cast("binary")
    inside = lambda at: F.coalesce(F.substring(raw, at + 1, 1).between(F.lit(bytearray([0x80])), F.lit(bytearray([0xBF]))), F.lit(False))
    # a character has at most three bytes behind its first
    whole = F.when(~inside(limit), limit).when(~inside(limit - 1), limit - 1).when(~inside(limit - 2), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(raw, F.lit(1), F.greatest(whole, F.lit(0))).cast("string"))
