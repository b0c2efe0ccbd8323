"""Running sums, maxima and previous rows of series of any length, with no series in one task.

Rows are dealt once into ranges of (key, order) of about equal size, sorted and numbered there. Numbers are cut into blocks of
equal count; a window runs inside each block, and what a block begins with comes from two small scans: over the blocks of a
range and over the ranges of a series, whose rows are totals. Sums, maxima and minima are associative, so the three levels
combine; a previous row is the maximum of (number, row).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import checkpointed

#: Names of the numbering; data columns mustn't have them.
AT, BLOCK, RANGE = "_scan_at", "_scan_block", "_scan_range"
_BITS = 14  # rows of a block: 2^14

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _two(op: str, a: Column, b: Column) -> Column:
    if op == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    if op == "max":
        return F.when(a.isNull() | (b > a), F.coalesce(b, a)).otherwise(a)
    return F.when(a.isNull() | (b < a), F.coalesce(b, a)).otherwise(a)


def dealt(df: DataFrame, by: list[str], order: list[str], bits: int = _BITS) -> DataFrame:
    """``df`` numbered in the order of (``by``, ``order``), for the functions below. ``order`` should tell rows of a key apart:
    equal rows can't be cut. Stored once, as ranges come from a sample and mustn't be drawn twice. Keys mustn't be null."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    out = checkpointed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(AT, F.monotonically_increasing_id()))
    return out.withColumns({BLOCK: F.shiftright(AT, bits), RANGE: F.shiftright(AT, 33)})


def running(df: DataFrame, by: list[str], what: dict[str, tuple[str, Column]], before: bool = False, backwards: bool = False) -> DataFrame:
    """``df`` (of ``dealt``) with, for each name of ``what``, the op ("sum", "max", "min") of a column over the rows of the key up
    to each row, or only those ``before`` it; null over none. ``backwards``: from the key's last row to its first."""
    up_to = Window.unboundedPreceding
    way = F.desc if backwards else F.asc
    inside = Window.partitionBy(*by, BLOCK).orderBy(way(AT)).rowsBetween(up_to, -1 if before else 0)
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(way(order)).rowsBetween(up_to, -1)
    names = list(what)
    # all scans see rows of the same names, whatever the columns are made of
    value = df.select("*", *[c.alias(f"_scan_{k}") for k, (_, c) in what.items()])
    ops = {f"_scan_{k}": op for k, (op, _) in what.items()}
    totals = value.groupBy(*by, RANGE, BLOCK).agg(*[_AGG[op](c).alias(c) for c, op in ops.items()])
    blocks = totals.select(*by, RANGE, BLOCK, *[_AGG[op](c).over(earlier([*by, RANGE], BLOCK)).alias(f"{c}_b") for c, op in ops.items()])
    ranges = totals.groupBy(*by, RANGE).agg(*[_AGG[op](c).alias(c) for c, op in ops.items()])
    ranges = ranges.select(*by, RANGE, *[_AGG[op](c).over(earlier(by, RANGE)).alias(f"{c}_r") for c, op in ops.items()])
    carry = blocks.join(ranges, [*by, RANGE]).drop(RANGE)
    rows = value.withColumns({f"{c}_i": _AGG[op](c).over(inside) for c, op in ops.items()}).join(carry, [*by, BLOCK])
    return rows.select(*df.columns, *[reduce(lambda a, b, o=ops[f"_scan_{k}"]: _two(o, a, b), [F.col(f"_scan_{k}_{x}") for x in "rbi"]).alias(k) for k in names])


def last_before(df: DataFrame, by: list[str], what: dict[str, Column], include: bool = False, backwards: bool = False) -> DataFrame:
    """For each name of ``what`` the last value that isn't null of a column, in rows of the key before each row (or up to it);
    ``backwards``: the first in rows behind it."""
    at = -F.col(AT) if backwards else F.col(AT)
    held = {k: ("max", F.when(c.isNotNull(), F.struct(at.alias("at"), c.alias("v")))) for k, c in what.items()}
    out = running(df, by, held, before=not include, backwards=backwards)
    return out.withColumns({k: F.col(f"{k}.v") for k in what})


def undealt(df: DataFrame) -> DataFrame:
    return df.drop(AT, BLOCK, RANGE)


def previous(df: DataFrame, by: list[str], order: list[str], what: dict[str, Column], bits: int = _BITS) -> DataFrame:
    """``df`` with columns of the row before each in the order of ``order``: ``lag`` over a key of any size."""
    held = {k: F.struct(c.alias("v")) for k, c in what.items()}
    out = last_before(dealt(df, by, order, bits), by, held)
    return undealt(out.withColumns({k: F.col(f"{k}.v") for k in what}))


def place(df: DataFrame, by: list[str], order: list[str], name: str, bits: int = _BITS) -> DataFrame:
    """``df`` with each row's place in its key, from 0."""
    return undealt(running(dealt(df, by, order, bits), by, {name: ("sum", F.lit(1).cast("long"))}, before=False).withColumn(name, F.col(name) - 1))
