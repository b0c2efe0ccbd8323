"""Change sets between two versions of a chart, and their splicing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chart import SERIES, Grid

CELLS = ["x", "xr_min", "xr_max", "value", "raw_value", "y_min", "y_max", "marker_kind"]


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells (series, slot) that differ, were added or vanished; ``gone`` tells the last."""
    cells = [c for c in CELLS if c in before.columns and c in after.columns]
    b = before.select(*SERIES, "slot", F.struct(*cells).alias("was"))
    a = after.select(*SERIES, "slot", F.struct(*cells).alias("now"))
    both = a.join(b, [*SERIES, "slot"], "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select(*SERIES, "slot", F.col("now").isNull().alias("gone"), *[F.col(f"now.{c}").alias(c) for c in cells])


def change_set(before: DataFrame, after: DataFrame, held: Grid | None = None, grid: Grid | None = None) -> DataFrame:
    """One row: unchanged, delta or full; the first changed slot; how many cells changed.

    Full (from slot 0) where the grids ``held`` before and behind differ in width, ladder or shift or only one is none, where
    bands came or went, or where the first slot moved: then no slot of the old chart is known to be the new one's."""
    bands = lambda rows, name: rows.agg(F.coalesce(F.bool_or(F.col("y_min").isNotNull()), F.lit(False)).alias(name))
    diff = changed(before, after).agg(F.min("slot").alias("slot"), F.count(F.lit(1)).alias("cells"))
    shapes = bands(before, "banded").crossJoin(bands(after, "bands"))
    whole = F.lit(held != grid) | ((F.col("banded") != F.col("bands")) & (F.col("cells") > 0)) | (F.col("slot") == 0)
    kind = F.when(F.coalesce(whole, F.lit(False)), "full").when(F.col("cells") == 0, "unchanged").otherwise("delta")
    return diff.crossJoin(shapes).select(kind.alias("kind"), F.when(kind == "full", F.lit(0).cast("long")).otherwise(F.col("slot")).alias("first_slot"), "cells")


def tail(after: DataFrame, first_slot: int) -> DataFrame:
    return after.where(F.col("slot") >= first_slot)


def splice(before: DataFrame, tail_rows: DataFrame, first_slot: int) -> DataFrame:
    """The kept prefix and the new tail: equals the new chart."""
    return before.where(F.col("slot") < first_slot).unionByName(tail_rows)
