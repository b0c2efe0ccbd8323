"""Smoothers read at chart slots: exponential, triangular and Savitzky-Golay local polynomial fits, without a fold.

Running sums are taken in blocks of equal counts (``scan``), whatever a series' size and density. Samples are (series.., x, y) with finite y; slots are (series.., slot, x).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fit import fit, moments, translated
from .scan import dealt, running

SAVGOL_FLOOR = (5 / 7, 5 / 7, 805 / 572)
EMA_FLOOR = (0.5, 1.25, 33 / 16)
_FOLDS = 20.0  # a block of an EMA, in e-folds; two blocks back the weights are below e^-20 of the newest


@dataclass(frozen=True)
class Smoothing:
    kind: str  # ema, triangular, savgol
    degree: int = 1
    tau: float = 10.0
    window: int = 11

    def __post_init__(self) -> None:
        if self.kind not in ("ema", "triangular", "savgol"):
            raise ValueError(f"unknown smoother {self.kind}")
        if self.kind == "ema" and not (math.isfinite(self.tau) and self.tau > 0):
            raise ValueError("tau must be finite and positive")
        object.__setattr__(self, "degree", min(max(self.degree, 0), 2))
        object.__setattr__(self, "window", min(max(self.window, 3), 4096))


@dataclass(frozen=True)
class Floor:
    """The bucket width w(x) that a downsampled chart widens smoothers to; zero widens nothing."""

    width: float = 0.0
    growth: float = 0.0
    shift: float = 0.0


def smooth(samples: DataFrame, slots: DataFrame, series: list[str], s: Smoothing, units: DataFrame | None, floor: Floor = Floor()) -> DataFrame:
    """series.., slot, value at each slot that has a fit. ``units``: series.., unit (x for each unit of the smoother's width; 1 if absent)."""
    if units is None:
        units = samples.select(*series).distinct().withColumn("unit", F.lit(1.0))
    if s.kind == "savgol":
        return _savgol(samples, slots, series, s, units, floor)
    return _ema(samples, slots, series, s, units, floor) if s.kind == "ema" else _triangular(samples, slots, series, s, units)


def _events(samples: DataFrame, slots: DataFrame, series: list[str]) -> DataFrame:
    a = samples.select(*series, F.lit(None).cast("long").alias("slot"), "x", "y")
    b = slots.select(*series, F.col("slot").cast("long").alias("slot"), "x", F.lit(None).cast("double").alias("y"))
    return a.unionAll(b)


def _sums(e: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The slots of ``e`` with the sums of ``names`` over the samples of their key at or before their x."""
    # at equal x samples come before the slot
    ordered = dealt(e.withColumn("_late", F.col("slot").isNotNull()), keys, ["x", "_late", "slot"])
    summed = running(ordered, keys, {f"s_{n}": ("sum", F.col(n)) for n in names}).where("slot IS NOT NULL")
    return summed.select(*[c for c in e.columns if c not in names], *[F.coalesce(f"s_{n}", F.lit(0.0)).alias(n) for n in names])


def _triangular(samples, slots, series, s: Smoothing, units) -> DataFrame:
    """Weight 1 + (x - first x) / unit: it never decays, so moments are running sums."""
    d = s.degree
    span = samples.groupBy(*series).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    e = _events(samples, slots, series).join(span.join(units, series), series).where("slot IS NULL OR x >= x0")
    scale = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))
    u = (F.col("x") - F.col("x0")) / scale
    w = F.when(F.col("y").isNotNull(), 1 + (F.col("x") - F.col("x0")) / F.col("unit"))
    mw, sw = moments(w, u, F.col("y"), d)
    names = [f"m{i}" for i in range(len(mw) + len(sw))]
    e = e.select(*series, "slot", "x", u.alias("u"), *[c.alias(n) for n, c in zip(names, mw + sw, strict=True)])
    at = _sums(e, series, names)
    sums = [F.col(n) for n in names]
    value = fit(sums[: 2 * d + 1], sums[2 * d + 1 :], d, F.col("u"))
    return at.select(*series, "slot", value.alias("value")).where("value IS NOT NULL")


def _ema(samples, slots, series, s: Smoothing, units, floor: Floor) -> DataFrame:
    """Weight exp(-folds between sample and slot), folds being the integral of dx / (unit tau(x)).

    A block is ``_FOLDS`` folds; moments are centred on a block's last sample. A slot has its block's prefix and the
    totals of the two blocks with samples before it: three rows, each re-centred, that are summed for each slot. Prefixes are
    scanned in parts of equal counts, however many samples a block has."""
    d, n = s.degree, 2 * s.degree + 1
    r = EMA_FLOOR[d]
    base = F.greatest(F.lit(s.tau), F.lit(r * floor.width) / F.col("unit")) * F.col("unit")  # in x
    growth = r * floor.growth

    def tau(x: Column) -> Column:
        return F.greatest(base, growth * (x + floor.shift)) if growth else base

    def folds(x: Column) -> Column:
        if not growth:
            return x / base
        knee = base / growth - floor.shift
        return F.least(x, knee) / base + F.when(x > knee, F.log((x + floor.shift) / (knee + floor.shift)) / growth).otherwise(0.0)

    e = _events(samples, slots, series).join(units, series).withColumn("e", folds(F.col("x"))).withColumn("block", F.floor(F.col("e") / _FOLDS))
    keys = [*series, "block"]
    # a row for each block: its last sample, if it has any
    refs = e.groupBy(*keys, "unit").agg(F.max(F.when(F.col("y").isNotNull(), F.col("x"))).alias("ref"))
    refs = refs.select(*keys, "ref", folds(F.col("ref")).alias("ref_e"), tau(F.col("ref")).alias("ref_tau"))
    e = e.join(refs, keys)
    u = (F.col("x") - F.col("ref")) / F.col("ref_tau")
    w = F.when(F.col("y").isNotNull(), F.exp(F.col("e") - F.col("ref_e")))
    mw, sw = moments(w, u, F.col("y"), d)
    names = [f"m{i}" for i in range(len(mw) + len(sw))]
    e = e.select(*keys, "slot", "x", "ref", "ref_e", "ref_tau", *[c.alias(k) for k, c in zip(names, mw + sw, strict=True)])
    at = _sums(e, keys, names)
    # p1 and p2 are the last two blocks before a block that hold samples
    own = F.when(F.col("ref").isNotNull(), F.struct("block", "ref", "ref_e", "ref_tau", *names))
    totals = e.groupBy(*keys).agg(F.max("ref").alias("ref"), F.max("ref_e").alias("ref_e"), F.max("ref_tau").alias("ref_tau"), *[F.sum(k).alias(k) for k in names])
    back = Window.partitionBy(*series).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chained = totals.select(*series, "block", own.alias("own")).withColumn("p1", F.last("own", True).over(back))
    chained = chained.withColumn("p2", F.last(F.when(F.col("own").isNotNull(), F.struct("p1")), True).over(back).getField("p1"))
    chained = chained.select(*keys, F.struct("p1.ref", "p1.ref_e", "p1.ref_tau", *[f"p1.{k}" for k in names]).alias("p1"), F.struct("p2.ref", "p2.ref_e", "p2.ref_tau", *[f"p2.{k}" for k in names]).alias("p2"))
    j = at.join(chained, keys).withColumn("p0", F.struct("ref", "ref_e", "ref_tau", *names))
    here = F.col("m0") > 0
    ref, ref_e, ref_tau = (F.when(here, F.col(c)).otherwise(F.col(f"p1.{c}")) for c in ("ref", "ref_e", "ref_tau"))
    j = j.select(*series, "slot", "x", ref.alias("_r"), ref_e.alias("_e"), ref_tau.alias("_t"), F.inline(F.array(F.when(here, F.col("p0")), "p1", "p2"))).where("_r IS NOT NULL AND ref IS NOT NULL")
    # only ratios of weights count, so exponents may be cut where they would leave the range
    scale = F.exp(F.greatest(F.col("ref_e") - F.col("_e"), F.lit(-600.0)))
    rr, dd = F.col("ref_tau") / F.col("_t"), (F.col("ref") - F.col("_r")) / F.col("_t")
    raw = [F.col(k) for k in names]
    moved = translated(raw[:n], scale, rr, dd) + translated(raw[n:], scale, rr, dd)
    # a row's weights in plain columns first: the sums are then small enough to be compiled
    summed = j.groupBy(*series, "slot", "x", "_r", "_t").agg(*[F.sum(c).alias(k) for k, c in zip(names, moved, strict=True)])
    t = [F.col(k) for k in names]
    value = fit(t[:n], t[n:], d, (F.col("x") - F.col("_r")) / F.col("_t"))
    return summed.select(*series, "slot", value.alias("value")).where("value IS NOT NULL")


def _savgol(samples, slots, series, s: Smoothing, units, floor: Floor) -> DataFrame:
    """Biweight window of half-width h(x) around each slot: a range join by cells of a series' base half-width.

    Slots are few (about twice the chart's target), and each meets the samples of its window only."""
    d, n = s.degree, 2 * s.degree + 1
    r = SAVGOL_FLOOR[d]
    base = F.greatest(F.lit(s.window / 2) * F.col("unit"), F.lit(r * floor.width))
    h = F.greatest(base, F.lit(r * floor.growth) * (F.col("xq") + floor.shift)) if floor.growth else base
    q = slots.select(*series, "slot", F.col("x").alias("xq")).join(units, series).withColumns({"h": h, "cell_h": base})
    # a window that has outgrown its cells takes coarser ones: cells of 2^k base half-widths, k by the slot
    q = q.withColumn("k", F.greatest(F.ceil(F.log2(F.col("h") / F.col("cell_h"))), F.lit(0)).cast("int"))
    size = F.col("cell_h") * F.pow(F.lit(2.0), F.col("k"))
    q = q.withColumn("cell", F.explode(F.sequence(F.floor((F.col("xq") - F.col("h")) / size), F.floor((F.col("xq") + F.col("h")) / size))))
    levels = q.select(*series, "k", "cell_h").distinct()
    x = samples.join(levels, series).withColumn("cell", F.floor(F.col("x") / (F.col("cell_h") * F.pow(F.lit(2.0), F.col("k")))))
    near = q.select(*series, "slot", "xq", "h", "k", "cell").join(x.select(*series, "k", "cell", "x", "y"), [*series, "k", "cell"])
    u = (F.col("x") - F.col("xq")) / F.col("h")
    near = near.withColumn("u", u).where(F.abs("u") < 1)
    taper = (1 - F.col("u") * F.col("u")) * (1 - F.col("u") * F.col("u"))
    mw, sw = moments(taper, F.col("u"), F.col("y"), d)
    names = [f"m{i}" for i in range(len(mw) + len(sw))]
    g = near.groupBy(*series, "slot").agg(*[F.sum(c).alias(k) for k, c in zip(names, mw + sw, strict=True)])
    m = [F.col(k) for k in names]
    return g.select(*series, "slot", fit(m[:n], m[n:], d, F.lit(0.0)).alias("value")).where("value IS NOT NULL")
