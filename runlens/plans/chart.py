"""Charts: many series on one shared axis, downsampled to envelopes, smoothed, with markers for what can't be drawn.

``chart`` returns the long form: a row for each series and slot that holds something. A small job finds the axis' bounds
and how many distinct x there are; the grid is fixed from these on the driver; then one plan makes the rows. Slots are at
most about twice the target (all distinct x where nothing is downsampled), points are only ever grouped by key. A step range,
widened by what the smoother reads beyond it, filters rows before the newest versions are picked, so it reaches the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_finite, marker_kind
from ..operators.points import latest, median_gap, smoothing_margin, tag_groups
from .scan import dealt, last_before
from .scratch import checkpointed, numbered
from .smooth import EMA_FLOOR, SAVGOL_FLOOR, Floor, Smoothing, smooth

SERIES = ["run_id", "metric_name", "tag"]
ENVELOPE_POINTS = 4
MAX_TAGS = 64
_OCTAVE_MIN = -500


@dataclass(frozen=True)
class Request:
    metrics: tuple[str, ...]
    runs: tuple[str, ...] = ()
    axis: str = "step"  # step, time, relative, metric
    x_metric: str = ""
    target: int = 500
    log_x: bool = False
    smoothing: Smoothing | None = None
    steps: tuple[int, int] | None = None
    tags: tuple[str, ...] = ()
    versioned: bool = True  # False: the points are one version already
    log_shift: bool | None = None  # whether a log axis runs in x + 1; None: where it begins at 0

    def __post_init__(self) -> None:
        if self.axis not in ("step", "time", "relative", "metric"):
            raise ValueError(f"unknown axis {self.axis}")
        if self.axis in ("time", "relative"):
            object.__setattr__(self, "x_metric", "")  # a time axis wins over another metric's
        if (self.axis == "metric") != bool(self.x_metric):
            raise ValueError("an x metric and axis 'metric' come together")
        if self.target < 0:
            raise ValueError("target is negative")


@dataclass(frozen=True)
class Grid:
    """Cells of a downsampled axis. Linear: width is a power of two, boundaries at its multiples. Ladder (width 0): octaves
    in 2**m cells each, of x + 1 if shifted."""

    width: float = 0.0
    m: int = 0
    shift: bool = False
    spec: dict = field(default_factory=dict, compare=False)

    @property
    def floor(self) -> Floor:
        return Floor(width=self.width) if self.width else Floor(growth=2.0**-self.m, shift=float(self.shift))

    def cell(self, x: Column) -> Column:
        if self.width:
            return F.floor(x / self.width)
        v = x + 1.0 if self.shift else x
        octave = F.floor(F.log2(v))
        low = F.pow(F.lit(2.0), octave)
        octave = octave - F.when(low > v, 1).otherwise(0) + F.when(low * 2 <= v, 1).otherwise(0)  # log2 may round over a power
        octave = F.greatest(octave, F.lit(_OCTAVE_MIN))
        step = F.floor((v / F.pow(F.lit(2.0), octave) - 1) * float(1 << self.m))
        return (octave * (1 << self.m) + F.greatest(step, F.lit(0))).cast("long")

    def cell_of(self, x: float) -> int:
        if self.width:
            return math.floor(x / self.width)
        v = x + 1.0 if self.shift else x
        octave = max(math.frexp(v)[1] - 1, _OCTAVE_MIN)
        return octave * (1 << self.m) + max(math.floor((v / 2.0**octave - 1) * (1 << self.m)), 0)

    def wide(self, cell: Column) -> Column:
        """Whether a cell of an integer axis expects enough points for an envelope."""
        if self.width:
            return F.lit(self.width >= ENVELOPE_POINTS)
        return F.floor(cell / (1 << self.m)) >= self.m + 2


def linear_width(lo: float, hi: float, target: int) -> float:
    """The smallest power of two of which ``target`` span the axis; 0 for a single x."""
    if not target or not hi > lo:
        return 0.0
    k = math.ceil(math.log2((hi - lo) / target))
    while 2.0**k * target < hi - lo:
        k += 1
    return 2.0**k


def plan_grid(lo: float, hi: float, distinct: int, req: Request) -> Grid | None:
    """The grid, or None where every distinct x gets its own slot."""
    if not req.target:
        return None
    integer = req.axis == "step"
    width = linear_width(lo, hi, req.target)
    if integer and not req.log_x and width < ENVELOPE_POINTS:
        return None
    if distinct <= req.target:
        return None
    if not req.log_x:
        return Grid(width=width)
    return _ladder(lo, hi, req)


def _ladder(lo: float, hi: float, req: Request) -> Grid:
    """The finest ladder with at most ``target`` cells from lo to hi, the coarsest if all have more."""
    grid = Grid(shift=req.axis != "metric" and lo == 0.0 if req.log_shift is None else req.log_shift)
    while grid.m < 40:
        finer = Grid(m=grid.m + 1, shift=grid.shift)
        if finer.cell_of(hi) - finer.cell_of(lo) + 1 > req.target:
            break
        grid = finer
    return grid


def zoom_floor(req: Request) -> Floor:
    """The widest floor that a step chart of the requested range can have: a narrower span only refines its grid."""
    if req.axis != "step" or not req.target or not req.steps:
        return Floor()
    lo, hi = (max(float(x), 0.0) if req.log_x else float(x) for x in req.steps)
    if hi < lo:
        return Floor()
    return _ladder(lo, hi, req).floor if req.log_x else Floor(width=linear_width(lo, hi, req.target))


def read_range(req: Request) -> tuple[int | None, int | None] | None:
    """The steps to read for the requested ones: a smoother needs samples beyond them."""
    if not req.steps or not req.smoothing:
        return req.steps
    s, floor = req.smoothing, zoom_floor(req)
    share = (EMA_FLOOR if s.kind == "ema" else SAVGOL_FLOOR)[s.degree]
    reach = tuple(share * max(floor.width, floor.growth * (x + floor.shift)) for x in req.steps)
    return smoothing_margin(s.kind, req.steps, s.tau, s.window, reach)


def prepare(points: DataFrame, req: Request) -> tuple[DataFrame, DataFrame]:
    """Samples (series, step, x, y, kind, shown) in the order range, dedup, kind, tags, axis; and anchors of samples whose x can't
    be drawn (series, anchor x or null for the axis' left end). ``shown`` is false for the margin that smoothing reads. Tag groups
    are chosen by the rows in range."""
    mine = points.where(F.col("metric_name").isin(list({*req.metrics, req.x_metric} - {""})))
    if req.runs:
        mine = mine.where(F.col("run_id").isin(list(req.runs)))
    for bound, inside in zip(read_range(req) or (), (F.col("step").__ge__, F.col("step").__le__), strict=False):
        mine = mine if bound is None else mine.where(inside(bound))
    newest = latest(mine) if req.versioned else mine
    numeric = newest.where("value IS NOT NULL").withColumn("y", F.col("value").cast("double"))
    y = tag_groups(numeric.where(F.col("metric_name").isin(list(req.metrics))), list(req.tags) or None)
    y = y.withColumn("shown", F.col("step").between(*req.steps) if req.steps else F.lit(True))
    if req.axis == "metric":
        xs = numeric.where((F.col("metric_name") == req.x_metric) & (F.col("tag") == "")).select("run_id", "step", F.col("y").alias("x"))
        y = y.join(xs, ["run_id", "step"])
        bad = ~is_finite(F.col("x")) | (F.lit(req.log_x) & (F.col("x") <= 0))
    else:
        if req.axis == "relative":
            y = y.join(y.groupBy(*SERIES).agg(F.min("timestamp_ms").alias("_start")), SERIES)
        x = {"step": "step", "time": "timestamp_ms", "relative": "timestamp_ms - _start"}[req.axis]
        y = y.withColumn("x", F.expr(x).cast("double"))
        bad = F.lit(req.log_x) & (F.col("x") < 0)
    y = y.select(*SERIES, "step", "x", "y", marker_kind(F.col("y")).alias("kind"), "shown", bad.alias("bad"))
    good = y.where("NOT bad")
    if req.axis == "metric":
        # bad points look back for the last x drawn before them, in their series' order of steps
        plotted = F.when(~F.col("bad") & F.col("shown"), F.col("x"))
        at = last_before(dealt(y.where("shown").select(*SERIES, "step", "x", "bad", "shown"), SERIES, ["step"]), SERIES, {"_prev": plotted}, include=True)
        first = y.where("shown AND NOT bad").groupBy(*SERIES).agg(F.min_by("x", "step").alias("_first"))
        anchors = at.where("bad").join(first, SERIES, "left").select(*SERIES, F.coalesce("_prev", "_first").alias("anchor"))
    else:
        first = good.where("shown").groupBy(*SERIES).agg(F.min("x").alias("anchor"))
        anchors = y.where("bad AND shown").select(*SERIES).join(first, SERIES, "left")
    return good.drop("bad"), anchors


def chart(points: DataFrame, req: Request) -> DataFrame:
    """run_id, metric_name, tag, slot, x, xr_min, xr_max, value, raw_value, y_min, y_max, marker_kind."""
    return chart_and_grid(points, req)[0]


def chart_and_grid(points: DataFrame, req: Request) -> tuple[DataFrame, Grid | None]:
    """A chart, and the grid it is drawn on (None: every distinct x has a slot)."""
    if req.smoothing and req.axis == "metric":
        return custom_smoothed(points, req)
    samples, anchors = prepare(points, req)
    samples = checkpointed(samples)
    planned = plan_axis(samples, req)
    if planned is None:
        return _empty(samples, req), None
    grid, axis, cells = planned
    rows = _values(samples.where("shown"), axis, cells, grid, bool(req.smoothing))
    if req.smoothing:
        rows = _smoothed(rows, samples, axis, grid, req)
    return _marked(rows, anchors, axis, cells, grid), grid


def plan_axis(samples: DataFrame, req: Request) -> tuple[Grid | None, DataFrame, DataFrame | None] | None:
    """Grid (None: every distinct x has a slot), slots and cells of a chart; None if nothing can be drawn. A grid on which no
    cell is an envelope is none. More than ``MAX_TAGS`` tag groups of a run's metric are an error."""
    shown = samples.where("shown")
    lo, hi, distinct = shown.agg(F.min("x"), F.max("x"), F.countDistinct("x")).first()
    tagged = samples.where("tag <> ''")
    if not tagged.isEmpty():
        tags = tagged.select(*SERIES).distinct().groupBy("run_id", "metric_name").agg(F.count(F.lit(1)).alias("n"))
        if wide := tags.where(F.col("n") > MAX_TAGS).orderBy("run_id", "metric_name").first():
            raise ValueError(f"{wide.run_id}/{wide.metric_name} has {wide.n} tags, {MAX_TAGS} at most make a chart")
    if lo is None:
        return None
    grid = plan_grid(lo, hi, distinct, req)
    axis, cells = _axis(shown, grid, req)
    if cells is not None and cells.where("envelope").isEmpty():
        grid = None
        axis, cells = _axis(shown, None, req)
    return grid, checkpointed(axis), cells


def _empty(samples: DataFrame, req: Request) -> DataFrame:
    nul = lambda t: F.lit(None).cast(t)
    return samples.limit(0).select(*SERIES, nul("long").alias("slot"), nul("double").alias("x"), *[nul("double").alias(c) for c in ("xr_min", "xr_max", "value", "raw_value", "y_min", "y_max")], nul("int").alias("marker_kind"))


def _axis(shown: DataFrame, grid: Grid | None, req: Request) -> tuple[DataFrame, DataFrame | None]:
    """Slots (slot, x, xr_min, xr_max, cell or null) and, with a grid, its occupied cells (cell, envelope, lo, hi)."""
    none = F.lit(None).cast("double")
    if grid is None:
        slots = shown.select("x").distinct().select("x", none.alias("xr_min"), none.alias("xr_max"), F.lit(None).cast("long").alias("cell"))
        cells = None
    else:
        keyed = shown.withColumn("cell", grid.cell(F.col("x")))
        if req.axis == "step":
            cells = keyed.groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("envelope", grid.wide(F.col("cell")))
        else:
            cells = keyed.groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.countDistinct("x").alias("n")).withColumn("envelope", F.col("n") >= ENVELOPE_POINTS).drop("n")
        cells = checkpointed(cells)
        spread = F.col("hi") > F.col("lo")
        env = cells.where("envelope").select(((F.col("lo") + F.col("hi")) * 0.5).alias("x"), F.when(spread, F.col("lo")).alias("xr_min"), F.when(spread, F.col("hi")).alias("xr_max"), "cell")
        raw = keyed.join(F.broadcast(cells.where("NOT envelope").select("cell")), "cell").select("x").distinct()
        slots = env.unionAll(raw.select("x", none, none, F.lit(None).cast("long")))
    return numbered(slots, ["x"], "slot"), cells


def _placed(rows: DataFrame, axis: DataFrame, cells: DataFrame | None, grid: Grid | None) -> DataFrame:
    """Rows with the slot of their x: its envelope cell's, else its own."""
    exact = axis.where("cell IS NULL").select("x", "slot")
    if grid is None:
        return rows.join(exact, "x").withColumn("env", F.lit(False))
    flags = F.broadcast(cells.select("cell", "envelope"))
    keyed = rows.withColumn("cell", grid.cell(F.col("x"))).join(flags, "cell")
    inside = keyed.where("envelope").join(F.broadcast(axis.where("cell IS NOT NULL").select("cell", "slot")), "cell")
    out = keyed.where("NOT envelope").join(exact, "x")
    cols = [*rows.columns, "slot"]
    return inside.select(*cols, F.lit(True).alias("env")).unionAll(out.select(*cols, F.lit(False).alias("env")))


def _values(shown: DataFrame, axis: DataFrame, cells: DataFrame | None, grid: Grid | None, smoothing: bool) -> DataFrame:
    """One aggregate by (series, slot), partially combined before the shuffle."""
    placed = _placed(shown, axis, cells, grid)
    ok = F.col("kind") == 0
    y = F.when(ok, F.col("y"))
    g = placed.groupBy(*SERIES, "slot", "env").agg(
        F.count_if(ok).alias("n"),
        F.sum(y).alias("total"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
        F.max(F.when(ok, F.struct("step", "y"))).getField("y").alias("last_y"),
        F.min(F.when(ok, F.col("x"))).alias("first_x"),
        F.min(F.when(~ok, F.struct("x", "step", "kind"))).getField("kind").alias("first_kind"),
        F.min(F.when(~ok, F.col("kind"))).alias("least_kind"),
    )
    marker = F.when(F.col("env"), F.col("first_kind")).otherwise(F.col("least_kind"))
    g = g.withColumn("marker_kind", marker.cast("int"))
    mean = F.when(F.col("marker_kind").isNull() & (F.col("n") > 0), F.col("total") / F.col("n"))
    g = g.withColumn("value", F.when(F.col("env"), mean).otherwise(F.col("last_y")))
    if grid is None:
        # bands only where some x holds several values, and then for every series
        dup = g.agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("dup"))
        g = g.crossJoin(F.broadcast(dup)).withColumns({c: F.when(F.col("dup"), F.col(c)) for c in ("y_min", "y_max")}).drop("dup")
    raw = F.when(~F.col("env"), F.col("last_y")) if smoothing else F.lit(None).cast("double")
    return g.select(*SERIES, "slot", "env", "n", "first_x", "value", raw.alias("raw_value"), "y_min", "y_max", "marker_kind")


def _smoothed(rows: DataFrame, samples: DataFrame, axis: DataFrame, grid: Grid | None, req: Request) -> DataFrame:
    s = req.smoothing
    finite = samples.where("kind = 0")
    need = rows.where((F.col("n") > 0) & (~F.col("env") | F.col("marker_kind").isNull())).join(axis.select("slot", "x"), "slot")
    if s.kind != "savgol":
        need = need.where("NOT env OR first_x <= x")
    key = "step" if req.axis == "step" else "x"
    units = None
    if s.kind == "savgol" or req.axis != "step":
        units = median_gap(samples.select(*SERIES, F.col(key).cast("double").alias("g")), "g", SERIES).select(*SERIES, F.col("median").alias("unit"))
    fitted = smooth(finite.select(*SERIES, "x", "y"), need.select(*SERIES, "slot", "x"), SERIES, s, units, grid.floor if grid else Floor())
    return rows.drop("value").join(fitted.select(*SERIES, "slot", "value"), [*SERIES, "slot"], "left")


def _marked(rows: DataFrame, anchors: DataFrame, axis: DataFrame, cells: DataFrame | None, grid: Grid | None) -> DataFrame:
    """Adds kind-4 markers on their anchors' slots (slot 0 without one); a marker of a value in the slot wins."""
    named = anchors.withColumn("x", F.col("anchor"))
    with_x = _placed(named.where("x IS NOT NULL").select(*SERIES, "x"), axis, cells, grid).select(*SERIES, "slot")
    four = with_x.unionAll(named.where("x IS NULL").select(*SERIES, F.lit(0).cast("long"))).distinct().withColumn("four", F.lit(4))
    joined = rows.join(four, [*SERIES, "slot"], "full")
    out = joined.withColumn("marker_kind", F.coalesce("marker_kind", "four"))
    slots = axis.select("slot", "x", "xr_min", "xr_max")
    out = out.join(F.broadcast(slots) if grid else slots, "slot")  # the target bounds a grid's slots; all distinct x have no bound
    return out.select(*SERIES, "slot", "x", "xr_min", "xr_max", "value", "raw_value", "y_min", "y_max", "marker_kind")


def dense(rows: DataFrame) -> DataFrame:
    """Every series on every slot of the chart; nulls are gaps. Only for charts that a target bounds."""
    slots = rows.select("slot", "x").distinct()
    grid = rows.select(*SERIES).distinct().crossJoin(slots)
    return grid.join(rows.drop("x"), [*SERIES, "slot"], "left")


def packed(rows: DataFrame) -> DataFrame:
    """Occupied runs of each series: start, length and the values in order."""
    have = rows.where("value IS NOT NULL")
    island = F.col("slot") - F.row_number().over(Window.partitionBy(*SERIES).orderBy("slot"))
    g = have.withColumn("_i", island).groupBy(*SERIES, "_i").agg(F.min("slot").alias("start"), F.count(F.lit(1)).alias("length"), F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("v"))
    return g.select(*SERIES, "start", "length", F.transform("v", lambda x: x["value"]).alias("values"))


def subset(rows: DataFrame, runs: list[str]) -> DataFrame:
    """A chart of some of the runs: slots nobody of them occupies go, the others are numbered anew."""
    kept = rows.where(F.col("run_id").isin(runs))
    held = kept.where("value IS NOT NULL OR y_min IS NOT NULL OR marker_kind IN (1, 2, 3)").select("slot").distinct()
    new = numbered(held, ["slot"], "new_slot")
    on = kept.join(new, "slot").drop("slot").withColumnRenamed("new_slot", "slot")
    lost = kept.join(new, "slot", "left_anti").where("marker_kind = 4")
    # an anchor's marker whose slot is gone lands on the first slot left
    free = on.where("slot = 0").select(*SERIES, F.lit(True).alias("taken"))
    again = lost.select(*SERIES).distinct().join(free, SERIES, "left").where("taken IS NULL")
    first = on.where("slot = 0").agg(F.min("x").alias("x"), F.min("xr_min").alias("xr_min"), F.min("xr_max").alias("xr_max"))
    nul = lambda c: F.lit(None).cast("double").alias(c)
    landed = again.crossJoin(F.broadcast(first)).select(*SERIES, F.lit(0).cast("long").alias("slot"), "x", "xr_min", "xr_max", nul("value"), nul("raw_value"), nul("y_min"), nul("y_max"), F.lit(4).alias("marker_kind"))
    return on.select(*landed.columns).unionAll(landed)


def hover(rows: DataFrame, slot: int) -> DataFrame:
    """Every series' point at a column, a value or the marker of one that can't be drawn; where it has none there, its nearest
    by x, ties to the earlier."""
    at = rows.where(F.col("slot") == slot).select(F.col("x").alias("xq")).limit(1)
    near = rows.where("value IS NOT NULL OR marker_kind IS NOT NULL").crossJoin(F.broadcast(at)).groupBy(*SERIES).agg(F.min(F.struct(F.abs(F.col("x") - F.col("xq")).alias("far"), "x", "slot", "value", "marker_kind")).alias("n"))
    return near.select(*SERIES, *[F.col(f"n.{c}").alias(c) for c in ("slot", "x", "value", "marker_kind")])


def custom_smoothed(points: DataFrame, req: Request) -> tuple[DataFrame, Grid | None]:
    """A metric's axis: samples are smoothed in step order at their own steps, then placed at their x; envelope slots
    interpolate between a series' neighbouring points and extrapolate at its ends."""
    samples, anchors = prepare(points, req)
    steps, _ = prepare(points, replace(req, axis="step", x_metric="", log_x=False, target=0))
    steps = checkpointed(steps.where("kind = 0"))
    s = req.smoothing
    units = median_gap(steps, "step", SERIES).select(*SERIES, F.col("median").alias("unit")) if s.kind == "savgol" else None
    at = steps.where("shown").select(*SERIES, F.col("step").alias("slot"), "x")
    fitted = smooth(steps.select(*SERIES, "x", "y"), at, SERIES, s, units).select(*SERIES, F.col("slot").alias("step"), F.col("value").alias("smoothed"))
    samples = checkpointed(samples.where("shown").join(fitted, [*SERIES, "step"], "left"))
    planned = plan_axis(samples, req)
    if planned is None:
        return _empty(samples, req), None
    grid, axis, cells = planned
    rows = _values(samples, axis, cells, grid, True)
    exact = _placed(samples.where("kind = 0"), axis, cells, grid).where("NOT env").groupBy(*SERIES, "slot").agg(F.max(F.struct("step", "smoothed")).getField("smoothed").alias("at"))
    want = rows.where("env AND n > 0 AND marker_kind IS NULL").join(axis.select("slot", F.col("x").alias("xq")), "slot").select(*SERIES, "slot", "xq")
    lines = _interpolated(samples.where("kind = 0 AND smoothed IS NOT NULL").select(*SERIES, "x", F.col("smoothed").alias("y")), want)
    rows = rows.drop("value").join(exact, [*SERIES, "slot"], "left").join(lines, [*SERIES, "slot"], "left").withColumn("value", F.coalesce("at", "line")).drop("at", "line")
    return _marked(rows, anchors, axis, cells, grid), grid


def _interpolated(points: DataFrame, slots: DataFrame) -> DataFrame:
    """Piecewise linear through a series' points at slots; beyond the ends the nearest segment goes on."""
    one = points.groupBy(*SERIES, "x").agg(F.max("y").alias("y")).select(*SERIES, F.lit(None).cast("long").alias("slot"), "x", F.struct("x", "y").alias("p"))
    events = one.unionAll(slots.select(*SERIES, "slot", F.col("xq").alias("x"), F.lit(None))).withColumn("late", F.col("slot").isNotNull())
    # each point knows its neighbours, then each slot the points around it
    d = last_before(dealt(events, SERIES, ["x", "late", "slot"]), SERIES, {"b": F.col("p")})
    d = last_before(d, SERIES, {"n": F.col("p")}, backwards=True)
    far = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")) if c == "x" else F.when(F.col("n").isNotNull(), F.col("n.y")).otherwise(F.col("b.y"))
    seg = F.when(F.col("p").isNotNull(), F.struct(F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), far("x").alias("x1"), far("y").alias("y1")))
    d = checkpointed(d.withColumn("s", seg).drop("p", "b", "n"))
    d = last_before(last_before(d, SERIES, {"s_b": F.col("s")}, include=True), SERIES, {"s_n": F.col("s")}, backwards=True)
    at = d.withColumn("g", F.coalesce("s_b", "s_n")).where("late AND g IS NOT NULL")
    slope = (F.col("g.y1") - F.col("g.y0")) / (F.col("g.x1") - F.col("g.x0"))
    return at.select(*SERIES, "slot", F.when(F.col("g.x1").isNull(), F.col("g.y0")).otherwise(F.col("g.y0") + slope * (F.col("x") - F.col("g.x0"))).alias("line"))
