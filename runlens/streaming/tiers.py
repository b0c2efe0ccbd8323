"""Charts answered from tiers: envelope cells of appended points, overlaid by cells that late rows, rewrites and removals touched.

Each batch leaves the rollup of the rows that are new at a series' end, in cells of ``WIDTH`` steps, and, for the cells that its
other rows touched, what the newest versions of all points give there: an overlay, which stands for the cell's earlier parts.
``build`` merges what there is into wider tiers. A chart on a step axis takes the widest tier not wider than its grid; only cells
with newer overlays come from the finest one, and only the ends of a zoomed range from points. All widths are powers of two, so
cells of one tier are whole cells of the next, and merges are exact but for the order in which sums are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_finite, marker_kind
from ..operators.points import SERIES, latest, tag_groups
from ..plans import chart as C
from ..plans.scratch import checkpointed, numbered
from .ingest import WIDTH, classify
from .store import PointStore

CELL = [*SERIES, "cell"]
_SUMS = {"n": F.sum, "total": F.sum, "y_min": F.min, "y_max": F.max, "lo": F.min, "hi": F.max, "rows": F.sum}
_SCHEMA = "project_id string, run_id string, metric_name string, tag string, cell long, n long, total double, y_min double, y_max double, lo long, hi long, rows long, odd struct<step:long,kind:int>"


def cells_of(points: DataFrame, width: int = WIDTH) -> DataFrame:
    """Envelope aggregates of numeric points: of finite values count, sum, least and greatest; of all steps count and bounds; the
    first value that can't be drawn."""
    y = F.col("value").cast("double")
    ok = is_finite(y)
    v = F.when(ok, y)
    return points.where("value IS NOT NULL").groupBy(*SERIES, F.floor(F.col("step") / width).alias("cell")).agg(
        F.count_if(ok).alias("n"), F.sum(v).alias("total"), F.min(v).alias("y_min"), F.max(v).alias("y_max"), F.min("step").alias("lo"), F.max("step").alias("hi"), F.count(F.lit(1)).alias("rows"),
        *_first_odd(F.when(~ok, F.col("step")), marker_kind(y)),
    ).transform(_with_odd)


def widened(cells: DataFrame, factor: int) -> DataFrame:
    sums = [f(c).alias(c) for c, f in _SUMS.items()]
    return cells.groupBy(*SERIES, F.floor(F.col("cell") / factor).alias("cell")).agg(*sums, *_first_odd(F.col("odd.step"), F.col("odd.kind"))).transform(_with_odd)


def _first_odd(step: Column, kind: Column) -> list[Column]:
    """The least step that isn't null and its kind: plain columns, as an aggregate of structs would sort all rows."""
    return [F.min(step).alias("_odd_step"), F.min_by(kind.cast("int"), step).alias("_odd_kind")]


def _with_odd(cells: DataFrame) -> DataFrame:
    odd = F.when(F.col("_odd_step").isNotNull(), F.struct(F.col("_odd_step").alias("step"), F.col("_odd_kind").alias("kind")))
    return cells.withColumn("odd", odd).drop("_odd_step", "_odd_kind")


class Tiers:
    """The tiers of a point store, beside its folders. Batches are numbers that grow."""

    def __init__(self, store: PointStore):
        self.store, self.spark, self.root = store, store.spark, f"{store.root}/tiers"

    def _done(self, name: str) -> list[int]:
        where, fs = self.store._fs(f"tiers/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self.store._fs(f"tiers/{name}/{n}/_SUCCESS")[0]))

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, batch long")
        for b in batches:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{b}").withColumn("batch", F.lit(b).cast("long")))
        return out

    def _put(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{batch}")

    def apply(self, points: DataFrame, batch: int) -> None:
        """Appends a batch to the store and to the tiers; a replay writes the same again."""
        self.store.append(points, batch)
        kept = points.join(self.store.snapshot().purged(), ["project_id", "run_id"], "left_anti")
        marks_schema = "project_id string, run_id string, metric_name string, tag string, high_step long, newest timestamp"
        marks = self._read("marks", marks_schema, [b for b in self._done("marks") if b < batch]).groupBy(*SERIES).agg(F.max("high_step").alias("high_step"), F.max("newest").alias("newest"))
        routed = checkpointed(classify(latest(kept), marks))
        columns = [c.split()[0] for c in _SCHEMA.split(", ")[:-1]] + ["odd"]
        self._put(cells_of(routed.where("route = 'append'")).select(*columns), "parts", batch)
        touched = routed.where("route <> 'append'").select(*SERIES, F.floor(F.col("step") / WIDTH).alias("cell")).distinct()
        every = self.store.snapshot().points().withColumn("cell", F.floor(F.col("step") / WIDTH)).join(touched, CELL, "left_semi").drop("cell")
        # a touched cell that holds nothing any more still hides its parts
        self._put(touched.join(cells_of(latest(every)), CELL, "left").select(*columns), "overlays", batch)
        self._put(kept.groupBy(*SERIES).agg(F.max("step").alias("high_step"), F.max("inserted_at").alias("newest")), "marks", batch)

    def fine(self, mine=lambda df: df) -> DataFrame:
        """The finest tier as it stands. ``mine`` narrows rows by their series."""
        parts, overlays = mine(self._read("parts", _SCHEMA, self._done("parts"))), mine(self._read("overlays", _SCHEMA, self._done("overlays")))
        top = overlays.groupBy(*CELL).agg(F.max("batch").alias("since"))
        live = parts.join(top, CELL, "left").where("since IS NULL OR batch > since").drop("since", "batch")
        newest = overlays.join(top, CELL).where("batch = since").drop("since", "batch")
        return widened(live.unionByName(newest), 1).where("lo IS NOT NULL")

    def build(self, widths: tuple[int, ...] = (64, 1024)) -> None:
        """Merges the finest tier into wider ones, as of the batches that are whole now."""
        if not (done := self._done("parts")):
            return
        cells, at = checkpointed(self.fine()), WIDTH
        for w in sorted(widths):
            cells, at = checkpointed(widened(cells, w // at)), w
            self._put(cells, f"wide={w}", done[-1])

    def catalogue(self) -> dict[int, int]:
        """The last batch in each wider tier."""
        where, fs = self.store._fs("tiers")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        found = {int(n.removeprefix("wide=")): self._done(n) for n in names if n.startswith("wide=")}
        return {w: d[-1] for w, d in found.items() if d}

    def cells(self, width: int, mine=lambda df: df) -> DataFrame:
        """The cells of a grid of that width, from the widest tier that isn't wider."""
        known = self.catalogue()
        w = max((k for k in known if k <= width), default=WIDTH)
        if w == WIDTH:
            return widened(self.fine(mine), width // WIDTH)
        upto, narrow = known[w], w // WIDTH
        key = [*SERIES, F.floor(F.col("cell") / narrow).alias("wide")]
        dirty = mine(self._read("overlays", _SCHEMA, [b for b in self._done("overlays") if b > upto])).select(*key).distinct()
        wide = mine(self.spark.read.schema(_SCHEMA).parquet(f"{self.root}/wide={w}/{upto}")).withColumn("wide", F.col("cell")).join(dirty, [*SERIES, "wide"], "left_anti")
        newer = mine(self._read("parts", _SCHEMA, [b for b in self._done("parts") if b > upto]).drop("batch")).withColumn("wide", F.floor(F.col("cell") / narrow)).join(dirty, [*SERIES, "wide"], "left_anti")
        again = self.fine(mine).withColumn("wide", F.floor(F.col("cell") / narrow)).join(dirty, [*SERIES, "wide"], "left_semi")
        rest = newer.unionByName(again).withColumn("cell", F.col("wide"))
        return widened(wide.unionByName(rest).drop("wide"), width // w)

    def chart(self, project: str, req: C.Request) -> DataFrame:
        """``plans.chart.chart`` of a project's newest points, without reading points where cells are envelopes. Requests that the
        tiers can't answer (other axes, logarithmic or smoothed charts, and charts of so few points that none is merged) go
        to the points."""

        gone = self.store.snapshot().purged()

        def mine(df: DataFrame) -> DataFrame:
            df = df.where((F.col("project_id") == project) & F.col("metric_name").isin(list(req.metrics)))
            df = df.where(F.col("run_id").isin(list(req.runs))) if req.runs else df
            # cells of purged runs stay in the tiers until these are built anew, and are passed over
            return df.join(gone, ["project_id", "run_id"], "left_anti")

        fits = req.axis == "step" and not req.log_x and not req.smoothing and req.target
        if fits:
            ends, inside = self._range(project, req, mine)
            held = tag_groups(inside(self.fine(mine)).unionByName(ends) if req.steps else self.cells(max(self.catalogue(), default=WIDTH), mine), list(req.tags) or None)
            per = held.groupBy(*SERIES).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
            lo, hi, most = per.agg(F.min("lo"), F.max("hi"), F.max("rows")).first()
            width = C.linear_width(float(lo), float(hi), req.target) if lo is not None else 0
            # a series' steps are distinct, so the longest one bounds the chart's distinct steps from below
            if width >= C.ENVELOPE_POINTS and most > req.target:
                grown = widened(inside(self.fine(mine)).unionByName(ends), int(width) // WIDTH) if req.steps else self.cells(int(width), mine)
                return _drawn(checkpointed(tag_groups(grown, list(req.tags) or None)))
        return C.chart(self.store.snapshot().points(project).where(F.col("project_id") == project), req)

    def _range(self, project: str, req: C.Request, mine):
        """Of a zoomed request the ends of its range that are no whole cells, from points, and a filter of the whole cells."""
        if not req.steps:
            return None, lambda df: df
        lo, hi = req.steps
        first, last = -(-lo // WIDTH), (hi + 1) // WIDTH  # whole cells: first to last - 1
        step = F.col("step")
        odd = step.between(lo, min(first * WIDTH - 1, hi)) | step.between(max(last * WIDTH, lo), hi)
        points = mine(self.store.snapshot().points(project)).where(odd)
        return cells_of(latest(points)), lambda df: df.where((F.col("cell") >= first) & (F.col("cell") < last))


def _drawn(cells: DataFrame) -> DataFrame:
    """The long form of a chart whose cells are all envelopes."""
    slots = cells.groupBy("cell").agg(F.min("lo").cast("double").alias("lo"), F.max("hi").cast("double").alias("hi"))
    spread = F.col("hi") > F.col("lo")
    axis = numbered(slots, ["cell"], "slot").select("cell", "slot", ((F.col("lo") + F.col("hi")) * 0.5).alias("x"), F.when(spread, F.col("lo")).alias("xr_min"), F.when(spread, F.col("hi")).alias("xr_max"))
    kind = F.col("odd.kind")
    value = F.when(kind.isNull() & (F.col("n") > 0), F.col("total") / F.col("n"))
    return cells.join(F.broadcast(axis), "cell").select(*C.SERIES, "slot", "x", "xr_min", "xr_max", value.alias("value"), F.lit(None).cast("double").alias("raw_value"), "y_min", "y_max", kind.alias("marker_kind"))
