"""Smoothers and grids against direct numpy computations."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions.fit import fit, translated
from runlens.plans.changes import change_set, changed, splice
from runlens.plans.chart import Grid, Request, chart, chart_and_grid, linear_width, prepare
from runlens.plans.smooth import Floor, Smoothing, smooth


def direct(x, y, w, at, degree):
    """Weighted least squares by numpy, centred on ``at``."""
    k = w > 0
    u, y, w = x[k] - at, y[k], w[k]
    scale = max(np.abs(u).max(), 1e-12)
    a = np.stack([(u / scale) ** i for i in range(degree + 1)], 1) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0]


def frame(spark, x, y):
    return spark.createDataFrame([("a", float(i), float(v)) for i, v in zip(x, y, strict=True)], "s string, x double, y double")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.integers(1, 5, 300)).astype(float)
    return x, np.sin(x / 40) * 10 + rng.normal(0, 1, 300)


@pytest.mark.parametrize("degree", [0, 1, 2])
@pytest.mark.parametrize("kind", ["ema", "triangular", "savgol"])
def test_smoother(spark, data, kind, degree):
    x, y = data
    at = x[20::15] + 0.5
    slots = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(at)], "s string, slot long, x double")
    got = {r.slot: r.value for r in smooth(frame(spark, x, y), slots, ["s"], Smoothing(kind, degree, tau=8, window=21), None).collect()}
    for i, q in enumerate(at):
        past = x <= q
        if kind == "ema":
            want = direct(x[past], y[past], np.exp(-(x[past][-1] - x[past]) / 8), q, degree)
        elif kind == "triangular":
            want = direct(x[past], y[past], 1 + x[past] - x[0], q, degree)
        else:
            want = direct(x, y, np.where(np.abs(x - q) < 10.5, (1 - ((x - q) / 10.5) ** 2) ** 2, 0), q, degree)
        assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_ema_on_a_ladder_floor(spark, data):
    x, y = data
    floor = Floor(growth=1 / 8, shift=1.0)
    at = x[30::20]
    slots = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(at)], "s string, slot long, x double")
    got = {r.slot: r.value for r in smooth(frame(spark, x, y), slots, ["s"], Smoothing("ema", 0, tau=5), None, floor).collect()}
    g = 0.5 / 8
    for i, q in enumerate(at):
        past = x[x <= q]
        w = np.array([math.exp(-sum_folds(p, q, 5, g)) for p in past])
        assert got[i] == pytest.approx((w * y[: len(past)]).sum() / w.sum(), rel=1e-6)


def sum_folds(a, b, tau, g):
    """Integral of dx / max(tau, g (x + 1))."""
    t = np.linspace(a, b, 20_001)
    return np.trapezoid(1 / np.maximum(tau, g * (t + 1)), t) if b > a else 0.0


@given(st.floats(0, 1e9), st.floats(1e-3, 1e9), st.integers(1, 2000))
@settings(max_examples=200, deadline=None)
def test_linear_width(lo, span, target):
    w = linear_width(lo, lo + span, target)
    real = (lo + span) - lo
    if real > 0:
        assert math.frexp(w)[0] == 0.5 and w * target >= real and w / 2 * target < real


@pytest.mark.parametrize("grid", [Grid(m=3), Grid(m=0, shift=True), Grid(width=4.0), Grid(m=5, shift=True)])
def test_cells_agree_with_the_driver(spark, grid):
    xs = [1.0, 2.0, 3.0, 3.5, 4.0, 7.999999, 8.0, 1023.0, 1024.0, float(2**48 - 1), float(2**48), 1e12]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", grid.cell(F.col("x")).alias("c"))
    assert {r.x: r.c for r in df.collect()} == {x: grid.cell_of(x) for x in xs}


def points(spark, rows):
    schema = "project_id string, run_id string, metric_name string, tag string, step long, timestamp_ms long, value float, cdn_key string, text_data string, inserted_at timestamp"
    import datetime

    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("p", r, m, tag, s, s * 1000, v, None, None, t) for r, m, tag, s, v in rows], schema)


def test_empty_chart(spark):
    assert chart(points(spark, []), Request(("m",))).count() == 0


def test_marker_keeps_band_and_gaps_value(spark):
    rows = [("r", "m", "", s, float("nan") if s == 50 else float(s)) for s in range(200)]
    got = {r.slot: r for r in chart(points(spark, rows), Request(("m",), target=10)).collect()}
    hit = [r for r in got.values() if r.marker_kind == 1]
    assert len(hit) == 1 and hit[0].value is None and hit[0].y_max is not None


def test_scalar_group_hides_behind_tags(spark):
    rows = [("r", "m", "", 1, 1.0), ("r", "m", "0", 1, 2.0)]
    assert [r.tag for r in chart(points(spark, rows), Request(("m",), target=0)).collect()] == ["0"]


def test_requests_are_checked():
    for bad in (lambda: Request(("m",), axis="odd"), lambda: Request(("m",), axis="metric"), lambda: Smoothing("odd"), lambda: Smoothing("ema", tau=0.0), lambda: Smoothing("ema", tau=float("inf"))):
        with pytest.raises(ValueError):
            bad()
    assert Request(("m",), axis="time", x_metric="other").x_metric == ""
    assert (Smoothing("savgol", 9, window=10**6).degree, Smoothing("savgol", 9, window=1).window, Smoothing("savgol", window=10**6).window) == (2, 3, 4096)
    assert Smoothing("ema", tau=0.5).tau == 0.5


@pytest.mark.parametrize("degree", [0, 1, 2])
def test_fit_of_moments(spark, degree):
    """Random weighted samples, and samples too few for the degree."""
    rng = np.random.default_rng(degree)
    rows = []
    for k in range(40):
        n = 1 + k % 8
        u = rng.choice([-1.0, -0.25, 0.5], n) if k % 3 == 0 else rng.uniform(-1, 1, n)
        w, y, at = rng.uniform(0.1, 2, n), rng.normal(size=n), rng.uniform(-1, 1)
        rows.append((k, u, w, y, at))
    data = [(k, *[float((w * u**i).sum()) for i in range(5)], *[float((w * u**i * y).sum()) for i in range(3)], float(at)) for k, u, w, y, at in rows]
    df = spark.createDataFrame(data, "k long, " + ", ".join(f"m{i} double" for i in range(5)) + ", " + ", ".join(f"s{i} double" for i in range(3)) + ", at double")
    value = fit([F.col(f"m{i}") for i in range(2 * degree + 1)], [F.col(f"s{i}") for i in range(degree + 1)], degree, F.col("at"))
    got = {r.k: r.v for r in df.select("k", value.alias("v")).collect()}
    for k, u, w, y, at in rows:
        d = min(degree, len(np.unique(u)) - 1)
        a = np.stack([u**i for i in range(d + 1)], 1) * np.sqrt(w)[:, None]
        want = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0] @ np.array([at**i for i in range(d + 1)])
        assert got[k] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_translated_moments(spark):
    u, w = np.array([0.3, -0.7, 0.1]), np.array([1.0, 2.0, 0.5])
    m = [F.lit(float((w * u**k).sum())) for k in range(5)]
    (got,) = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(translated(m, F.lit(3.0), F.lit(0.5), F.lit(-2.0)))]).collect()
    assert list(got) == pytest.approx([float((3 * w * (0.5 * u - 2) ** k).sum()) for k in range(5)])


def test_zoom_reaches_the_scan(spark, tmp_path):
    """The step range, widened by what the smoother reads, stands among the scan's pushed filters."""
    rows = [("r", "m", "", s, float(s)) for s in range(500)]
    points(spark, rows).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    for smoothing, low in ((None, 200), (Smoothing("ema", 0, tau=5), 160)):
        samples, _ = prepare(p, Request(("m",), target=1000, steps=(200, 300), smoothing=smoothing))
        plan = samples._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual(step,{low})" in plan and "LessThanOrEqual(step,300)" in plan
        assert samples.where("shown").count() == 101 and samples.count() == 301 - low


def test_tag_groups_are_chosen_in_range(spark):
    rows = [("r", "m", "", s, 1.0) for s in range(10)] + [("r", "m", "a", 50, 2.0)]
    inside = chart(points(spark, rows), Request(("m",), target=0, steps=(0, 9))).collect()
    assert {r.tag for r in inside} == {""} and len(inside) == 10
    assert {r.tag for r in chart(points(spark, rows), Request(("m",), target=0)).collect()} == {"a"}


def test_too_many_tags(spark):
    rows = [("r", "m", f"t{k}", 1, 1.0) for k in range(65)]
    with pytest.raises(ValueError, match="65 tags"):
        chart(points(spark, rows), Request(("m",), target=0))
    assert chart(points(spark, rows), Request(("m",), target=0, tags=("t1", "t2"))).count() == 2


def test_custom_axis_without_envelopes_has_no_bands(spark):
    """Cells of fewer than four distinct x each: the chart passes every x through."""
    rows = [("r", "x", "", s, float(s % 60)) for s in range(90)] + [("r", "m", "", s, float(s)) for s in range(90)]
    got = chart(points(spark, rows), Request(("m",), axis="metric", x_metric="x", target=40, smoothing=Smoothing("ema", 0, tau=2))).collect()
    assert len({r.slot for r in got}) == 60 and all(r.xr_min is None for r in got)


def test_change_sets(spark):
    rows = [("r", "m", "", s, float(s % 7)) for s in range(400)]
    req = Request(("m",), target=20)
    (a, ga), (b, gb) = chart_and_grid(points(spark, rows), req), chart_and_grid(points(spark, rows[:399] + [("r", "m", "", 399, 100.0)]), req)
    (c, gc), (e, ge) = chart_and_grid(points(spark, rows[:150]), req), chart_and_grid(points(spark, rows[:15]), req)
    kinds = [change_set(x, y, g, h).first().kind for x, y, g, h in ((a, a, ga, ga), (a, b, ga, gb), (c, a, gc, ga), (e, c, ge, gc))]
    assert kinds == ["unchanged", "delta", "full", "full"]
    d = change_set(a, b, ga, gb).first()
    assert d.first_slot > 0 and changed(splice(a, b.where(F.col("slot") >= d.first_slot), d.first_slot), b).isEmpty()
