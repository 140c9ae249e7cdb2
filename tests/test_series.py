"""Numeric pins and chunk invariance of the ordered-series operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.operators import downsample, nearest, recurrence, series, stats
from telemetra.operators.layout import hold_last, order_buckets, running_sum, with_record_index


def test_moving_average_starts_short(logs):
    rec = logs({"a": {"x": [1, 2, 3, 4, 5]}})
    got = series.moving_average(rec, "x", 3).orderBy("idx").collect()
    assert [r.moving_average for r in got] == [1.0, 1.5, 2.0, 3.0, 4.0]


def test_zero_window_copies(logs):
    rec = logs({"a": {"x": [1, 2]}})
    got = series.moving_average(rec, "x", 0).orderBy("idx").collect()
    assert [r.moving_average for r in got] == [1.0, 2.0]


def test_median_removes_spike(logs):
    rec = logs({"a": {"x": [1, 1, 100, 1, 1]}})
    got = series.median_filter(rec, "x", 3).orderBy("idx").collect()
    assert [r.median_filter for r in got] == [1.0, 1.0, 1.0, 1.0, 1.0]


def test_ema_pin(logs):
    rec = logs({"a": {"x": [0, 10, 10]}})
    got = recurrence.exponential_moving_average(rec, "x", 0.5).orderBy("idx").collect()
    assert [r.ema for r in got] == [0.0, 5.0, 7.5]


@pytest.mark.parametrize("alpha", [0.0, 1.5])
def test_ema_alpha_range(logs, alpha):
    with pytest.raises(ValueError):
        recurrence.exponential_moving_average(logs({"a": {"x": [1, 2]}}), "x", alpha)


def test_time_derivative_of_square(logs):
    rec = logs({"a": {"t": [0, 1, 2, 3, 4], "x": [0, 1, 4, 9, 16]}})
    got = series.time_derivative(rec, "x").orderBy("idx").collect()
    assert [r.derivative for r in got] == [1.0, 2.0, 4.0, 6.0, 7.0]


def test_derivative_with_equal_times_and_single_record(logs):
    rec = logs({"a": {"t": [0, 0, 0], "x": [1, 5, 9]}, "b": {"t": [0], "x": [3]}})
    got = series.time_derivative(rec, "x").collect()
    assert {r.derivative for r in got} == {0.0}
    single = series.sample_derivative(rec, "x").filter("log_id = 'b'").collect()
    assert single[0].derivative == 0.0


def wave(n, seed=7):
    rng = np.random.default_rng(seed)
    return (np.sin(np.arange(n) / 9) * 20 + rng.normal(0, 6, n)).tolist()


@pytest.mark.parametrize("rows", [13])
def test_chunk_size_does_not_matter(logs, rows):
    rec = logs({"a": {"x": wave(300)}, "b": {"x": wave(41, 3)}}).repartition(5)
    whole = {
        "ma": series.moving_average(rec, "x", 6, "y"),
        "median": series.median_filter(rec, "x", 5, "y"),
        "rate": series.time_derivative(rec, "x", "y"),
        "ema": recurrence.exponential_moving_average(rec, "x", 0.1, "y"),
        "drift": recurrence.drift_flags(rec, "x", 1.0, 30.0, out="y"),
        "low": recurrence.butterworth_filtfilt(rec, "x", 0.1, 4, out="y"),
        "high": recurrence.butterworth_filtfilt(rec, "x", 0.2, 3, True, "y"),
        "shift": nearest.time_shift(rec, {"y": "x"}, -0.55),
        "index": series.index_shift(rec, {"y": ("x", -5)}),
    }
    cut = {
        "ma": series.moving_average(rec, "x", 6, "y", rows=rows),
        "median": series.median_filter(rec, "x", 5, "y", rows=rows),
        "rate": series.time_derivative(rec, "x", "y", rows=rows),
        "ema": recurrence.exponential_moving_average(rec, "x", 0.1, "y", rows=rows),
        "drift": recurrence.drift_flags(rec, "x", 1.0, 30.0, out="y", rows=rows),
        "low": recurrence.butterworth_filtfilt(rec, "x", 0.1, 4, out="y", rows=rows),
        "high": recurrence.butterworth_filtfilt(rec, "x", 0.2, 3, True, "y", rows=rows),
        "shift": nearest.time_shift(rec, {"y": "x"}, -0.55, rows=rows),
        "index": series.index_shift(rec, {"y": ("x", -5)}, rows=rows),
    }
    for name in whole:
        a = {(r.log_id, r.idx): r.y for r in whole[name].select("log_id", "idx", "y").collect()}
        b = {(r.log_id, r.idx): r.y for r in cut[name].select("log_id", "idx", "y").collect()}
        assert len(a) == 341 and a.keys() == b.keys(), name
        worst = max(abs(a[k] - b[k]) for k in a)
        assert worst < 1e-9, (name, worst)


def test_chunks_of_many_logs_move_together(spark, monkeypatch):
    """No Python call for a single chunk; blocks of maps; logs without an id."""
    monkeypatch.setattr(recurrence, "MAPS_PER_BLOCK", 3)
    rows = [(log, i, float(v)) for log, seed in ((None, 1), (1, 2), (2, 3)) for i, v in enumerate(wave(150 + seed, seed))]
    rec = spark.createDataFrame(rows, "log_id long, idx long, x double").repartition(4)
    sized = rec.join(rec.groupBy("log_id").count().withColumnRenamed("count", "n").withColumnRenamed("log_id", "l"),
                     F.col("log_id").eqNullSafe(F.col("l"))).drop("l")
    for build in (
        lambda rows: recurrence.exponential_moving_average(sized, "x", 0.1, "y", rows=rows),
        lambda rows: recurrence.butterworth_filtfilt(sized, "x", 0.1, 3, out="y", rows=rows),
        lambda rows: recurrence.drift_flags(sized, "x", 0.5, 3.0, out="y", rows=rows),
    ):
        cut, whole = build(13), build(1 << 18)
        assert "GroupsInArrow" not in cut._jdf.queryExecution().toString()
        a, b = ({(r.log_id, r.idx): r.y for r in found.collect()} for found in (cut, whole))
        assert a.keys() == b.keys() and len(a) >= 305
        assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def plain_drift(x, k, h):
    base = np.mean(x[: max(int(len(x) * 0.1), 10)])
    up = down = 0.0
    flags = []
    for v in x:
        up, down = max(up + v - base - k, 0), max(down - v + base - k, 0)
        flags.append(1.0 if up > h else -1.0 if down > h else 0.0)
        up, down = (0.0 if up > h else up), (0.0 if down > h else down)
    return flags


@pytest.mark.parametrize("k,h", [(0.5, 3.0), (0.0, 40.0), (0.1, 500.0)])
def test_drift_matches_plain_loop(logs, k, h):
    x = wave(400, 11)
    rec = logs({"a": {"x": x}})
    got = recurrence.drift_flags(rec, "x", k, h, rows=13).orderBy("idx").collect()
    assert [r.drift for r in got] == plain_drift(np.array(x), k, h)


def test_drift_step_is_flagged_and_stable_is_not(logs):
    rec = logs({"a": {"x": [0.0] * 100 + [10.0] * 100}, "b": {"x": [0.5] * 200}})
    got = recurrence.drift_flags(rec, "x").filter("drift != 0").select("log_id").distinct().collect()
    assert [r.log_id for r in got] == ["a"]


def plain_filtfilt(x, sections):
    pad = min(6 * len(sections), len(x) - 1)
    x = np.array(x)
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -2 - pad : -1]]
    for _ in range(2):
        first = ext[0]
        for b0, b1, b2, a1, a2 in sections:
            z2 = (b2 - a2) * first
            z1 = (b1 - a1) * first + z2
            y = []
            for v in ext:
                o = b0 * v + z1
                z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
                y.append(o)
            ext = np.array(y)
        ext = ext[::-1]
    return ext[pad : pad + len(x)]


@pytest.mark.parametrize("order,high", [(1, False), (2, True), (3, True), (4, False), (8, False)])
def test_filter_matches_plain_loop(logs, order, high):
    x = wave(120, order)
    sections = recurrence.butterworth_sections(0.12, order, high)
    got = recurrence.butterworth_filtfilt(
        logs({"a": {"x": x}}), "x", 0.12, order, high, rows=60
    ).orderBy("idx").collect()
    assert np.allclose([r.filtered for r in got], plain_filtfilt(x, sections), atol=1e-8)


def test_filter_keeps_constant_and_short_logs(logs):
    rec = logs({"a": {"x": [5.0] * 50}, "b": {"x": [3.0] * 4}, "c": {"x": [2.0]}})
    got = recurrence.butterworth_filtfilt(rec, "x", 0.1, 4).collect()
    assert len(got) == 55
    for r in got:
        assert math.isclose(r.filtered, {"a": 5.0, "b": 3.0, "c": 2.0}[r.log_id], abs_tol=1e-6)


def test_filter_zeroes_non_finite(logs):
    rec = logs({"a": {"x": [float("nan"), float("inf")] + [0.0] * 20}})
    got = recurrence.butterworth_filtfilt(rec, "x", 0.1, 2).collect()
    assert all(r.filtered == 0.0 for r in got)


def gain(sections, cutoff):
    z = np.exp(-2j * np.pi * cutoff)
    h = 1
    for b0, b1, b2, a1, a2 in sections:
        h *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return abs(h)


def test_cutoff_gain():
    for order in (1, 2, 4, 6, 8):
        assert math.isclose(gain(recurrence.butterworth_sections(0.1, order), 0.1), 0.5**0.5, rel_tol=1e-9)
    for order, expected in ((3, 0.4082), (5, 0.3162), (7, 0.2673)):
        assert math.isclose(gain(recurrence.butterworth_sections(0.1, order), 0.1), expected, abs_tol=1e-4)
        book = recurrence.butterworth_sections(0.1, order, textbook=True)
        assert math.isclose(gain(book, 0.1), 0.5**0.5, rel_tol=1e-9)


def test_index_shift_clamps(logs):
    rec = logs({"a": {"x": [1, 2, 3]}})
    out = series.index_shift(rec, {"back": ("x", -100), "ahead": ("x", 100)}, rows=8).collect()
    assert {r.back for r in out} == {1.0} and {r.ahead for r in out} == {3.0}


def test_nearest_pins(spark, logs):
    rec = logs({"a": {"t": [0.0, 0.1, 0.2, 0.3], "x": [0, 1, 2, 3]}})
    asked = spark.createDataFrame(
        [("a", q) for q in (-1.0, 0.15, 0.16, 0.1, 9.0)], "log_id string, at double"
    )
    early = nearest.nearest_record(asked, rec, "at", ["x"], "earlier").collect()
    late = nearest.nearest_record(asked, rec, "at", ["x"], "later").collect()
    # 0.15 is not quite half way in binary: the distances decide, then the tie rule.
    assert {r["at"]: r.near_idx for r in early} == {-1.0: 0, 0.15: 1, 0.16: 2, 0.1: 1, 9.0: 3}
    exact = spark.createDataFrame([("a", 0.5)], "log_id string, at double")
    even = logs({"a": {"t": [0.0, 1.0], "x": [0, 1]}})
    assert nearest.nearest_record(exact, even, "at", ["x"], "earlier").first().near_idx == 0
    assert nearest.nearest_record(exact, even, "at", ["x"], "later").first().near_idx == 1
    assert {r["at"]: r.near_idx for r in late}[9.0] == 3


@pytest.mark.parametrize("rows", [3, 1000])
def test_nearest_against_brute_force(spark, logs, rows):
    rng = np.random.default_rng(5)
    t = np.sort(np.round(rng.uniform(0, 30, 90), 1)).tolist() + [5000.0]
    rec = logs({"a": {"t": t, "x": range(91)}})
    asks = [float(q) for q in np.round(rng.uniform(-5, 40, 80), 2)] + [2515.0, 1e9]
    df = spark.createDataFrame([("a", q) for q in asks], "log_id string, at double")
    got = {r["at"]: r.near_idx for r in nearest.nearest_record(df, rec, "at", ["x"], rows=rows).collect()}
    for q in asks:
        nxt = int(np.searchsorted(t, q, "left"))
        prev = nxt - 1
        if nxt == len(t) or (prev >= 0 and abs(q - t[prev]) <= abs(t[nxt] - q)):
            want = prev
        else:
            want = nxt
        assert got[q] == want, q


def test_merge_rates(spark):
    points = spark.createDataFrame(
        [("a", "x", 1.0, 10.0), ("a", "x", 3.0, 30.0), ("a", "y", 2.0, 5.0)],
        "log_id string, channel string, t double, value double",
    )
    got = nearest.merge_rates(points, ["x", "y", "z"]).orderBy("idx").collect()
    assert [(r.t, r.x, r.y, r.z) for r in got] == [
        (0.0, 10.0, 5.0, 0.0), (1.0, 10.0, 5.0, 0.0), (2.0, 30.0, 5.0, 0.0),
    ]
    assert nearest.merge_rates(points, ["x"], max_records=2).count() == 2


def test_plausible_points(spark):
    points = spark.createDataFrame(
        [(-1.0, 1.0), (1e5, 1.0), (0.0, float("nan")), (0.0, 1e10), (99999.0, -9.9e9)],
        "t double, value double",
    )
    assert [r.t for r in nearest.plausible_points(points).collect()] == [99999.0]


def test_record_index_with_outlier_times_and_ties(spark):
    rows = [("hot", float(i % 50), i) for i in range(3000)] + [("hot", 1e12, 9999), ("cold", 1.0, 1)]
    df = spark.createDataFrame(rows, "log_id string, clock double, tie long").repartition(7)
    got = with_record_index(df, ["clock", "tie"], rows=100, total="n")
    hot = got.filter("log_id = 'hot'").orderBy("idx").collect()
    assert [r.idx for r in hot] == list(range(3001))
    assert [(r.clock, r.tie) for r in hot] == sorted((r.clock, r.tie) for r in hot)
    assert {r.n for r in hot} == {3001}
    # Equal order values: the tie column cuts them into many buckets.
    same = spark.createDataFrame([("hot", 5.0, i) for i in range(1000)], "log_id string, clock double, tie long")
    edges = order_buckets(same, F.col("clock"), rows=100, tie=F.col("tie"))
    parts = edges.assign(same, F.col("clock"), "b", F.col("tie")).groupBy("b").count().collect()
    assert len(parts) == 10 and max(r["count"] for r in parts) == 100
    assert edges.every("b").count() >= 10


def test_hold_and_running_sum_over_chunks(logs):
    cells = [None, None, 4, None, 5, None, None, None, 6, None]
    rec = logs({"a": {"x": cells}})
    held = hold_last(rec, ["x"], rows=3, start=0.0).orderBy("idx").collect()
    assert [r.x for r in held] == [0, 0, 4, 4, 5, 5, 5, 5, 6, 6]
    total = running_sum(logs({"a": {"x": [1] * 10}}), "x", "s", rows=3).orderBy("idx").collect()
    assert [r.s for r in total] == list(range(1, 11))


def test_clock_unwrap(spark):
    raw = [10, 60000, 65000, 5000, 40000, 100, 90]
    df = spark.createDataFrame([("a", i, r) for i, r in enumerate(raw)], "log_id string, idx long, raw_ts long")
    got = series.unwrap_clock(df, rows=2).orderBy("idx").collect()
    turns = [0, 0, 0, 1, 1, 2, 2]
    assert np.allclose([r.t for r in got], [r / 1000 + 65.536 * w for r, w in zip(raw, turns)])


def plain_lttb(t, v, target, canonical):
    n = len(t)
    if n <= target or target < 3:
        return list(range(n))
    size = (n - 2) / (target - 2)
    lead = 0 if canonical else 1
    out, a = [0], 0
    for i in range(target - 2):
        lo = int((i + lead) * size) + 1
        hi = min(int((i + lead + 1) * size) + 1, n - 1)
        end = min(int((i + lead + 2) * size) + 1, n)
        ct, cv = (np.mean(t[hi:end]), np.mean(v[hi:end])) if hi < end else (t[-1], v[-1])
        best, area = lo, -1.0
        for j in range(lo, hi):
            s = abs((t[a] - ct) * (v[j] - v[a]) - (t[a] - t[j]) * (cv - v[a]))
            if s > area:
                best, area = j, s
        out.append(best)
        a = best
    return [*out, n - 1]


@pytest.mark.parametrize(
    "n,target,canonical",
    [(10, 20, False), (50, 2, False), (500, 20, False), (2001, 10, False), (1999, 12, True), (1500, 1499, False)],
)
def test_lttb_matches_plain_scan(logs, n, target, canonical):
    v = np.round(wave(n, n), 0).tolist()
    v[100:160] = [3.0] * len(v[100:160])
    rec = logs({"a": {"x": v}})
    got = downsample.lttb(rec, "x", target, rows=150, canonical=canonical).orderBy("pos").collect()
    want = plain_lttb(np.arange(n) / 10, np.array(v), target, canonical)
    assert [r.idx for r in got] == want


@pytest.mark.parametrize("target, canonical", [(9, False), (9, True), (200, False), (3, False)])
@pytest.mark.parametrize("rows", [150, 20])
def test_lttb_of_a_smooth_log_by_maps(logs, target, canonical, rows):
    """Every record of t squared is a corner; maps lead from bucket to bucket, also joined ones."""
    v = [(i / 10) ** 2 for i in range(2000)]
    w = [float(np.sin(i)) for i in range(700)]
    noise = np.random.default_rng(3).integers(0, 5, 1300).astype(float).tolist()
    data = {"a": v, "b": w, "c": v[:120], "d": noise}
    got = downsample.lttb(logs({k: {"x": x} for k, x in data.items()}), "x", target, rows=rows, canonical=canonical).collect()
    for log, x in data.items():
        found = [(r.pos, r.idx) for r in sorted((r for r in got if r.log_id == log), key=lambda r: r.pos)]
        want = list(range(len(x))) if len(x) <= target else plain_lttb(np.arange(len(x)) / 10, np.array(x), target, canonical)
        assert found == list(enumerate(want))


def test_maps_are_joined_in_rounds(spark, monkeypatch):
    """The chain through 100 buckets takes as many rounds as doubling needs, and equals plain steps."""
    rng = np.random.default_rng(5)
    buckets, corners = 100, 7
    step = rng.integers(0, corners, (buckets, corners))
    rows = [
        ("a", s, 0 if s < 0 else 1 + s * corners + a, 1 + (s + 1) * corners + int(step[s + 1, a]))
        for s in range(-1, buckets - 1) for a in range(1 if s < 0 else corners)
    ]
    maps = spark.createDataFrame(rows, "log_id string, _slot long, a long, b long")
    begin = spark.createDataFrame([("a", -1, 0)], "log_id string, _slot long, idx long")
    written = []
    keep = downsample.materialise
    monkeypatch.setattr(downsample, "materialise", lambda df, label: written.append(label) or keep(df, label))
    got = {r["_slot"]: r["idx"] for r in downsample._chased(maps, begin, ["log_id"], 10).collect()}
    want, at = {-1: 0}, 0
    for s in range(buckets):
        at = 1 + s * corners + int(step[s, (at - 1) % corners if s else 0])
        want[s] = at
    assert got == want and written.count("maps") <= 9 and written.count("chain") <= 9
    few = {r["_slot"]: r["idx"] for r in downsample._chased(maps, begin, ["log_id"], 10_000).collect()}
    assert few == want


def test_largest_triangle_by_slope():
    rng = np.random.default_rng(7)
    for turn in range(400):
        m = int(rng.integers(1, 60))
        t = 10 + (np.sort(rng.integers(0, 2 * m, m)) / 1.0 if turn % 2 else np.arange(m) / 10)
        v = [rng.integers(0, 6, m) / 1.0, t**2, np.sin(t), np.full(m, 3.0)][turn % 4].copy()
        if turn % 7 == 0:
            v[rng.integers(0, m, 3)] = np.nan
        p = np.sort(rng.uniform(0, 10, 9)), rng.normal(size=9)
        centre = t[-1] + 1.5, float(rng.normal())
        assert downsample._best_on_hull(p, centre, t, v).tolist() == downsample._best(p, centre, t, v).tolist()


def test_normalise_constant(logs):
    rec = logs({"a": {"x": [4, 4]}, "b": {"x": [0, 2]}})
    got = {(r.log_id, r.idx): r.normal for r in series.normalise(rec, "x").collect()}
    assert got == {("a", 0): 0.5, ("a", 1): 0.5, ("b", 0): 0.0, ("b", 1): 1.0}


def test_describe_and_correlation(logs):
    rec = logs({"a": {"x": [1, 2, 3, 4, 5], "y": [2, 4, 6, 8, 10], "z": [7, 7, 7, 7, 7]}})
    d = stats.describe(rec, "x").first()
    assert (d["count"], d["mean"], d["median"], d["min"], d["max"], d["range"]) == (5, 3, 3, 1, 5, 4)
    assert math.isclose(d["stdev"], 2.5**0.5)
    assert math.isclose(stats.linear_fit(rec, "x", "y").first().r, 1.0)
    flat = stats.linear_fit(rec, "z", "x").first()
    assert (flat.r, flat.slope, flat.intercept) == (0.0, 0.0, 3.0)
    one = stats.describe(logs({"a": {"x": [9]}}), "x").first()
    assert (one["stdev"], one["median"]) == (0.0, 9.0)


@pytest.mark.parametrize("rows", [2, 5, 100])
def test_median_paths_agree(logs, rows):
    data = {k: {"x": [float(v) for v in np.random.default_rng(i).integers(0, 9, 11 + i)]} for i, k in enumerate("abcd")}
    got = {r.log_id: r.median for r in stats.exact_median(logs(data), "x", rows=rows).collect()}
    assert got == {k: float(np.median(c["x"])) for k, c in data.items()}


def test_channel_statistics_ignore_non_finite(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "x", 3.0), ("a", "x", float("nan")), ("a", "y", float("inf"))],
        "log_id string, channel string, value double",
    )
    got = {r.channel: r for r in stats.channel_statistics(df).collect()}
    assert (got["x"].mean, got["x"].stdev, got["x"].range) == (2.0, 1.0, 2.0)
    assert (got["y"].mean, got["y"].max) == (0.0, 0.0)


def test_has_data_threshold(spark):
    df = spark.createDataFrame(
        [("a", "x", 1e-4), ("a", "y", -1.1e-4), ("a", "z", float("nan"))],
        "log_id string, channel string, value double",
    )
    assert {r.channel: r.has_data for r in stats.has_data(df).collect()} == {"x": False, "y": True, "z": False}


def test_extremes_take_first_minimum_and_last_maximum(logs):
    rec = logs({"a": {"x": [5, 1, 9, 1, 9, float("inf")]}})
    r = stats.extreme_records(rec, "x").first()
    assert (r.min_idx, r.max_idx) == (1, 4)


def test_view_windows(spark):
    base = spark.createDataFrame([("a", 0.0, 100.0)], "log_id string, t_first double, t_last double")

    def bounds(*args):
        r = series.slice_bounds(base, *args).first()
        return r.t_low, r.t_high

    assert bounds("cursor", 20.0, 5.0) == (0.0, 15.0)
    assert bounds("jump", 20.0, 5.0) == (0.0, 20.0)
    assert bounds("jump", 20.0, 98.0) == (80.0, 100.0)
    assert bounds("start", 30.0) == (0.0, 30.0)
    assert bounds("start", 300.0) == (0.0, 100.0)


def test_result_does_not_depend_on_input_order(logs):
    rec = logs({"a": {"x": wave(200)}})
    a = recurrence.exponential_moving_average(rec.orderBy(F.rand(1)), "x", rows=30).orderBy("idx").collect()
    b = recurrence.exponential_moving_average(rec.repartition(9), "x", rows=30).orderBy("idx").collect()
    assert a == b


def test_missing_and_nan_axis_values(spark):
    from telemetra.operators.binning import density_grid, hist2d

    nan = float("nan")
    rows = [("a", 0, 0.0, 0.0, 0.0), ("a", 1, 1.0, 8.0, 8.0), ("a", 2, 2.0, None, 4.0),
            ("a", 3, 3.0, 4.0, None), ("a", 4, 4.0, nan, 8.0)]
    table = spark.createDataFrame(rows, "log_id string, idx long, t double, x double, y double")
    got = {(r["y_bin"], r["x_bin"]): r["hits"] for r in hist2d(table, "x", "y", columns=8, rows=8).collect()}
    assert got == {(0, 0): 1, (7, 7): 1, (7, 0): 1}
    grid = density_grid(table, "x", "y", bins=8)
    assert sum(r["hits"] for r in grid.collect()) == 3


def test_nan_area_never_wins(spark, logs):
    import numpy as np

    from telemetra.operators import downsample

    v = np.array([((k * 7) % 11) / 3 for k in range(30)])
    v[[12, 20]] = np.nan
    corners = downsample._corners(np.arange(8.0), v[9:17], np.arange(9, 17))
    assert 3 not in corners and 0 in corners


def nearest_plain(times, at, tie):
    """Index of the nearest of sorted times; an equal time is answered by its first record."""
    before = [i for i, t in enumerate(times) if t < at]
    after = [i for i, t in enumerate(times) if t >= at]
    if not before or not after:
        return before[-1] if before else after[0]
    back, ahead = at - times[before[-1]], times[after[0]] - at
    return before[-1] if back < ahead or (back == ahead and tie == "earlier") else after[0]


@pytest.mark.parametrize("tie", ["earlier", "later"])
def test_nearest_with_many_questions_at_one_time(spark, tie):
    """A time that many ask for, and one that many records share, are cut; the answers stay."""
    rng = np.random.default_rng(4)
    times = np.sort(np.r_[rng.integers(0, 60, 150), [30] * 120, [10.5] * 3]).astype(float)
    ats = np.r_[rng.integers(-5, 70, 200) / 1.0, [30.0] * 300, [30.2] * 400, [-9.0] * 200].round(2)
    records = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate(times)], "log_id string, idx long, t double")
    asked = spark.createDataFrame([("a", k, float(t)) for k, t in enumerate(ats)], "log_id string, qid long, at double")
    for rows in (40, 1 << 18):
        got = nearest.nearest_record(asked, records, "at", [], tie, rows=rows)
        found = {r["qid"]: r["near_idx"] for r in got.collect()}
        assert found == {k: nearest_plain(times.tolist(), t, tie) for k, t in enumerate(ats)}
    series = records.selectExpr("log_id", "t AS _x", "1 AS _kind", "idx AS _i", "struct(t, idx AS i) AS _d").unionByName(
        asked.selectExpr("log_id", "at AS _x", "0 AS _kind", "struct(qid, at) AS _q"), allowMissingColumns=True
    )
    sizes = series.groupBy("log_id").agg(F.count("*").alias("_rows"), F.sum("_kind").alias("_facts"))
    cut = nearest._bucketed(series, sizes, ["log_id"], 40)
    assert cut.groupBy("_b").count().agg(F.max("count")).first()[0] <= 200


def test_nearest_is_one_shuffle_and_one_sort(spark, logs):
    rec = logs({"a": {"x": range(20)}})
    out = nearest.time_shift(rec, {"y": "x"}, 0.3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_medians_of_ranges():
    rng = np.random.default_rng(2)
    for turn in range(200):
        n = int(rng.integers(1, 60))
        x = rng.integers(0, 9, n).astype(float) if turn % 2 else rng.normal(size=n)
        if turn % 5 == 0:
            x[rng.integers(0, n)] = np.inf
        low = rng.integers(0, n, 30)
        high = np.minimum(low + rng.integers(1, 40, 30), n)
        want = [np.median(x[a:b]) for a, b in zip(low, high)]
        assert np.array_equal(series.window_medians(x, low, high), want, equal_nan=True)


@pytest.mark.parametrize("rows", [1 << 18, 100])
def test_wide_median_with_gaps(logs, rows):
    x = [None if i % 7 == 3 else float((i * 37) % 101) for i in range(900)]
    x[400:640] = [None] * 240
    rec = logs({"a": {"x": x, "z": range(900)}, "b": {"x": x[:90], "z": range(90)}, "c": {"x": [5.0], "z": [1]}})
    got = series.median_filter(rec, "x", 99, rows=rows)
    assert got.columns == [*rec.columns, "median_filter"]
    found = {(r.log_id, r.idx): (r.z, r.median_filter) for r in got.collect()}
    for log, cells in (("a", x), ("b", x[:90]), ("c", [5.0])):
        for i in range(len(cells)):
            near = [v for v in cells[max(i - 49, 0) : i + 50] if v is not None]
            assert found[log, i] == ((1 if log == "c" else i), float(np.median(near)) if near else None)


@pytest.mark.parametrize("window,rows", [(64, 64), (65, 64), (127, 64), (128, 64), (129, 64), (300, 64), (70, 500), (9, 8), (2000, 64)])
def test_long_average_meets_the_frame(logs, window, rows):
    x = [None if i % 11 == 4 else float(i % 17) for i in range(700)]
    x[200], x[333] = float("nan"), float("inf")
    rec = logs({"a": {"x": x}, "b": {"x": x[:50]}, "c": {"x": [None]}})
    whole = series.halo_windows(rec, {"y": lambda w: F.avg("x").over(w.rowsBetween(-(window - 1), 0))}, before=window - 1)
    want = {(r.log_id, r.idx): r.y for r in whole.collect()}
    got = {(r.log_id, r.idx): r.y for r in series.moving_average(rec, "x", window, "y", rows=rows).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        same = got[k] is None if v is None else np.isclose(got[k], v, rtol=1e-12, atol=0, equal_nan=True)
        assert same, (k, v, got[k])


def test_groups_are_cut_at_batches():
    import pyarrow as pa

    from telemetra.operators.layout import whole_groups

    keys = [None, None, 1, 1, 1, 2, 3, 3, None]
    for size in (1, 2, 4, 9):
        table = pa.table({"k": pa.array(keys, pa.int64()), "v": pa.array(range(9))})
        parts = list(whole_groups(iter(table.to_batches(max_chunksize=size)), ["k"]))
        groups = [t.column("v").to_pylist()[a:b] for t, at in parts for a, b in zip(at[:-1], at[1:])]
        assert groups == [[0, 1], [2, 3, 4], [5], [6, 7], [8]]


def test_merged_rates_of_short_and_long_logs(spark):
    rng = np.random.default_rng(12)
    rows = []
    for log in ("a", "b"):
        for c, step in (("x", 3), ("y", 7), ("z", 11)):
            for i in range(0, 200, step):
                if not (log == "b" and c == "z"):
                    rows.append((log, c, 5.0 + i / 10, float(rng.integers(0, 9)), i))
    points = spark.createDataFrame(rows, "log_id string, channel string, t double, value double, seq long").repartition(4)
    for cap in (None, 20):
        one, many = (
            sorted(map(tuple, nearest.merge_rates(points, ["x", "y", "z"], rows=r, max_records=cap).select("log_id", "idx", "t", "x", "y", "z").collect()))
            for r in (1 << 18, 13)
        )
        assert one == many and len(one) == (40 if cap else len(one)) and one[0][2] == 0.0
        assert all(r[5] == 0.0 for r in one if r[0] == "b")
