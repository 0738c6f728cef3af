"""Fits with several controls against numpy, and filters, picks and sinks on literals."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrotide.operators import constraints, controls, screening, selection

DAY = datetime.date(2000, 1, 31)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    out = []
    for g in ("a", "b"):
        for t in range(n):
            x1, x2 = rng.gauss(3, 2), rng.gauss(-1, 1)
            d = 0.5 * x1 + rng.gauss(0, 1)
            out.append((g, t, 2 * d + x1 - x2 + rng.gauss(0, 0.5), d, x1, x2, t % 4))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_of(1), "g string, t int, y double, d double, x1 double, x2 double, fold int")


def test_partial_out_equals_least_squares(frame):
    got = controls.partial_out(frame, ["g"], ["y", "d"], ["x1", "x2"]).toPandas().sort_values(["g", "t"])
    for _, part in got.groupby("g"):
        x = np.column_stack([np.ones(len(part)), part["x1"], part["x2"]])
        for c in "yd":
            beta = np.linalg.lstsq(x, part[c].to_numpy(), rcond=None)[0]
            assert np.allclose(part[f"r_{c}"], part[c] - x @ beta)


def test_out_of_fold_residuals_and_effect(frame):
    got = controls.out_of_fold(frame, ["g"], "fold", ["y"], ["x1", "x2"]).toPandas()
    for (_, fold), part in got.groupby(["g", "fold"]):
        rest = got[(got["g"] == part["g"].iloc[0]) & (got["fold"] != fold)]
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(rest)), rest["x1"], rest["x2"]]), rest["y"].to_numpy(), rcond=None)[0]
        assert np.allclose(part["r_y"], part["y"] - np.column_stack([np.ones(len(part)), part["x1"], part["x2"]]) @ beta)
    for r in controls.partially_linear(frame, ["g"], "t", "y", "d", ["x1", "x2"], "fold").collect():
        assert abs(r.beta - 2) < 0.3 and r.n == 60


def test_guards_name_their_reasons(spark):
    rows = [("few", float(i), float(i * i), 1.0) for i in range(4)] + [("flat", float(i), 1.0, 1.0) for i in range(30)] + [("same", float(i % 7), float(i * 2), float(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "g string, y double, a double, b double")
    got = {r.g: (r.used, r.reason) for r in controls.design_guards(frame, ["g"], ["y"], ["a", "b"]).collect()}
    assert got == {"few": (0, "few_rows"), "flat": (0, "no_controls"), "same": (1, None)}
    close = frame.filter("g = 'same'").withColumn("b", F.col("a") + 0.001 * F.col("y"))
    assert controls.design_guards(close, ["g"], ["y"], ["a", "b"], most_condition=100).first().reason == "ill_conditioned"
    assert controls.partial_out(frame.limit(0), ["g"], ["y"], ["a"]).count() == 0


def test_ridge_finds_the_effect_but_no_lead(frame):
    for r in controls.ridge_sanity(frame, ["g"], "t", "y", "d", ["x1", "x2"], ridge=0.01).collect():
        assert abs(r.beta - 2) < 0.3 and abs(r.z) > 10 and abs(r.lead_z) < 4


def test_granger_with_two_lags_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    y = np.r_[0, 0.8 * x[:-1]] + rng.normal(size=50) * 0.3
    rows = [(s, DAY + datetime.timedelta(31 * i), float(v)) for s, z in (("x", x), ("y", y)) for i, v in enumerate(z)]
    pairs = spark.createDataFrame([("x", "y"), ("y", "x")], "cause string, effect string")
    got = {(r.cause, r.date): (r.f, r.r) for r in controls.rolling_granger(spark.createDataFrame(rows, "series string, date date, value double"), pairs, 40, 2).collect()}
    assert len(got) == 2 * 9
    t = np.arange(10, 50)
    own, both = (np.column_stack(c) for c in ([np.ones(40), y[t - 1], y[t - 2]], [np.ones(40), y[t - 1], y[t - 2], x[t - 1], x[t - 2]]))
    ssr = [float(((y[t] - m @ np.linalg.lstsq(m, y[t], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
    last = max(k for k in got if k[0] == "x")
    assert np.isclose(got[last][0], (ssr[0] - ssr[1]) / 2 / (ssr[1] / 35)) and got[last][1] > 0.7
    assert got[last][0] > 10 > got[("y", last[1])][0]


def test_oster_delta_and_stability(spark):
    rows = spark.createDataFrame([(2.0, 1.0, 0.2, 0.6), (0.0, 0.0, 0.5, 0.5), (2.0, 0.0, 0.2, 0.6), (2.0, 1.0, 0.6, 0.2), (1.0, -2.0, 0.1, 0.6)], "b0 double, b1 double, r0 double, r1 double")
    got = [tuple(r) for r in rows.select(selection.oster_delta(*[F.col(c) for c in ("b0", "b1", "r0", "r1")]), selection.stability_ratio(F.col("b0"), F.col("b1"))).collect()]
    want = [(1.0, 0.5), (0.0, None), (None, 0.0), (None, 0.5), (-1.2, 2.0)]
    assert all((a is None and b is None) or abs(a - b) < 1e-12 for x, y in zip(got, want) for a, b in zip(x, y))


def test_weak_instruments_have_wide_sets(spark):
    rng = random.Random(7)
    rows = []
    for g, strength in (("strong", 2.0), ("weak", 0.0)):
        for t in range(120):
            z, e = rng.gauss(0, 1), rng.gauss(0, 1)
            d = strength * z + e
            rows.append((g, t, 1.5 * d + e + rng.gauss(0, 1), d, z))
    frame = spark.createDataFrame(rows, "g string, t int, y double, d double, z double")
    got = {r.g: r for r in selection.anderson_rubin_set(frame, ["g"], "t", "y", "d", "z").collect()}
    assert got["strong"].status == "inside" and got["strong"].lo < 1.5 < got["strong"].hi and got["strong"].hi - got["strong"].lo < 1
    assert got["weak"].status == "edge" or got["weak"].hi - got["weak"].lo > 2


def test_factor_filter_and_groups(spark):
    rows = [("ok", "m", 1, float(i)) for i in range(4)] + [("ok", "m", 2, 1.0)] + [("flat", "m", 1, 1.0)] * 4 + [("holes", "m", 1, None)] * 2 + [("holes", "m", 1, float(i)) for i in range(3)] + [("day", "d", 1, float(i)) for i in range(4)] + [("ok_x", "m", 1, float(i)) for i in range(4)]
    got = selection.factor_panel_filter(spark.createDataFrame(rows, "series string, freq string, lag int, value double"), ["m"], excluded="_x$")
    assert {(r.series, r.lag) for r in got.collect()} == {("ok", 1)} and got.count() == 4
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2, 40))
    panel = {"a": base[0], "b": base[0] + 0.1 * rng.normal(size=40), "c": base[0] - 0.5 * base[1], "e": base[1] * 2, "f": rng.normal(size=40)}
    rows = [(s, DAY + datetime.timedelta(i), float(x)) for s, v in panel.items() for i, x in enumerate(v)]
    got = {r.series: r.group for r in selection.indicator_groups(spark.createDataFrame(rows, "series string, date date, value double"), 0.6).collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["f"] == "f"


def test_representative_draws_spread_over_the_scores(spark):
    rows = [("k", d, DAY + datetime.timedelta(i), d * 10.0 + (i % (d + 2))) for d in range(9) for i in range(12)]
    got = selection.representative_draws(spark.createDataFrame(rows, "g string, draw int, date date, value double"), ["g"], 3, clip=0.0).collect()
    scores = [r.score for r in sorted(got, key=lambda r: r.place)]
    features = selection.draw_features(spark.createDataFrame(rows, "g string, draw int, date date, value double"), ["g"]).toPandas()
    score = features[["mean", "std", "skew", "autocorr1"]].rank(pct=True).mean(axis=1)
    assert len(got) == 3 and np.isclose(scores[0], score.min()) and np.isclose(scores[-1], score.max())
    one = features[features["draw"] == 3].iloc[0]
    import pandas as pd

    values = pd.Series([30.0 + i % 5 for i in range(12)])
    assert np.allclose([one["mean"], one["std"], one["skew"], one["autocorr1"]], [values.mean(), values.std(ddof=0), values.skew(), values.autocorr(1)])


def test_sinks(spark, tmp_path):
    panel = spark.createDataFrame([("a", DAY, 1.23456), ("b", DAY, None)], "series string, date date, value double")
    selection.write_panel(panel, f"{tmp_path}/p", digits=2)
    assert {(r.series, r.value) for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {("a", 1.23), ("b", None)}
    selection.write_panel(panel, f"{tmp_path}/c", form="csv")
    assert {r.value for r in spark.read.option("header", "true").csv(f"{tmp_path}/c").collect()} == {"1.23456", "NA"}
    for batch in ("one", "two"):
        selection.append_results(panel, f"{tmp_path}/r", batch)
    assert spark.read.parquet(f"{tmp_path}/r").groupBy("batch").count().count() == 2
    assert selection.snapshot_id(panel, "date").first()[0] == "20000131_20000131_n2"
    assert selection.snapshot_id(panel.limit(0), "date").first()[0] == "empty"


def test_directional_score_by_hand(spark):
    rows = [("k", 0.8, 0.0), ("k", 0.4, 0.05), ("k", -0.9, 0.09), ("k", 0.9, 0.5)]
    r = screening.directional_score(spark.createDataFrame(rows, "g string, r double, p double"), ["g"]).first()
    # evidence 1 and 0.5 upwards, 0.1 downwards; 4 windows
    assert r.direction == "positive" and r.n == 4 and np.isclose(r.share, 1.5 / 4) and np.isclose(r.strength, (0.8 + 0.2) / 1.5)
    assert np.isclose(r.score, 100 * (1.5 / 4) * (1.0 / 1.5) * 1.5 / 13.5)
    apart = spark.createDataFrame(rows, "g string, r double, p double").groupBy("g").agg(screening.independence().alias("x")).first().x
    assert np.isclose(apart, 100 * 0.15 * 0.25 * 4 / 16)


def test_paths_are_held_to_bounds_order_and_benchmarks(spark):
    def slow(v, target, low, high):
        x = np.clip(v, low, high)
        for _ in range(500):
            gap = target - x.sum()
            free = (x < high) if gap > 0 else (x > low)
            if abs(gap) < 1e-12 or not free.any():
                break
            x = np.clip(np.where(free, x + gap / free.sum(), x), low, high)
        return x

    rng = np.random.default_rng(5)
    for _ in range(200):
        v, goal = rng.normal(3, 3, 4), float(rng.uniform(0, 24))
        got, can = constraints.level_to_sum(v, goal, 0.0, 6.0)
        assert can and np.allclose(got, slow(v, goal, 0.0, 6.0), atol=1e-8)
    assert constraints.level_to_sum(np.array([1.0, 2.0]), 9.0, 0.0, 4.0)[1] is False
    days = [DAY + datetime.timedelta(31 * i) for i in range(6)]
    path = spark.createDataFrame([("a", i // 3, days[i], v) for i, v in enumerate([1.0, 5.0, 3.0, 2.0, 9.0, 4.0])], "series string, block int, date date, value double")
    low = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 100.0)], "series string, block int, target double")
    for priority, order in (("benchmark", 1), ("shape", 0)):
        out = constraints.constraint_enforce(path, low, 0.0, 6.0, "increasing", priority=priority)
        r = constraints.constraint_report(out, low, 0.0, 6.0, "increasing").first()
        assert (r.out_of_bounds, r.infeasible) == (0, 1) and r.out_of_order <= order and r.benchmark_error >= 82
    last = constraints.constraint_enforce(path, low, conversion="last").orderBy("date").collect()
    assert [x.value for x in last] == [1.0, 5.0, 9.0, 2.0, 9.0, 100.0]
