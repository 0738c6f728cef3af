"""Disaggregation by an indicator against least squares by brute force, and the choice of methods on literals."""

import datetime
import math
import random

import numpy as np
import pytest

from macrotide.operators import disaggregation as dis


def day(k):
    return datetime.date(2000 + k // 12, k % 12 + 1, 1)


def tables(spark, series):
    """low and high tables of {series: (totals, indicator)}; a None indicator value is left out."""
    low = [(s, b, t) for s, (totals, _) in series.items() for b, t in enumerate(totals)]
    high = [(s, k // 3, day(k), z) for s, (_, zs) in series.items() for k, z in enumerate(zs) if z is not None]
    return spark.createDataFrame(low, "series string, block int, total double"), spark.createDataFrame(high, "series string, block int, date date, indicator double")


def sample(seed=1, blocks=10):
    rng = random.Random(seed)
    z = [5 + rng.gauss(0, 1) for _ in range(3 * blocks)]
    return [2 * sum(z[3 * b : 3 * b + 3]) + rng.gauss(0, 1) for b in range(blocks)], z


def paths(df):
    out = {}
    for r in df.orderBy("series", "date").collect():
        out.setdefault(r.series, []).append(r.path)
    return out


def test_proportional_is_the_least_squares_under_the_totals(spark):
    totals, z = sample()
    low, high = tables(spark, {"a": (totals, z), "neg": ([-1.0, 2.0], [1.0] * 6), "gap": ([3.0, 6.0], [1.0] * 5 + [None])})
    rows = dis.denton_proportional(low, high, 3)
    got = paths(rows)
    n, meets = len(z), np.kron(np.eye(10), np.ones(3)) * z
    change = np.diff(np.eye(n), axis=0)
    system = np.block([[2 * change.T @ change, meets.T], [meets, np.zeros((10, 10))]])
    want = np.linalg.solve(system, np.concatenate([np.zeros(n), totals]))[:n] * z
    assert np.allclose(got["a"], want) and np.allclose(np.reshape(got["a"], (10, 3)).sum(1), totals)
    reasons = {(r.series, r.reason) for r in rows.select("series", "reason").distinct().collect()}
    assert reasons == {("a", None), ("neg", "nonpositive_total"), ("gap", "missing_indicator")}
    assert np.allclose(np.reshape(got["neg"], (2, 3)).sum(1), [-1, 2]) and np.allclose(got["gap"], [1, 1, 1, 3, 3])
    assert dis.denton_proportional(low.limit(0), high, 3).count() == 0


@pytest.mark.parametrize("method", ["chow_lin", "litterman", "fernandez"])
def test_gls_meets_totals_and_the_likeliest_rho(spark, method):
    totals, z = sample(4)
    low, high = tables(spark, {"a": (totals, z), "none": ([1.0, None], [1.0] * 6), "short": (totals[:4], z[:12])})
    rows = dis.gls_disagg(low, high, 3, method).cache()
    got = paths(rows)
    assert np.allclose(np.reshape(got["a"], (10, 3)).sum(1), totals, atol=1e-4)
    rhos = {r.series: r.rho for r in rows.select("series", "rho").distinct().collect()}
    best = max(dis.RHOS[method], key=lambda r: dis.gls_fit(method, r, np.array(totals), np.array(z), 3)[0])
    assert rhos["a"] == pytest.approx(best) and rhos["short"] == {"chow_lin": 0.5, "litterman": 0.7, "fernandez": 0.0}[method]
    assert {r.reason for r in rows.filter("series = 'none'").collect()} == {"missing_total"}
    x, meets = np.column_stack([np.ones(30), z]), np.kron(np.eye(10), np.ones(3))
    if method == "chow_lin":
        cov = np.array([[best ** abs(i - j) for j in range(30)] for i in range(30)])
    else:
        back = np.linalg.inv((np.eye(30) - best * np.eye(30, k=-1)) @ (np.eye(30) - np.eye(30, k=-1)))
        cov = back @ back.T
    low_inverse = np.linalg.inv(meets @ cov @ meets.T)
    beta = np.linalg.solve((meets @ x).T @ low_inverse @ meets @ x, (meets @ x).T @ low_inverse @ totals)
    want = x @ beta + cov @ meets.T @ low_inverse @ (totals - meets @ x @ beta)
    assert np.allclose(got["a"], want, atol=1e-4)


def test_gates_name_the_first_measure_that_misses(spark):
    rows = [("a", "denton", 2, 0.0, None), ("b", "chow_lin", 5, 1.0, 0.9), ("c", "chow_lin", 20, 0.5, 0.9), ("d", "litterman", 20, 0.5, 0.1), ("e", "litterman", 20, 0.5, None), ("f", "fernandez", 20, 0.5, 0.2), ("g", "other", 20, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series string, method string, n int, coverage double, corr double")
    assert {r.series: r.gate for r in dis.method_gates(df).collect()} == {"a": "pass", "b": "few_rows", "c": "coverage", "d": "corr", "e": "corr", "f": "pass", "g": "unknown_method"}
    high = spark.createDataFrame([("a", "chow_lin", 20, 9.0), ("b", "litterman", 20, 9.0)], "series string, method string, n int, ratio_cv double")
    assert {r.series: r.gate for r in dis.method_gates(high).collect()} == {"a": "ratio_cv", "b": "pass"}


def test_best_method_needs_a_gain(spark):
    rows = [("a", "denton", 1.0, "pass"), ("a", "litterman", 0.9, "pass"), ("a", "chow_lin", 0.5, "corr"), ("b", "denton", 1.0, "pass"), ("b", "chow_lin", 0.99, "pass"), ("c", "denton", 1.0, "pass"), ("c", "chow_lin", 0.1, "few_rows"), ("d", "denton", 1.0, "pass"), ("d", "litterman", 0.5, "pass"), ("d", "fernandez", 0.5, "pass")]
    df = spark.createDataFrame(rows, "series string, method string, rmse double, gate string")
    got = {r.series: (r.method, r.outcome) for r in dis.select_method(df).collect()}
    assert got == {"a": ("litterman", "selected"), "b": ("denton", "base_kept"), "c": ("denton", "base_only"), "d": ("fernandez", "selected")}


def test_holdout_predicts_from_the_past_only(spark):
    totals, z = sample(9, 12)
    sums = [sum(z[3 * b : 3 * b + 3]) for b in range(12)]
    df = spark.createDataFrame([("a", b, t, s) for b, (t, s) in enumerate(zip(totals, sums))], "series string, block int, total double, indicator double")
    got = {r.method: r for r in dis.holdout_scores(df, holds=3).collect()}
    errors = {m: [] for m in got}
    for k in (9, 10, 11):
        slope, level = np.polyfit(sums[:k], totals[:k], 1)
        dt, dz = np.diff(totals[:k]), np.diff(sums[:k])
        step = totals[k - 1] + dt @ dz / (dz @ dz) * (sums[k] - sums[k - 1])
        for m, guess in {"denton": totals[k - 1], "denton_proportional": totals[k - 1] * sums[k] / sums[k - 1], "chow_lin": level + slope * sums[k], "fernandez": step, "litterman": step}.items():
            errors[m].append(totals[k] - guess)
    assert all(got[m].held == 3 and got[m].rmse == pytest.approx(math.sqrt(np.mean(np.square(e)))) for m, e in errors.items())


def test_paths_follow_an_indicator_that_holds(spark):
    rng = random.Random(7)
    z = [10 + rng.gauss(0, 2) for _ in range(30)]
    walk = np.cumsum([rng.gauss(0, 1) for _ in range(30)])
    series = {"good": [3 * v + rng.gauss(0, 0.5) for v in z], "noise": [rng.gauss(0, 1) for _ in z], "trend": [3 * v + 4 * w for v, w in zip(z, walk)], "few": [3 * v for v in z[:5]], "asked": [rng.gauss(0, 1) for _ in z], "exact": [2 * v for v in z]}
    rows = [(s, b, float(t), z[b]) for s, totals in series.items() for b, t in enumerate(totals)] + [("holes", b, 1.0 + z[b], z[b] if b < 10 else None) for b in range(30)]
    df = spark.createDataFrame(rows, "series string, block int, total double, indicator double")
    spread = df.select("series").distinct().selectExpr("series", "if(series = 'flat', 0D, 4D) as variance")
    asked = spark.createDataFrame([("asked", "primary")], "series string, path string")
    got = {r.series: r for r in dis.choose_path(df, spread, asked).collect()}
    assert (got["good"].path, got["good"].reason) == ("primary", None) and got["exact"].path == "primary"
    assert got["noise"].reason in ("corr", "r2") and got["few"].reason == "few_rows" and got["holes"].reason == "coverage"
    assert got["trend"].reason in ("residuals", "corr", "r2") and (got["asked"].path, got["asked"].reason) == ("primary", "override")
    x, y = np.array(z), np.array(series["good"])
    e = y - np.polyval(np.polyfit(x, y, 1), x)
    q = 30 * 32 * sum((e[k:] @ e[:-k] / (e @ e)) ** 2 / (30 - k) for k in range(1, 5))
    assert got["good"].q == pytest.approx(q) and got["good"].p == pytest.approx(math.exp(-q / 2) * (1 + q / 2))
