"""Projections with past shocks, joint tests, choice of controls and measures of candidates, against numpy and literals."""

import datetime
import random

import numpy as np
import pytest

from macrotide.operators import controls, evaluation, regression, selection


def day(t):
    return datetime.date(2000, 1, 1) + datetime.timedelta(days=t)


@pytest.mark.parametrize("past", [1, 2])
def test_projection_clears_past_shocks_and_changes(spark, past):
    rng = random.Random(past)
    s, y = np.cumsum([rng.gauss(0, 1) for _ in range(50)]), np.cumsum([rng.gauss(0, 1) for _ in range(50)])
    y = y + np.concatenate([[0], s[:-1]])
    panel = spark.createDataFrame([("s", day(t), float(v)) for t, v in enumerate(s)] + [("y", day(t), float(v)) for t, v in enumerate(y)], "series string, date date, value double")
    pairs = spark.createDataFrame([("s", "y")], "treatment string, outcome string")
    got = {r.horizon: r for r in regression.local_projection(panel, pairs, 2, 1, past=past).collect()}
    ds, dy = np.diff(s, prepend=np.nan), np.diff(y, prepend=np.nan)
    for h in range(3):
        rows = [t for t in range(past + 1, 50 - h)]
        x = np.array([[1, ds[t], *[ds[t - k] for k in range(1, past + 1)], *[dy[t - k] for k in range(1, past + 1)]] for t in rows])
        target = np.array([y[t + h] - y[t - 1] for t in rows])
        beta = np.linalg.lstsq(x, target, rcond=None)[0][1]
        assert got[h].n == len(rows) and got[h].beta == pytest.approx(beta) and got[h].effect == pytest.approx(beta * np.std([ds[t] for t in rows], ddof=1))


def test_joint_test_is_the_f_of_both_fits(spark):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(40)] + [("few", 1.0, 2.0, 3.0, 4.0)] * 3
    df = spark.createDataFrame(rows, "g string, y double, s double, s1 double, s2 double")
    got = controls.joint_test(df, ["g"], "y", ["s"], ["s1", "s2"]).collect()
    data = np.array([r[1:] for r in rows if r[0] == "a"])

    def ssr(*columns):
        x = np.column_stack([np.ones(40), *columns])
        return np.sum((data[:, 0] - x @ np.linalg.lstsq(x, data[:, 0], rcond=None)[0]) ** 2)

    full, less = ssr(*data[:, 1:].T), ssr(data[:, 1])
    assert [r.g for r in got] == ["a"] and got[0].f == pytest.approx((less - full) / 2 / (full / 36))


def test_controls_by_mode_forced_and_fold(spark):
    rng = random.Random(3)
    t = [rng.gauss(0, 1) for _ in range(30)]
    series = {"near": [v + rng.gauss(0, 0.1) for v in t], "wide": [rng.gauss(0, 50) for _ in t], "half": [0.5 * v + rng.gauss(0, 0.5) for v in t], "flat": [1.0] * 30}
    panel = spark.createDataFrame([(s, day(k), float(v), k % 3) for s, vs in series.items() for k, v in enumerate(vs)], "series string, date date, value double, fold int")
    targets = spark.createDataFrame([("T", day(k), v) for k, v in enumerate(t)], "treatment string, date date, t double")

    def chosen(*args, **kwargs):
        return [r.series for r in selection.select_controls(panel, targets, *args, **kwargs).orderBy("place").collect()]

    assert chosen(1, "variance") == ["wide"] and chosen(2, "corr_t") == ["near", "half"]
    assert chosen(2, "corr_t_then_variance") == ["near", "wide"] and chosen(9) [-1] == "wide" and "flat" not in chosen(9)
    assert chosen(1, "corr_t", forced=["flat"]) == ["flat", "near"]
    for r in selection.select_controls(panel, targets, 9, fold="fold").collect():
        kept = [k for k in range(30) if k % 3 != r.fold]
        x = np.array([series[r.series][k] for k in kept])
        assert r.variance == pytest.approx(x.var(ddof=1)) and r.abs_corr == pytest.approx(abs(np.corrcoef(x, [t[k] for k in kept])[0, 1]))


def test_candidates_are_measured_and_one_recommended(spark):
    rows = [("a", "low", 1.0, 1.0), ("a", "low", 3.0, 2.0), ("a", "off", 1.0, 3.0), ("a", "off", 3.0, None), ("z", "one", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, candidate string, truth double, guess double")
    got = {(r.g, r.candidate): r for r in evaluation.evaluate_candidates(df, ["g"]).collect()}
    best = got["a", "low"]
    assert (best.n, best.mae, best.r2, best.place, best.recommended) == (2, 0.5, 0.5, 1, True) and best.rmse == pytest.approx(0.5**0.5) and best.mape == pytest.approx(1 / 6)
    assert got["a", "off"].r2 is None and not got["a", "off"].recommended and got["z", "one"].mape is None
    by_r2 = {(r.g, r.candidate): r.place for r in evaluation.evaluate_candidates(df, ["g"], "r2").collect()}
    assert by_r2["a", "low"] == 1 and by_r2["a", "off"] == 2
