"""Instrument screens against numpy and by hand."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrotide.operators import instruments


def months(n):
    return [date(2000 + i // 12, i % 12 + 1, 28) for i in range(n)]


def fit(y, x):
    b = np.linalg.lstsq(np.column_stack([np.ones_like(x), x]), y, rcond=None)[0]
    return b[0], b[1]


def cross_validated(y, x, folds, forward, least):
    n, out = len(y), [0.0, 0.0]
    sizes = [n // folds + (i < n % folds) for i in range(folds)]
    at = np.cumsum([0, *sizes])
    for i in range(folds):
        test = np.arange(at[i], at[i + 1])
        train = np.arange(at[i]) if forward else np.setdiff1d(np.arange(n), test)
        if len(train) < least:
            continue
        a, b = fit(y[train], x[train])
        out[0] += float(((y[test] - a - b * x[test]) ** 2).sum())
        out[1] += float(((y[test] - y.mean()) ** 2).sum())
    return max(-1, min(1, 1 - out[0] / out[1])) if out[1] else None


@pytest.mark.parametrize("n", [9, 13, 14, 37])
def test_chained_fits_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    y = 0.7 * x + rng.normal(size=n) + 5
    rows = [("g", d, float(a), float(b)) for d, a, b in zip(months(n), y, x)] + [("g", date(2030, 1, 1), None, 1.0), ("flat", date(2000, 1, 1), 1.0, 1.0)]
    got = {r.k: r for r in instruments.chained_fits(spark.createDataFrame(rows, "k string, d date, y double, z double"), ["k"], "d", "y", "z").collect()}
    r = got["g"]
    assert r.n == n and got["flat"].r2_cv is None
    want = (cross_validated(y, x, 5, True, 12) if n >= 14 else None, cross_validated(y, x, 5, False, 3) if n >= 10 else None)
    for a, b in zip((r.r2_cv, r.r2_cv_pooled), want):
        assert (a is None and b is None) or abs(a - b) < 1e-9


def test_folds_by_hand(spark):
    rows = spark.range(13).select("id", instruments.fold_of(F.col("id"), F.lit(13), 5).alias("f")).orderBy("id").collect()
    assert [r.f for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_forms_by_hand(spark):
    values = [1.0, 2.0, 4.0, -1.0, 3.0, 5.0, 4.0, 8.0, 6.0, 7.0, 9.0, 8.0]
    rows = [("c", d, v) for d, v in zip(months(12), values)]
    got = instruments.candidate_forms(spark.createDataFrame(rows, "candidate string, date date, value double"), ["diff", "logdiff", "innov"], 1)
    forms = {(r.transform, r.lag, r.date): r.z for r in got.collect()}
    d = months(12)
    assert forms["diff", 0, d[1]] == 1 and forms["diff", 1, d[2]] == 1 and ("diff", 0, d[0]) not in forms
    assert abs(forms["logdiff", 0, d[2]] - math.log(2)) < 1e-12 and ("logdiff", 0, d[3]) not in forms and ("logdiff", 0, d[4]) not in forms
    a, b = fit(np.array(values[1:]), np.array(values[:-1]))
    assert abs(forms["innov", 0, d[5]] - (5 - a - b * 5)) < 1e-9 and abs(forms["innov", 1, d[6]] - (5 - a - b * 5)) < 1e-9
    short = instruments.candidate_forms(spark.createDataFrame(rows[:8], "candidate string, date date, value double"), ["innov"], 0)
    assert short.count() == 0


def tables(spark):
    rng = np.random.default_rng(1)
    n = 72
    good, other = rng.normal(size=n), rng.normal(size=n)
    level = np.cumsum(good) + 50
    t1 = np.append(0, np.diff(level)) + 0.3 * rng.normal(size=n)
    t2 = other
    treatments = [("t1", d, float(v)) for d, v in zip(months(n), t1)] + [("t2", d, float(v)) for d, v in zip(months(n), t2)]
    series = {"good": level, "noise": np.cumsum(rng.normal(size=n)), "flat": np.ones(n), "short": level[:8], "both": np.cumsum(t1 + 2 * t2)}
    candidates = [(c, d, float(v)) for c, values in series.items() for d, v in zip(months(n), values)]
    pairs = [(t, c) for t in ("t1", "t2") for c in series]
    return (
        spark.createDataFrame(treatments, "treatment string, date date, y double"),
        spark.createDataFrame(candidates, "candidate string, date date, value double"),
        spark.createDataFrame(pairs, "treatment string, candidate string"),
        {"t1": t1, "t2": t2},
        series,
    )


def brute(y, z, others, folds=5):
    held = np.isfinite(y) & np.isfinite(z)
    a, b = y[held], z[held]
    n = len(a)
    r = np.corrcoef(a, b)[0, 1]
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    forward, pooled = cross_validated(a, b, folds, True, 12), cross_validated(a, b, folds, False, 3)
    leads = []
    for k in (1, 2):
        u, v = y[k:], z[:-k]
        ok = np.isfinite(u) & np.isfinite(v)
        c = np.corrcoef(u[ok], v[ok])[0, 1]
        leads.append(abs(c) * math.sqrt((ok.sum() - 2) / (1 - c * c)))
    rho = max(abs(np.corrcoef(o[np.isfinite(z)], z[np.isfinite(z)])[0, 1]) for o in others)
    checks = [math.erfc(t / math.sqrt(2)) <= 0.1, forward >= 0 and pooled - forward <= 0.25, max(leads) <= 2, rho < 0.3]
    score = 0.4 * min(1, t / 10) + 0.25 * min(1, math.log1p(t * t) / math.log1p(400)) + 0.2 * r * r + 0.15 * max(0, forward)
    for ok, factor in zip(checks, (0.65, 0.6, 0.85, 0.85)):
        score *= 1 if ok else factor
    return t, r * r, forward, pooled, max(leads), rho, checks, score * (0.55 if t * t < 10 else 1)


def test_screen_equals_numpy(spark):
    treatments, candidates, pairs, ys, series = tables(spark)
    fragile = spark.createDataFrame([("t2", True, False, True)], "treatment string, lead_fail boolean, episode_fail boolean, wspec_fail boolean")
    got = instruments.instrument_screen(treatments, candidates, pairs, ["diff"], max_lag=1, top=1, fragility=fragile).collect()
    rows = {(r.treatment, r.candidate, r.lag): r for r in got}
    for t, c, k in [(t, c, k) for t in ys for c in ("good", "noise", "both") for k in (0, 1)]:
        z = np.append(np.full(1 + k, np.nan), np.diff(series[c])[: len(series[c]) - 1 - k])
        want = brute(ys[t], z, [v for o, v in ys.items() if o != t])
        r = rows[t, c, k]
        assert np.allclose([r.first_stage_t, r.partial_r2, r.r2_cv, r.r2_cv_pooled, r.t_pre_max, r.rho_max_other], want[:6])
        assert [r.pass_directionality, r.forward_chain_ok, r.pretrend_ok, r.specificity_ok] == want[6]
        assert abs(r.score - want[7] * (0.8 * 0.9 if t == "t2" else 1)) < 1e-9
    assert rows["t1", "good", 0].selected and rows["t1", "good", 0].place == 1
    flat, short = rows["t1", "flat", 0], rows["t1", "short", 0]
    assert not flat.pass_feasibility and flat.score is None and not short.pass_feasibility and not flat.pass_directionality
    decisions = {(r.treatment, r.candidate): r for r in instruments.screen_decisions(instruments.instrument_screen(treatments, candidates, pairs, ["diff"], max_lag=1, top=1, fragility=fragile)).collect()}
    assert decisions["t1", "good"].decision == "select" and decisions["t1", "flat"].decision == "drop"
    assert decisions["t1", "flat"].reasons.startswith("FEASIBILITY_FAIL;DIRECTIONALITY_FAIL;FORWARD_CHAIN_FAIL")
    assert "BASELINE_LEAD_FAIL;BASELINE_WSPEC_FAIL" in decisions["t2", "good"].reasons and decisions["t2", "good"].decision == "demote"
    one = instruments.instrument_screen(treatments, candidates, pairs.limit(1), ["diff"], max_lag=0)
    assert one.count() == 1 and instruments.instrument_screen(treatments, candidates, pairs.limit(0), ["diff"]).count() == 0


def cleared(v, w):
    x = np.column_stack([np.ones(len(v)), w]) if w is not None else np.ones((len(v), 1))
    return v - x @ np.linalg.lstsq(x, v, rcond=None)[0]


def long_run(s, lags):
    out = s.T @ s
    for k in range(1, lags + 1):
        cross = s[k:].T @ s[:-k]
        out = out + (1 - k / (lags + 1)) * (cross + cross.T)
    return out


def instrumented(seed, n=90, strength=0.8):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(n, 2))
    z = rng.normal(size=(n, 3)) + w @ rng.normal(size=(2, 3))
    hidden = rng.normal(size=n)
    d = strength * z @ np.array([1.0, 0.5, 0.0]) + w[:, 0] + hidden
    y = 1.5 * d + hidden + w[:, 1] + 0.5 * rng.normal(size=n)
    return y, d, z, w


def frame(spark, groups):
    rows = [(g, t, float(y[i]), float(d[i]), *[float(v) for v in z[i]], *[float(v) for v in w[i]]) for g, (y, d, z, w) in groups.items() for i, t in enumerate(months(len(y)))]
    rows += [("a", date(2050, 1, 1), None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), *[("few", t, 1.0 * i, 2.0 * i, 1.0, 2.0, 3.0, 4.0, 5.0) for i, t in enumerate(months(3))]]
    return spark.createDataFrame(rows, "g string, t date, y double, d double, z1 double, z2 double, z3 double, w1 double, w2 double")


Z, W = ["z1", "z2", "z3"], ["w1", "w2"]


@pytest.mark.parametrize("controlled", [True, False])
def test_strength_and_two_stages_equal_numpy(spark, controlled):
    groups = {"a": instrumented(1), "b": instrumented(2, 60, 0.05)}
    df, ws = frame(spark, groups), W if controlled else None
    got = {r.g: r for r in instruments.first_stage_strength(df.filter("y is not null"), ["g"], "t", "d", Z, ws, lags=3).collect()}
    two = {r.g: r for r in instruments.two_stage(df, ["g"], "t", "y", "d", Z, ws, lags=3).collect()}
    assert got["few"].reason is not None and got["few"].f_eff is None and "few" not in two
    for g, (y, d, z, w) in groups.items():
        w = w if controlled else None
        y, d, z = cleared(y, w), cleared(d, w), cleared(z, w)
        pi = np.linalg.lstsq(z, d, rcond=None)[0]
        u = d - z @ pi
        q, omega = z.T @ z, long_run(z * u[:, None], 3)
        wald = pi @ q @ np.linalg.inv(omega) @ q @ pi
        cov = np.linalg.inv(q) @ omega @ np.linalg.inv(q)
        r = got[g]
        assert r.n == len(y) and abs(r.f_eff - wald / 3) < 1e-8 * wald and abs(r.t - np.max(np.abs(pi) / np.sqrt(np.diag(cov)))) < 1e-8
        assert abs(r.partial_r2 - (1 - u @ u / (d @ d))) < 1e-10 and abs(r.underid_p - instruments._chi2_tail(wald, 3)) < 1e-6
        hat = z @ pi
        beta = hat @ y / (hat @ d)
        se = math.sqrt(long_run((hat * (y - beta * d))[:, None], 3)[0, 0]) / abs(hat @ d)
        assert abs(two[g].beta - beta) < 1e-9 and abs(two[g].se - se) < 1e-9
    assert got["a"].f_eff > 10 > got["b"].f_eff


def test_robust_sets_equal_a_scan(spark):
    y, d, z, w = instrumented(1)
    got = {r.g: r for r in instruments.anderson_rubin(frame(spark, {"a": (y, d, z, w), "b": instrumented(2, 60, 0.02)}), ["g"], "t", "y", "d", Z, W, lags=3, points=201).collect()}
    y, d, z = cleared(y, w), cleared(d, w), cleared(z, w)

    def wald(theta):
        e = y - theta * d
        delta = np.linalg.lstsq(z, e, rcond=None)[0]
        return delta @ z.T @ z @ np.linalg.inv(long_run(z * (e - z @ delta)[:, None], 3)) @ z.T @ z @ delta

    critical = instruments._chi2_quantile(0.95, 3)
    assert abs(critical - 7.8147) < 1e-4 and abs(instruments._chi2_quantile(0.95, 1) - 1.959963985**2) < 1e-6
    r = got["a"]
    step = (r.hi - r.lo) / 40
    assert r.status == "inside" and wald(r.lo) <= critical and wald(r.hi) <= critical and wald(r.lo - step) > critical and wald(r.hi + step) > critical
    assert r.lo < 1.5 < r.hi and got["b"].hi - got["b"].lo > 2 * (r.hi - r.lo) and "few" not in got
