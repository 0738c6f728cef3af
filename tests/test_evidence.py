"""Driver responses in windows, the choice of a window's model and scores over both kinds, against numpy and by hand."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrotide.functions.columns import chi2_p
from macrotide.operators import evidence


def months(n):
    return [date(2000 + i // 12, i % 12 + 1, 28) for i in range(n)]


def panel_of(spark, series):
    rows = [(s, d, None if v is None else float(v)) for s, values in series.items() for d, v in zip(months(len(values)), values)]
    return spark.createDataFrame(rows, "series string, date date, value double")


def chi2_tail(x, df):
    """The same tail by adding up the density."""
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if x > 400:
        return 0.0
    t = np.linspace(x, x + 200, 400_001)
    f = np.exp((df / 2 - 1) * np.log(np.maximum(t, 1e-300)) - t / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
    return float(np.sum((f[1:] + f[:-1]) / 2 * np.diff(t)))


def test_chi_square_tails(spark):
    rows = [(x, d) for x in (0.3, 1.0, 2.7, 9.0, 30.0) for d in (1, 2, 3, 4, 5, 8)]
    got = spark.createDataFrame(rows, "x double, d int").select("x", "d", chi2_p(F.col("x"), F.col("d")).alias("p"), chi2_p(F.col("x"), 3).alias("p3")).collect()
    for r in got:
        assert abs(r.p - chi2_tail(r.x, r.d)) < 1e-5, r
        assert r.d != 3 or abs(r.p - r.p3) < 1e-12
    zero = spark.range(1).select(chi2_p(F.lit(0.0), 1).alias("a"), chi2_p(F.lit(0.0), 2).alias("b"), chi2_p(F.lit(None).cast("double"), 2).alias("c")).first()
    assert abs(zero.a - 1) < 1e-6 and zero.b == 1 and zero.c is None


def fitted(y, x, p):
    """One window's autoregression, equation by equation."""
    n = len(y)
    z = np.array([[1, *[v for k in range(1, p + 1) for v in (y[t - k], x[t - k])]] for t in range(p, n)])
    out, left = {}, []
    inverse = np.linalg.inv(z.T @ z)
    for name, t, s in (("driver_to_target", y, 1), ("target_to_driver", x, 0)):
        b = np.linalg.lstsq(z, t[p:], rcond=None)[0]
        u = t[p:] - z @ b
        left.append(u)
        cov = inverse * (u @ u) / (len(z) - z.shape[1])
        at = [1 + 2 * k + s for k in range(p)]
        r = np.zeros(z.shape[1])
        r[at] = 1
        scale = (np.std(x, ddof=1) / np.std(y, ddof=1)) ** (1 if s else -1)
        out[f"{name}_coef"], out[f"{name}_se"] = r @ b, math.sqrt(r @ cov @ r)
        out[f"{name}_p"] = chi2_tail(b[at] @ np.linalg.inv(cov[np.ix_(at, at)]) @ b[at], p)
        out[f"{name}_std"], out[f"{name}_std_se"] = r @ b * scale, math.sqrt(r @ cov @ r) * scale
    out["residual_corr"] = np.corrcoef(*left)[0, 1]
    return out, np.stack(left)


def criterion(y, x, most):
    found = []
    for p in range(most + 1):
        _, left = fitted(y[most - p :], x[most - p :], p) if p else (None, np.stack([y[most:] - y[most:].mean(), x[most:] - x[most:].mean()]))
        n = left.shape[1]
        found.append(math.log(np.linalg.det(left @ left.T / n)) + 2 / n * (4 * p + 2))
    best = int(np.argmin(found))
    return best if best else min(most, 2)


@pytest.mark.parametrize("choose", [False, True])
def test_responses_equal_numpy(spark, choose):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=44), 1)  # with ties, for the ranks
    y = np.zeros(44)
    for t in range(2, 44):
        y[t] = 0.5 * y[t - 1] + 0.6 * x[t - 1] - 0.4 * x[t - 2] + 0.3 * rng.normal()
    noise = rng.normal(size=44)
    panel = panel_of(spark, {"x": [*x[:10], None, *x[10:]], "y": [*y[:10], 9.0, *y[10:]], "noise": [*noise[:10], 1.0, *noise[10:]], "flat": np.ones(45)})
    pairs = spark.createDataFrame([("x", "y"), ("noise", "x"), ("flat", "noise"), ("x", "absent")], "driver string, target string")
    got = evidence.driver_response(panel, pairs, 24, 2, choose).orderBy("driver", "date").collect()
    values = {"x": x, "y": y, "noise": noise}
    by_pair = {}
    for r in got:
        by_pair.setdefault((r.driver, r.target), []).append(r)
    assert {k: len(v) for k, v in by_pair.items()} == {("x", "y"): 21, ("noise", "x"): 21, ("flat", "noise"): 22}
    for (d, t), rows in by_pair.items():
        if d == "flat":
            assert all(r.spearman is None and r.driver_to_target_coef is None and r.driver_to_target_p is None for r in rows)
            continue
        lags = set()
        for i, r in enumerate(rows):
            a, b = values[t][i : i + 24], values[d][i : i + 24]
            p = criterion(a, b, 2) if choose else 2
            lags.add(p)
            want, _ = fitted(a, b, p)
            assert r.lags == p
            for c, v in want.items():
                assert abs(r[c] - v) < 2e-5 * max(1, abs(v)), (c, r[c], v)
            ranks = [[sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v] for v in (a, b)]
            assert abs(r.spearman - np.corrcoef(*ranks)[0, 1]) < 1e-9
        assert not choose or d != "noise" or lags == {1, 2} or lags == {2} or lags == {1}


def test_windows_of_both_kinds(spark):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=60))
    tied = 2 * walk + np.where(np.arange(60) % 2, 0.05, -0.05) + 0.01 * rng.normal(size=60)
    levels = panel_of(spark, {"walk": walk, "tied": tied, "loose": np.cumsum(rng.normal(size=60))})
    moves = panel_of(spark, {"walk": np.diff(walk), "tied": np.diff(tied), "loose": np.diff(rng.normal(size=60))})
    pairs = spark.createDataFrame([("walk", "tied"), ("walk", "loose")], "driver string, target string")
    got = evidence.model_windows(levels, moves, pairs, 24, 1, False).collect()
    vecm = [r for r in got if r.target == "tied" and r.model == "VECM"]
    assert len(vecm) >= 30 and all(abs(r.beta - 2) < 0.1 and r.alpha < -0.5 and r.r is None and r.p < 0.01 for r in vecm)
    var = [r for r in got if r.target == "loose" and r.model == "VAR"]
    assert var and all(r.beta is None and r.alpha is None and abs(r.t - r.r * math.sqrt(21 / (1 - r.r**2))) < 1e-9 for r in var)
    assert len({(r.driver, r.target, r.date) for r in got}) == len(got)


WINDOWS = [  # pair, model, r, p, t, beta, alpha
    ("a", "VAR", 0.5, 0.01, 2.0, None, None),
    ("a", "VAR", 0.8, 0.04, 3.0, None, None),
    ("a", "VAR", -0.4, 0.025, -2.0, None, None),
    ("a", "VAR", 0.9, 0.2, 1.0, None, None),
    ("a", "VECM", None, 0.0, -4.0, 2.0, -0.5),
    ("a", "VECM", None, 0.0, -4.0, -1.0, -0.5),
    ("a", "VECM", None, 0.01, 4.0, 4.0, 0.5),
    ("b", "VAR", -0.2, None, -1.5, None, None),
    ("b", "VAR", -0.6, None, -5.0, None, None),
    ("c", "VECM", None, 0.03, -4.0, 0.0, -0.1),
]


def windows(spark):
    return spark.createDataFrame(WINDOWS, "pair string, model string, r double, p double, t double, beta double, alpha double")


def test_directional_scores_by_hand(spark):
    got = {(r.pair, r.direction): r for r in evidence.directional_scores(windows(spark), ["pair"]).collect()}
    assert len(got) == 6
    a = got["a", "positive"]
    # weights 0.8 and 0.2 of four VAR windows; one VECM window of three, with weight 1; scale: median of 2, 1, 4
    assert a.n == 7 and abs(a.var_coverage - 0.25) < 1e-12 and abs(a.var_strength - (0.8 * 0.5 + 0.2 * 0.8)) < 1e-12
    assert a.beta_scale == 2 and abs(a.vecm_coverage - 1 / 3) < 1e-12 and abs(a.vecm_strength - math.tanh(1)) < 1e-12
    assert abs(a.score - 100 * (0.7 * 0.25 * 0.56 + 0.3 / 3 * math.tanh(1)) * 2 / 14) < 1e-9
    n = got["a", "negative"]
    assert abs(n.score - 100 * (0.7 * 0.5 / 4 * 0.4 + 0.3 / 3 * math.tanh(0.5)) * 1.5 / 13.5) < 1e-9
    # no p at all: |t| decides and weighs; (1.5 - 1.28) / 1.28 and 1
    b, w = got["b", "negative"], 0.22 / 1.28
    assert abs(b.n_eff - (1 + w)) < 1e-12 and abs(b.score - 70 * (0.2 * w + 0.6) / 2 * (1 + w) / (13 + w)) < 1e-9
    assert got["b", "positive"].score == 0 and got["c", "positive"].score == 0 and got["c", "positive"].beta_scale == 1
    assert got["c", "negative"].var_coverage == 0
    fixed = evidence.directional_scores(windows(spark), ["pair"], beta_scale=4.0, prior=0).filter("pair = 'a' and direction = 'positive'").first()
    assert abs(fixed.score - 100 * (0.7 * 0.25 * 0.56 + 0.3 / 3 * math.tanh(0.5))) < 1e-9
    by_q = evidence.directional_scores(windows(spark).withColumn("q", F.when(F.col("r") == 0.5, 0.05)), ["pair"], q="q").filter("pair = 'a' and direction = 'positive'").first()
    assert abs(by_q.n_eff - (0.0 + 0.2 + 1)) < 1e-12  # a q of alpha weighs nothing; windows without one keep their p
    either = evidence.directional_scores(windows(spark), ["pair"], significance="either").filter("pair = 'b' and direction = 'negative'").first()
    assert abs(either.score - b.score) < 1e-9


def test_legacy_and_independence_by_hand(spark):
    got = {(r.pair, r.direction): r.score for r in evidence.legacy_directional_scores(windows(spark), ["pair"]).collect()}
    assert abs(got["a", "positive"] - 100 * (0.7 * 2 / 7 * 0.65 + 0.3 * 1 / 7 * 2)) < 1e-9
    assert abs(got["a", "negative"] - 100 * (0.7 / 7 * 0.4 + 0.3 / 7 * 1)) < 1e-9
    assert abs(got["b", "negative"] - 70 * 0.4) < 1e-9 and got["c", "positive"] == 0
    by_t = {(r.pair, r.direction): r.score for r in evidence.legacy_directional_scores(windows(spark), ["pair"], significance="t").collect()}
    assert abs(by_t["a", "positive"] - 100 * (0.7 * 2 / 7 * 0.65 + 0.3 / 7 * 2)) < 1e-9
    quiet = {r.pair: r for r in evidence.independence_scores(windows(spark), ["pair"]).collect()}
    # medians of 1 - |r|: 0.5, 0.2, 0.6, 0.1; one p of four above alpha; four windows of seven are VAR
    assert abs(quiet["a"].score - 100 * 0.35 * 0.25 * 4 / 7 * 4 / 16) < 1e-9
    assert abs(quiet["a"].legacy - 100 / (1e-6 + 2) / 1.3) < 1e-9
    assert quiet["b"].score == 0 and quiet["c"].score == 0 and quiet["c"].legacy == 0


def test_empty(spark):
    none = windows(spark).limit(0)
    assert evidence.directional_scores(none, ["pair"]).count() == evidence.independence_scores(none, ["pair"]).count() == 0
    empty = panel_of(spark, {})
    assert evidence.driver_response(empty, spark.createDataFrame([("a", "b")], "driver string, target string"), 24).count() == 0
