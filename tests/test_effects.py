"""Targeted and heterogeneous effects against numpy and known truths."""

import math
import random

import numpy as np
import pytest

from macrotide.operators import effects


def sample(seed=5, n=240):
    rng = random.Random(seed)
    out = []
    for t in range(n):
        x = rng.gauss(0, 1)
        a = float(rng.random() < 1 / (1 + math.exp(-0.8 * x)))
        out.append(("a", t, 2 * a + x + rng.gauss(0, 0.3), a, x, t % 3))
    return out + [("one", t, 1.0, 1.0, float(t), t % 3) for t in range(12)] + [("a", 999, None, 1.0, 0.0, 0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sample(), "grp string, t int, y double, a double, x double, fold int")


def logistic(x, a, ridge):
    b, hold = np.zeros(x.shape[1]), ridge * len(a) * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (a - p) - hold @ b)
    return b


def test_targeted_effect_equals_numpy(frame):
    got = {r.eps: r for r in effects.tmle_ate(frame, ["grp"], "t", "y", "a", ["x"], "fold", (0.01, 0.3), lags=2).collect()}
    assert len(got) == 2  # the group in which all are treated is left out
    data = np.array([r[1:] for r in sample() if r[0] == "a" and r[2] is not None], float)
    t, y, a, x, fold = data.T
    design = np.column_stack([np.ones(len(t)), x])
    g, q, q1, q0 = (np.zeros(len(t)) for _ in range(4))
    for f in range(3):
        train, held = fold != f, fold == f
        g[held] = 1 / (1 + np.exp(-design[held] @ logistic(design[train], a[train], 1e-3)))
        beta = np.linalg.lstsq(np.column_stack([np.ones(train.sum()), a[train], x[train]]), y[train], rcond=None)[0]
        q[held], q1[held], q0[held] = (beta[0] + beta[1] * v + beta[2] * x[held] for v in (a[held], 1, 0))
    for eps, r in got.items():
        c = np.clip(g, eps, 1 - eps)
        h = a / c - (1 - a) / (1 - c)
        step = h @ (y - q) / (h @ h)
        gap = q1 + step / c - (q0 - step / (1 - c))
        ic = h * (y - q - step * h) + gap - gap.mean()
        meat = ic @ ic + 2 * sum((1 - k / 3) * (ic[k:] @ ic[:-k]) for k in (1, 2))
        assert r.n == 240 and r.estimate == pytest.approx(gap.mean(), abs=1e-6) and r.se == pytest.approx(math.sqrt(meat) / 240, abs=1e-6)
        assert r.ess == pytest.approx(np.abs(h).sum() ** 2 / (h @ h), rel=1e-5) and abs(r.estimate - 2) < 0.2


def test_a_single_fold_has_no_fit(frame):
    assert effects.propensities(frame.filter("fold = 0"), ["grp"], "fold", "a", ["x"]).count() == 0
    assert effects.tmle_ate(frame.limit(0), ["grp"], "t", "y", "a", ["x"], "fold").count() == 0


def test_effects_that_differ_are_told_apart(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        side, noise, d = rng.choice([-1.0, 1.0]), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((side, noise, d, (3.0 if side > 0 else 0.0) * d + rng.gauss(0, 0.1), k % 2))
    df = spark.createDataFrame([*rows, (1.0, None, 1.0, 1.0, 0)], "side double, noise double, d double, y double, fold int")
    out, weights = effects.r_learner(df, "y", "d", ["side", "noise"], "fold", [0, 1])
    got = {r.side: r for r in effects.segment_effects(out, ["side"], "y", "d").collect()}
    assert out.count() == 600 and weights["side"] > weights["noise"]
    assert got[1.0].mean_effect > 2 and got[-1.0].mean_effect < 1 and got[1.0].ate > 2 and abs(got[-1.0].ate) < 0.6
