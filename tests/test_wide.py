"""Cross-products of arrays, components and nested cross-fitting against numpy."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrotide.operators import controls, factors, wide
from macrotide.operators.shocks import PATH

from .test_evidence import panel_of


def arrays(spark, groups, schema="g string, h int, w array<double>"):
    return spark.createDataFrame([(g, h, [float(v) for v in row]) for g, h, rows in groups for row in rows], schema)


def test_gram_equals_numpy(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(1e6, 1, (40, 5)), rng.normal(size=(7, 5)), rng.normal(size=(30, 5))
    df = arrays(spark, [("a", 1, a), ("a", 2, b), ("c", 1, c)])
    own = wide.wide_gram(df, ["g", "h"]).toPandas()
    for key, x in {("a", 1): a, ("a", 2): b, ("c", 1): c}.items():
        s, means = wide.matrix_of(own[(own.g == key[0]) & (own.h == key[1])])
        assert np.allclose(means, x.mean(0)) and s[0, 0] == len(x) and np.allclose(s[0, 1:], 0, atol=1e-6)
        assert np.allclose(s[1:, 1:], (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-7, atol=1e-7)
    whole = wide.wide_gram(df, ["g", "h"], centred_by=["g"]).toPandas()
    parts = [wide.matrix_of(whole[(whole.g == "a") & (whole.h == h)]) for h in (1, 2)]
    x = np.vstack([a, b])
    assert np.allclose(parts[0][1], x.mean(0)) and np.allclose(parts[1][1], x.mean(0))
    assert np.allclose(parts[0][0][1:, 1:] + parts[1][0][1:, 1:], (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-9)
    every = wide.matrix_of(wide.wide_gram(df, []).toPandas())[0]
    assert every[0, 0] == 77 and wide.wide_gram(df.limit(0), ["g"]).count() == 0


def test_plan_does_not_grow_and_bad_arrays_raise(spark, monkeypatch):
    rng = np.random.default_rng(1)
    small = arrays(spark, [("a", 1, rng.normal(size=(60, 3)))])
    x = rng.normal(size=(60, 500))
    big = arrays(spark, [("a", 1, x)])
    plans = [len(wide.wide_gram(df, ["g"])._jdf.queryExecution().optimizedPlan().toString().splitlines()) for df in (small, big)]
    assert plans[0] == plans[1]
    monkeypatch.setattr(wide, "HELD_BYTES", 1)  # handed on after every batch
    got = wide.matrix_of(wide.wide_gram(big, ["g"]).toPandas())[0]
    assert got.shape == (501, 501) and np.allclose(got[1:, 1:], (x - x.mean(0)).T @ (x - x.mean(0)))
    for rows in ([[1.0, 2.0], [1.0]], [[1.0, None], [1.0, 2.0]]):
        with pytest.raises(Exception, match="one length without nulls"):
            wide.wide_gram(spark.createDataFrame([("a", r) for r in rows], "g string, w array<double>").coalesce(1), ["g"]).count()


def test_rows_and_components_equal_those_of_columns(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(size=50)
    series = {f"s{i}": list(common * (1 + i) + rng.normal(size=50)) for i in range(4)}
    series["s2"][7] = None
    panel = panel_of(spark, series)
    whole, all_rows = wide.wide_rows(panel), wide.wide_rows(panel, whole=False)
    assert whole.count() == 49 and all_rows.count() == 50
    first = all_rows.orderBy("date").collect()
    assert first[0].names == ["s0", "s1", "s2", "s3"] and first[7].w[2] is None and first[7].w[1] == series["s1"][7]
    columns = whole.select("date", *[F.col("w")[i].alias(f"s{i}") for i in range(4)]).withColumn("all", F.lit(1))
    want = factors.components(columns, ["all"], ["s0", "s1", "s2", "s3"], threshold=0.95).first()
    got = wide.wide_components(whole, [], threshold=0.95).first()
    assert (got.n, got.k) == (want.n, want.k)
    for c in ("share", "means", "scales", "loadings"):
        assert np.allclose(got[c], want[c])
    scores = {r.date: r.f1 for r in wide.wide_scores(all_rows, wide.wide_components(whole, [], threshold=0.95), []).collect()}
    other = {r.date: r.f1 for r in factors.component_scores(columns, ["all"], ["s0", "s1", "s2", "s3"], factors.components(columns, ["all"], ["s0", "s1", "s2", "s3"], threshold=0.95)).collect()}
    assert len(scores) == 50 and all(abs(scores[d] - v) < 1e-9 for d, v in other.items())


def test_choice_of_controls_by_hand():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * [1, 10, 3, 0, 5]
    d = x[:, 0] + 0.2 * x[:, 2] + 0.1 * rng.normal(size=200)
    z = np.column_stack([np.ones(200), x, d * 0, d])
    s = z.T @ z
    assert wide.chosen_controls(s, 5, None, "corr_t", []).tolist() == [0, 1, 2, 3, 4]
    assert wide.chosen_controls(s, 5, 2, "corr_t", []).tolist() == [0, 2]
    assert wide.chosen_controls(s, 5, 2, "variance", []).tolist() == [1, 4]
    assert wide.chosen_controls(s, 5, 3, "corr_t_then_variance", []).tolist() == [0, 1, 4]
    assert wide.chosen_controls(s, 5, 2, "corr_t", [4]).tolist() == [0, 4]
    assert wide.chosen_controls(s, 5, 1, "variance", [3, 4]).tolist() == [3, 4]
    flat = np.column_stack([np.ones(200), x, d * 0, d * 0])
    assert wide.chosen_controls(flat.T @ flat, 5, 2, "corr_t", []).tolist() == [1, 4]


def net(x, t, l1, penalty):
    """A coordinate-descent elastic net on standardized columns; (intercept, slopes)."""
    m, s = x.mean(0), x.std(0)
    z, y = (x - m) / s, t - t.mean()
    b = np.zeros(x.shape[1])
    for _ in range(2000):
        before = b.copy()
        for j in range(len(b)):
            pull = z[:, j] @ (y - z @ b + z[:, j] * b[j]) / len(y)
            b[j] = np.sign(pull) * max(abs(pull) - penalty * l1, 0) / (1 + penalty * (1 - l1))
        if np.abs(b - before).max() < 1e-11:
            break
    return t.mean() - (b / s) @ m, b / s


def nested_net(x, t, folds, l1):
    """Penalty by leaving out one fold after another, then the fit on all rows."""
    z, y = (x - x.mean(0)) / x.std(0), t - t.mean()
    penalties = np.abs(z.T @ y / len(y)).max() / l1 * np.array(PATH)
    errors = np.zeros(len(penalties))
    for f in np.unique(folds):
        for i, penalty in enumerate(penalties):
            a, b = net(x[folds != f], t[folds != f], l1, penalty)
            errors[i] += ((t[folds == f] - a - x[folds == f] @ b) ** 2).sum()
    return (*net(x, t, l1, penalties[int(np.argmin(errors))]), penalties[int(np.argmin(errors))])


def test_nested_fits_equal_numpy(spark):
    """Control 3 copies d in the last fold only: chosen for the folds that train on it, never for the fold that is left out with it."""
    rng = np.random.default_rng(4)
    n = 80
    x = rng.normal(size=(n, 4)) * 1000 + 50_000
    d = 0.001 * x[:, 0] + rng.normal(size=n)
    y = 0.5 * d + 0.002 * x[:, 1] + 0.5 * rng.normal(size=n)
    folds = np.repeat(np.arange(4), 20)
    leak = folds == 3
    x[leak, 3] = 50_000 + 4000 * (d[leak] - d.mean())
    rows = [("g", date(2000, 1, 1) + timedelta(days=i), float(y[i]), float(d[i]), [float(v) for v in x[i]], int(folds[i])) for i in range(n)]
    rows += [("g", date(2020, 1, 1), None, 1.0, [1.0] * 4, 0), ("g", date(2020, 1, 2), 1.0, 1.0, [1.0, None, 1.0, 1.0], 0), ("few", date(2020, 1, 2), 1.0, 1.0, [1.0, 2.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "g string, at date, y double, d double, w array<double>, fold int")
    fits = {r.fold: r for r in wide.nested_fits(df, ["g"], "y", "d", "w", "fold", most=2).filter("g = 'g'").collect()}
    assert sorted(fits) == [0, 1, 2, 3] and 3 in fits[0].controls and 3 not in fits[3].controls
    left = []
    for f, r in fits.items():
        train = folds != f
        used = sorted(np.argsort([-abs(np.corrcoef(x[train, j], d[train])[0, 1]) for j in range(4)], kind="stable")[:2].tolist())
        assert r.controls == used and r.n_train == 60
        for t, got, penalty in ((y, r.b_y, r.penalty_y), (d, r.b_d, r.penalty_d)):
            a, b, best = nested_net(x[train][:, used], t[train], folds[train], 0.5)
            assert abs(penalty - best) < 1e-6 * best and np.allclose(np.array(got)[1:][used], b, rtol=1e-4, atol=1e-9) and abs(got[0] - a) < 1e-3
            assert all(got[1 + j] == 0 for j in range(4) if j not in used)
        own = folds == f
        left.append(np.column_stack([y[own] - r.b_y[0] - x[own] @ np.array(r.b_y[1:]), d[own] - r.b_d[0] - x[own] @ np.array(r.b_d[1:])]))
    u = np.vstack(left)
    slope = np.cov(u.T)[0, 1] / np.var(u[:, 1], ddof=1)
    got = wide.nested_partially_linear(df, ["g"], "at", "y", "d", "w", "fold", most=2).collect()
    assert len(got) == 1 and got[0].n == 80 and abs(got[0].beta - slope) < 1e-9 and got[0].lo < got[0].beta < got[0].hi
    plain = controls.hac_slope(df.select("g", "at", "y", "d").limit(0), ["g"], "at", "y", "d", 3)
    assert plain.count() == 0


def test_folds_in_order(spark):
    rows = [("a", i) for i in range(7)] + [("b", i) for i in range(2)]
    got = wide.fold_in_order(spark.createDataFrame(rows, "g string, t int"), ["g"], "t", 3).orderBy("g", "t").collect()
    assert [r.fold for r in got] == [0, 0, 0, 1, 1, 2, 2, 0, 1]
