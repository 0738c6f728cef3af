"""Elastic nets, components, bridges, instruments and cointegration against numpy and literals."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrotide.operators import factors, screening, shocks

XS = ["x1", "x2", "x3"]


def design(seed=3, n=60):
    rng = random.Random(seed)
    out = []
    for g in ("a", "b"):
        for t in range(n):
            x = [rng.gauss(5, 2), rng.gauss(-1, 0.5), rng.gauss(0, 1)]
            out.append((g, t, 1.5 * x[0] - 2 * x[1] + rng.gauss(0, 0.4), *x, t % 5))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(design(), "g string, t int, d double, x1 double, x2 double, x3 double, fold int")


def test_net_meets_the_conditions_of_a_least_value(frame):
    fits = {r.g: r for r in shocks.shock_fits(frame, ["g"], "d", XS, "fold", [{"l1_ratio": 0.5, "rounds": 2000}]).collect()}
    rows = frame.toPandas()
    for g, fit in fits.items():
        part = rows[rows.g == g]
        x, d = part[XS].to_numpy(), part["d"].to_numpy()
        sd = x.std(0)
        z, slopes = (x - x.mean(0)) / sd, np.array(fit.b[1:]) * sd
        left = d - fit.b[0] - x @ np.array(fit.b[1:])
        pull = z.T @ left / len(d) - fit.penalty * 0.5 * slopes
        for s, v in zip(slopes, pull):
            assert abs(v - np.sign(s) * fit.penalty * 0.5) < 1e-6 if s else abs(v) <= fit.penalty * 0.5 + 1e-6
        assert fit.converged and fit.model == "elastic_net" and fit.r2 == pytest.approx(1 - left.var() / d.var()) and fit.r2 > 0.9


def test_penalty_is_the_one_with_the_least_error_in_folds(frame):
    fit = shocks.shock_fits(frame.filter("g = 'a'"), ["g"], "d", XS, "fold", [{"l1_ratio": 1.0, "rounds": 2000}]).first()
    rows = frame.filter("g = 'a'").toPandas()

    def moments(part):
        m = np.column_stack([np.ones(len(part)), part[XS], part["d"]])
        return m.T @ m

    whole = moments(rows)
    errors = []
    top = np.max(np.abs(shocks._scaled(whole, 3)[4]))
    for share in shocks.PATH:
        error = 0.0
        for f in range(5):
            train, held = rows[rows.fold != f], rows[rows.fold == f]
            _, means, inverse, r, c = shocks._scaled(moments(train), 3)
            b, _ = shocks.net(r, c, 1.0, top * share, np.zeros(3), 5000)
            error += (((held["d"] - means[3]) - (held[XS].to_numpy() - means[:3]) @ (b * inverse)) ** 2).sum()
        errors.append(error)
    assert fit.penalty == pytest.approx(top * shocks.PATH[int(np.argmin(errors))])


def test_few_rows_constant_columns_and_nulls(spark):
    rows = [("few", t, float(t), 1.0, float(t), 0.0, t % 2) for t in range(5)] + [("flat", t, float(t % 7), 1.0, 2.0, 3.0, t % 3) for t in range(30)] + [("flat", 99, None, 1.0, 2.0, 3.0, 0)]
    df = spark.createDataFrame(rows, "g string, t int, d double, x1 double, x2 double, x3 double, fold int")
    fits = shocks.shock_fits(df, ["g"], "d", XS, "fold", [{"l1_ratio": 0.5, "rounds": 10}])
    got = {r.g: r for r in fits.collect()}
    assert got["few"].model == "mean_only_low_n" and got["few"].b == [2.0, 0.0, 0.0, 0.0]
    assert got["flat"].b[1:] == [0.0, 0.0, 0.0] and got["flat"].n == 30
    left = shocks.shock_residual(df, ["g"], "d", fits, XS)
    assert left.filter("shock is null").count() == 1 and abs(left.agg(F.sum("shock")).first()[0]) < 1e-9
    assert shocks.top_predictors(fits, ["g"], XS).count() == 0
    assert shocks.shock_fits(df.limit(0), ["g"], "d", XS, "fold", [{"l1_ratio": 0.5, "rounds": 10}]).count() == 0


def test_medians_fill(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 5.0), ("b", None)], "g string, x double")
    assert sorted((r.g, r.x) for r in shocks.median_filled(df, ["g"], ["x"]).collect()) == [("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 0.0)]


def test_first_attempt_that_passes_else_the_best(spark):
    rows = [("a", 0, "elastic_net", -0.5, 2.0, True), ("a", 1, "elastic_net", 0.1, 1.0, True), ("a", 2, "elastic_net", 0.9, 0.5, True), ("b", 0, "elastic_net", 0.9, 0.5, False), ("b", 1, "mean_only_low_n", 0.0, 0.9, True), ("c", 0, "elastic_net", -0.9, 1.0, True), ("c", 1, "elastic_net", -0.5, 1.0, True), ("c", 2, "elastic_net", None, 1.0, True)]
    fits = spark.createDataFrame(rows, "g string, attempt int, model string, r2 double, resid_var double, converged boolean")
    assert sorted((r.g, r.attempt, r.passed) for r in shocks.best_attempt(fits, ["g"]).collect()) == [("a", 1, True), ("b", 1, False), ("c", 1, False)]


def test_controls_by_correlation_only(frame):
    fit = shocks.shock_fits(frame.filter("g = 'a'"), ["g"], "d", XS, "fold", [{"l1_ratio": 0.5, "rounds": 2000, "most": 1}]).first()
    assert fit.b[1] != 0 and fit.b[2:] == [0.0, 0.0]


def test_components_equal_numpy_and_signs_follow_the_anchor(frame):
    fits = {r.g: r for r in factors.components(frame, ["g"], XS, threshold=0.6, most=2, anchor="x2").collect()}
    scores = factors.component_scores(frame, ["g"], XS, factors.components(frame, ["g"], XS, threshold=0.6, most=2, anchor="x2"), most=2).toPandas()
    for g, part in scores.groupby("g"):
        x = part[XS].to_numpy()
        z = (x - x.mean(0)) / x.std(0)
        values, vectors = np.linalg.eigh(z.T @ z / len(z))
        assert fits[g].share[0] == pytest.approx(values[-1] / 3) and fits[g].k == 2
        v = vectors[:, -1] * np.sign(vectors[1, -1])
        assert fits[g].loadings[0] == pytest.approx(v.tolist()) and part["f1"].to_numpy() == pytest.approx(z @ v)
    table = factors.loading_table(factors.components(frame, ["g"], XS, most=1), ["g"], XS)
    assert table.count() == 6 and set(table.columns) == {"g", "name", "factor", "loading", "share"}


def test_components_of_constant_columns(spark):
    df = spark.createDataFrame([("a", 1.0, float(t)) for t in range(9)] + [("b", 1.0, 2.0)] * 3, "g string, x1 double, x2 double")
    got = {r.g: r for r in factors.components(df, ["g"], ["x1", "x2"]).collect()}
    assert got["a"].k == 1 and got["a"].loadings == [[0.0, 1.0]] and got["b"].k == 0 and got["b"].loadings == []


def test_bridge_meets_the_totals(spark):
    rng = random.Random(5)
    months = [(datetime.date(2000 + k // 12, k % 12 + 1, 28), rng.gauss(4, 1), rng.gauss(2, 1)) for k in range(39)]
    wide = spark.createDataFrame(months, "date date, a double, b double")
    quarter = (F.date_sub(F.add_months(F.trunc("date", "quarter"), 3), 1)).alias("quarter_end")
    low = wide.groupBy(quarter).agg(F.sum(F.expr("2 + 3 * a - b")).alias("total")).withColumn("series", F.lit("s")).filter("quarter_end < '2003-01-01'")
    got = factors.bridge_nowcast(wide, ["a", "b"], low, threshold=1.0, most=2)
    sums = got.groupBy("quarter_end").agg(F.sum("nowcast").alias("n")).join(low, "quarter_end").collect()
    assert len(sums) == 12 and all(r.n == pytest.approx(r.total) for r in sums)
    truth = {m[0]: 2 + 3 * m[1] - m[2] for m in months}
    assert all(r.bridged == pytest.approx(truth[r.date]) for r in got.collect())  # the last quarter, without a total, too


def test_candidates_from_loadings(spark):
    irf = spark.createDataFrame([("T", "f1", 0, 2.0, 1.0, 0.04), ("T", "f1", 1, 3.0, 1.0, 0.01), ("T", "f2", 0, 1.0, 1.0, 0.5)], "treatment string, factor string, horizon int, beta double, se double, p double")
    loads = spark.createDataFrame([("f1", "a", 0.9), ("f1", "b", -0.8), ("f1", "T", 0.95), ("f1", "c", 0.1), ("f2", "a", 0.9), ("f2", "d", 1.0), ("f1", "x_blocked", 0.85)], "factor string, feature string, loading double")
    got = factors.candidates_from_loadings(irf, loads, per_factor=4, blocked_pattern="blocked")
    assert [(r.candidate, r.horizon, r.direction, round(r.factor_share, 3), round(r.score, 6), r.place) for r in got.orderBy("place").collect()] == [("a", 1, "positive", 0.5, 2.7, 1), ("b", 1, "negative", 1.0, 2.4, 2)]
    assert [r.candidate for r in factors.candidates_from_loadings(irf, loads, per_factor=4, least_share=0.6).orderBy("place").collect()] == ["x_blocked", "b"]
    corr = spark.createDataFrame([("a", 0.2), ("b", 0.95)], "feature string, outcome_corr double")
    assert [r.candidate for r in factors.candidates_from_loadings(irf, loads, per_factor=4, outcome_corr=corr, most_corr=0.9).collect()] == ["a"]


def test_domains_shift_places(spark):
    rng = random.Random(11)
    rows = [(g, t, (c := rng.gauss(0, 1)), (d := c + rng.gauss(0, 0.3)), (1.0 if g == "a" else 0.2) * d + rng.gauss(0, 0.2)) for g in "ab" for t in range(40)]
    df = spark.createDataFrame(rows, "g string, t int, c double, d double, y double")
    got = {(r.domain, r.g): r for r in shocks.domain_sensitivity(df, ["g"], "t", "y", "d", {"none": [], "c": ["c"]}).collect()}
    assert len(got) == 4 and got["none", "a"].place == 1 and all(r["shift"] == r.place - r.base_place for r in got.values())
    part = np.array([[r[2], r[3], r[4]] for r in rows if r[0] == "a"])
    left = part[:, 1] - np.polyval(np.polyfit(part[:, 0], part[:, 1], 1), part[:, 0])
    assert got["c", "a"].beta == pytest.approx(left @ (part[:, 2] - part[:, 2].mean()) / (left @ left))


def test_cointegration_finds_a_common_trend(spark):
    rng = random.Random(2)
    level, rows = 0.0, []
    for t in range(60):
        day = datetime.date(2000, 1, 1) + datetime.timedelta(days=t)
        level += rng.gauss(0, 1)
        rows += [("x", day, level), ("y", day, 2 * level + 1 + rng.gauss(0, 0.1)), ("exact", day, 3 * level)]
    panel = spark.createDataFrame(rows, "series string, date date, value double")
    pairs = spark.createDataFrame([("x", "y"), ("x", "exact")], "driver string, target string")
    got = screening.rolling_cointegration(panel, pairs, 40).collect()
    assert len(got) == 40 and all(r.regime == "cointegrated" and abs(r.beta - 2) < 0.1 for r in got if r.target == "y")
    assert all(r.t is None and r.regime == "none" for r in got if r.target == "exact")
