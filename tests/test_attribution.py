"""Attribution, channels, indicator quality, regimes and placebos on literals and against numpy."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrotide.operators import attribution, evaluation, evidence

from .test_evidence import windows


def test_attribution_equals_numpy(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=(40, 3))
    y = f @ [1.0, 0.5, 0.0] + rng.normal(size=40)
    rows = [("a", float(y[i]), *map(float, f[i])) for i in range(40)] + [("a", None, 1.0, 1.0, 1.0), ("a", 1.0, None, 1.0, 1.0), ("flat", 2.0, 1.0, 2.0, 3.0)] + [("flat", 2.0, *map(float, f[i])) for i in range(30)]
    rows += [("few", 1.0 * i, 1.0 * i, 2.0, 3.0) for i in range(5)]
    got = attribution.variance_attribution(spark.createDataFrame(rows, "g string, y double, f1 double, f2 double, f3 double"), ["g"], "y", ["f1", "f2", "f3"]).collect()
    r2 = {(r.g, r.factor): r.r2 for r in got}
    assert {r.g for r in got} == {"a", "flat"} and len(got) == 8 and {r.n for r in got if r.g == "a"} == {40}

    def share(x):
        z = np.column_stack([np.ones(40), x])
        u = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
        return 1 - u @ u / ((y - y.mean()) ** 2).sum()

    assert abs(r2["a", "all"] - share(f)) < 1e-10 and all(abs(r2["a", f"f{i + 1}"] - share(f[:, i : i + 1])) < 1e-10 for i in range(3))
    assert r2["flat", "all"] is None


def test_channels_by_hand(spark):
    responses = [("t", 1, "outcome", "y", 2.0, 0.02), ("t", 1, "factor", "f", 0.5, 0.04), ("t", 1, "factor", "g", -1.0, None), ("t", 2, "outcome", "y", 0.0, 0.2), ("t", 2, "factor", "f", 1.0, 0.01), ("u", 1, "outcome", "z", 1.0, 0.01)]
    links = [("y", "f", 3.0, 0.5, 0.8), ("y", "g", 1.0, 0.2, 0.8), ("y", "h", 1.0, 0.3, 0.8)]
    channels = attribution.channel_mediation(spark.createDataFrame(responses, "treatment string, horizon int, kind string, name string, beta double, p double"), spark.createDataFrame(links, "outcome string, factor string, beta double, share double, r2 double"))
    got = {(r.horizon, r.factor): r for r in attribution.rank_channels(channels).collect()}
    assert set(got) == {(1, "f"), (1, "g"), (2, "f")}
    r = got[1, "f"]
    assert (r.channel, r.weighted, r.mediated_share, r.screening_p) == (1.5, 0.75, 0.375, 0.04)
    assert got[1, "g"].screening_p == 0.02 and got[2, "f"].mediated_share is None and got[2, "f"].screening_p == 0.2
    # p of 0.02, 0.04, 0.2: q of 0.06, 0.06, 0.2
    assert [round(got[k].q, 9) for k in ((1, "g"), (1, "f"), (2, "f"))] == [0.06, 0.06, 0.2]
    assert [got[k].place for k in ((1, "f"), (1, "g"), (2, "f"))] == [1, 2, 3]  # equal q: the larger weighted channel first
    assert [got[k].priority for k in ((1, "f"), (2, "f"))] == ["strong", "weak"] and got[1, "f"].robust and not got[2, "f"].robust


def test_indicator_quality_by_hand(spark):
    y = [10.0, 20.0, 30.0, -40.0, 0.0, 60.0, None]
    a = [1.0, 2.0, 3.0, 4.0, None, 0.0, 1.0]
    b = [1.0, 4.0, 3.0, 4.0, None, 0.0, 1.0]
    rows = [("s", i, *v) for i, v in enumerate(zip(y, a, b))] + [("none", 0, 1.0, None, None), ("none", 1, 2.0, None, None)]
    got = {r.s: r for r in evaluation.indicator_quality(spark.createDataFrame(rows, "s string, t int, y double, a double, b double"), ["s"], "t", "y", ["a", "b"]).collect()}
    r, m, yy = got["s"], np.array([1, 3, 3, 4, 0.0]), np.array([10, 20, 30, -40, 60.0])
    assert r.n == 6 and abs(r.coverage - 5 / 6) < 1e-12 and r["rank"] == 2
    assert abs(r.strength - (np.std([1, 2, 3, 4, 0]) + np.std([1, 4, 3, 4, 0])) / 2) < 1e-12
    rs = [abs(np.corrcoef(c, yy)[0, 1]) for c in ([1, 2, 3, 4, 0], [1, 4, 3, 4, 0])]
    assert abs(r["corr"] - max(rs)) < 1e-12 and abs(r.corr_mean - np.mean(rs)) < 1e-12 and abs(r.corr_median - np.median(rs)) < 1e-12
    assert abs(r.growth_corr - np.corrcoef(np.diff(m), np.diff(yy))[0, 1]) < 1e-12
    assert (r.zero_share, r.negative_share, r.target_zero_share, r.target_negative_share) == (0.2, 0.0, 0.0, 0.2)
    off = np.abs(m - 3)  # median distance 1
    assert r.outliers == 0 and abs(r.outlier_z - off.max() / 1.4826) < 1e-12
    ratio = yy[:4] / m[:4]
    assert r.ratio_share == 0.8 and abs(r.ratio_cv - np.std(ratio) / abs(ratio.mean())) < 1e-12
    assert abs(r.ratio_median - np.median(np.abs(ratio))) < 1e-12 and abs(r.ratio_drift - abs(np.median(ratio[2:]) - np.median(ratio[:2])) / np.median(np.abs(ratio))) < 1e-12
    n = got["none"]
    assert (n.coverage, n["rank"], n.strength, n["corr"], n.outliers, n.ratio_share, n.ratio_drift) == (0, 0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("columns, rank", [([[1, 2, 3], [2, 4, 6]], 1), ([[1, 0, 0], [1, 1, 0], [2, 1, 0]], 2), ([[0, 0, 0]], 0), ([[1, 5, 2], [2, 2, 1], [0, 1, 7]], 3)])
def test_rank_from_products(spark, columns, rank):
    x = np.array(columns, float)
    gram = (x @ x.T).ravel().tolist()
    got = spark.createDataFrame([(gram,)], "g array<double>").select(evaluation.gram_rank(F.col("g"), len(columns)).alias("r")).first()
    assert got.r == rank


def dated(spark):
    """The windows of ``test_evidence`` in order, one a month from January 2000."""
    rows = [(*w, date(2000, 1 + i, 28)) for i, w in enumerate(windows(spark).collect())]
    return spark.createDataFrame(rows, "pair string, model string, r double, p double, t double, beta double, alpha double, date date")


def test_regimes_by_hand(spark):
    df = dated(spark).filter("pair = 'a'")
    days = spark.createDataFrame([(date(2000, 1, 1),), (date(2000, 3, 1),), (date(2005, 1, 1),)], "d date")
    named = [r.x for r in days.select("d", evidence.regime_of(F.col("d"), ["2000-03-01", "2001-01-01"], ["old"]).alias("x")).orderBy("d").collect()]
    assert named == ["old", "regime_2", "regime_3"]
    parts = {}
    for name, held in (("one", df.filter("date < '2000-05-01'")), ("two", df.filter("date >= '2000-05-01'"))):
        parts[name] = {r.direction: r.score for r in evidence.directional_scores(held, ["pair"]).collect()}
    for combine, want in (
        ("min", lambda a, b: min(a, b)),
        ("mean", lambda a, b: (a + b) / 2),
        ("weight", lambda a, b: 0.25 * a + 0.75 * b),
        ("share", lambda a, b: (4 * a + 3 * b) / 7),
    ):
        got = {r.direction: r for r in evidence.regime_scores(df, ["pair"], ["2000-05-01"], weights=[1, 3], combine=combine).collect()}
        for side in ("positive", "negative"):
            assert abs(got[side].score - want(parts["one"][side], parts["two"][side])) < 1e-9, combine
            assert got[side].regimes == 2 and got[side].dominant == "regime_1" and abs(got[side].dominant_share - 4 / 7) < 1e-12
    alone = {r.direction: r for r in evidence.regime_scores(df, ["pair"], ["2000-05-01"], min_windows=4).collect()}
    whole = {r.direction: r.score for r in evidence.directional_scores(df, ["pair"]).collect()}
    assert alone["positive"].regimes == 0 and alone["positive"].dominant is None and abs(alone["positive"].score - whole["positive"]) < 1e-12


def test_placebos(spark):
    df = dated(spark).withColumn("target", F.lit("t"))
    got = {r.direction: r for r in evidence.placebo_flip(df, "target", "pair").collect()}
    scores = {(r.pair, r.direction): r.score for r in evidence.directional_scores(df, ["target", "pair"]).collect()}
    p = got["positive"]
    assert p.candidates == 3 and p.top == "a" and abs(p.top_score - scores["a", "positive"]) < 1e-12
    best = max("abc", key=lambda k: scores[k, "negative"])
    assert p.placebo_top == best and abs(p.placebo_top_score - scores[best, "negative"]) < 1e-9 and p.top_match == (best == "a")
    x, y = ([scores[k, d] for k in "abc"] for d in ("positive", "negative"))
    assert abs(p.score_corr - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(p.delta - (p.placebo_top_score - p.top_score)) < 1e-12
    drawn = {(r.pair, r.direction): r for r in evidence.sign_randomization(df, ["target", "pair"], draws=40).collect()}
    again = {(r.pair, r.direction): r.empirical_p for r in evidence.sign_randomization(df, ["target", "pair"], draws=40).collect()}
    assert {k: v.empirical_p for k, v in drawn.items()} == again and all(r.draws == 40 for r in drawn.values())
    # b's two windows agree in sign: one draw in four, about, keeps both; a score of 0 is always reached
    assert drawn["b", "positive"].empirical_p == 1 and 3 / 41 < drawn["b", "negative"].empirical_p < 20 / 41
    assert math.isclose(drawn["b", "negative"].score, scores["b", "negative"])
