"""Versions held against each other, counts in ranges, long chains of groups, and limiting series, by hand."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from macrotide.operators import comparison, inference, policy, screening, selection

RESULTS = "version string, t string, o string, estimate double, p double"
ROWS = [
    ("a", "t", "o1", 3.0, 0.01), ("a", "t", "o2", -2.0, 0.5), ("a", "t", "o3", 1.0, 0.02), ("a", "t", "o4", 0.5, 0.9),
    ("b", "t", "o1", 1.0, 0.2), ("b", "t", "o2", 2.0, 0.04), ("b", "t", "o3", 0.5, 0.03), ("b", "t", "o5", 9.0, 0.9),
]


def test_shifts_by_hand(spark):
    df = spark.createDataFrame(ROWS, RESULTS)
    got = {r.o: (r.sign_flip, r.significance_flip, r.rank_shift) for r in comparison.domain_shift(df, ["t", "o"], "version", "a", "b", ["t"]).collect()}
    # places: a is o1, o2, o3, o4; b is o5, o2, o1, o3
    assert got == {"o1": (0, 1, 2), "o2": (1, 1, 0), "o3": (0, 0, 1)}
    r = comparison.spec_stability(df, ["t", "o"], "version", "a", "b", ["t"]).collect()
    assert len(r) == 1 and r[0].n == 3
    assert (round(r[0].sign_match, 9), round(r[0].priority_match, 9), r[0].median_shift, r[0].key_retention) == (round(2 / 3, 9), round(1 / 3, 9), 1.0, 0.5)
    assert abs(r[0].score - (0.4 * 2 / 3 + 0.3 / 3 + 0.1 + 0.05)) < 1e-12
    none = comparison.spec_stability(df.withColumn("p", F.lit(0.9)), ["t", "o"], "version", "a", "b", ["t"]).first()
    assert none.key_retention == 0 and none.priority_match == 1
    assert [x.baseline for x in comparison.choose_baseline(df, ["t", "o"], "version", ["t"], ["b"]).collect()] == ["b"]
    more = df.unionByName(spark.createDataFrame([("a", "t", "o9", 1.0, 1.0)], RESULTS))
    assert comparison.choose_baseline(more, ["t", "o"], "version", ["t"], ["b"]).first().baseline == "a"
    assert comparison.domain_shift(df.limit(0), ["t", "o"], "version", "a", "b", ["t"]).count() == 0


def test_counts_in_ranges(spark):
    rng = np.random.default_rng(0)
    z = np.round(rng.normal(size=300), 1)
    rows = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(z)] + [(None, 1)], "z double, c int")
    got = {r.z: (r.own, r.below, r.total) for r in inference.ranged_sums(rows, "z", F.col("c")).collect()}
    odd = z[1::2]
    assert all(got[float(v)] == ((odd == v).sum(), (odd < v).sum(), 150) for v in z) and len(got) == len(set(z.tolist()))
    targets = spark.createDataFrame([("t", 1.05), ("u", None)], "name string, z double")
    controls = spark.createDataFrame([("c", float(v)) for v in z[:40]] + [("n", None)], "name string, z double")
    found = {r["name"]: r for r in inference.control_calibration(targets, controls).collect()}
    size = np.abs(z[:40])
    assert abs(found["t"].empirical_p - (1 + (size >= 1.05).sum()) / 41) < 1e-12 and found["t"].n_controls == 40 and found["u"].empirical_p is None
    assert abs(found["t"].inflation - max(1, np.percentile(size, 95) / 1.96)) < 1e-9
    assert inference.control_calibration(targets, controls.limit(3)).count() == 0


def test_a_chain_of_seventy_series_is_one_group(spark):
    """Series next to each other share half of what moves them, others nothing."""
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(71, 400))
    moves = np.linalg.qr(moves.T - moves.T.mean(0))[0].T  # no two correlate
    order = rng.permutation(70)
    rows = [(f"s{order[i]:02d}", date(2000, 1, 1) + timedelta(days=t), float(moves[i, t] + moves[i + 1, t])) for i in range(70) for t in range(400)]
    rows += [("t", date(2000, 1, 1) + timedelta(days=t), float(rng.normal())) for t in range(400)]
    got = {r.series: r.group for r in selection.indicator_groups(spark.createDataFrame(rows, "series string, date date, value double"), 0.45).collect()}
    assert {g for s, g in got.items() if s != "t"} == {"s00"} and got["t"] == "t" and len(got) == 71


def test_limiting_series_by_hand(spark):
    panel = spark.createDataFrame([("a", date(2000, 1, 1), 1.0), ("a", date(1999, 1, 1), None), ("b", date(2001, 1, 1), 1.0), ("c", date(2001, 1, 1), 2.0), ("d", date(2001, 1, 1), None)], "series string, date date, value double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")], "left_series string, right_series string")
    got = {(r.left_series, r.right_series): (r.start, r.limiting, r.times) for r in selection.limiting_series(panel, pairs).collect()}
    assert got == {("a", "b"): (date(2001, 1, 1), "b", 2), ("a", "c"): (date(2001, 1, 1), "c", 1), ("b", "c"): (date(2001, 1, 1), "b", 2)}


def test_headlines_and_ranges_by_hand(spark):
    rows = [("tmle", "y", 0.01, 1.0), ("tmle", "y", 0.1, 2.0), ("tmle", "y", 0.04, 3.0), ("tmle", "y", 0.06, 4.0), ("tmle", None, None, 5.0), ("tmle", None, 0.5, 6.0), ("tmle", "z", None, 7.0), ("lp", "y", None, 8.0), ("lp", "y", 0.05, 9.0), (None, "y", 0.05, 10.0)]
    df = spark.createDataFrame(rows, "estimator string, o string, eps double, v double")
    assert sorted(r.v for r in comparison.headline_rows(df, ["o"]).collect()) == [3.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    assert sorted(r.v for r in comparison.headline_rows(df, ["o"], target=0.1).collect())[0] == 2.0
    base = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "k string, score double")
    variants = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", None), ("d", 1.0)], "k string, score double")
    got = {r.k: (r.least, r.greatest, r.variants, r.place) for r in comparison.variant_range(base, variants, ["k"]).collect()}
    assert got == {"b": (None, None, 0, 1), "a": (0.5, 2.0, 2, 2), "c": (None, None, 0, 3)}


def test_usage_by_hand(spark):
    schema = "status string, method_used string, method string, route string, low string, high string, constraint string, constraint_type string, conversion string"
    a = [(" OK", "Denton ", "x", "q->m", None, None, " Sum", None, None), ("ok", " ", "Chow", None, "y", "q", None, "", "Last"), ("ok", None, None, "q->m", "", "", "s", "", ""), ("error", "denton", "x", "q->m", "", "", "sum", "", ""), ("ok", "denton", "", "plain", "q", "q", "", "mean", "last")]
    b = [("ok", "denton", "x", "Q -> M", None, None, "sum", None, None), ("ok", "denton", "x", "q->m", None, None, "sum", None, None), ("ok", "denton", "x", None, "q", "q", None, None, None)]
    got = sorted(map(tuple, policy.usage_compare(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()))
    assert got == [("", "", "denton", 0, 1, 1), ("PLAIN", "mean", "denton", 1, 0, -1), ("Q->M", "sum", "denton", 1, 2, 1), ("Y->Q", "last", "chow", 1, 0, -1)]
    one, two = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "k string, value double"), spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 1.0)], "k string, value double")
    assert sorted((r.k, r.delta, r.ratio) for r in policy.metric_compare(one, two, ["k"]).collect()) == [("a", 1.0, 1.5), ("b", 1.0, None), ("c", None, None)]


def test_bootstrap_draws_whole_blocks(spark):
    """All windows alike: whatever is drawn scores the same."""
    rows = [("g", i, 0.5, 0.02) for i in range(1, 17)] + [("one", 1, 0.5, 0.02)]
    got = screening.bootstrap_scores(spark.createDataFrame(rows, "k string, i long, r double, p double"), ["k"], draws=30).collect()
    want = 100 * 0.8 * 0.5 * (16 * 0.8) / (16 * 0.8 + 12)
    assert len(got) == 1 and got[0].draws == 30 and abs(got[0].q05 - want) < 1e-9 and abs(got[0].q95 - want) < 1e-9
