"""Vintages, errors and the choice of profiles, by hand."""

from macrotide.operators import policy


def test_vintages_and_revisions_by_hand(spark):
    low = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 30.0), ("b", 1, 5.0)], "k string, t int, x double")
    got = sorted((r.k, r.vintage, r.t) for r in policy.vintages(low, ["k"], "t", [0, 1, 3]).collect())
    assert got == [("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("a", 1, 1), ("a", 1, 2), ("b", 0, 1)]
    paths = [("a", 0, t, v) for t, v in enumerate([1.0, 2.0, 3.0, 4.0])] + [("a", 1, t, v) for t, v in enumerate([1.0, 4.0, 2.5])] + [("a", 1, 3, None), ("b", 0, 1, 1.0)]
    df = spark.createDataFrame(paths, "k string, vintage int, t int, x double")
    r = policy.revision_risk(df, ["k"], "t", "x").collect()
    assert [(x.k, x.vintage) for x in r] == [("a", 1)] and abs(r[0].revision_risk_mae - 2.5 / 3) < 1e-12 and r[0].revision_risk_max == 2
    last = policy.revision_risk(df, ["k"], "t", "x", tail=1).first()
    assert last.revision_risk_mae == last.revision_risk_max == 0.5


def test_errors_and_roughness_by_hand(spark):
    paths = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 1, 2, 3.0), ("a", 2, 3, 5.0), ("a", 2, 4, 9.0), ("b", 1, 1, 0.0), ("b", 1, 2, None)], "k string, block int, t int, x double")
    low = spark.createDataFrame([(1, 4.0), (2, 13.0), (3, 1.0)], "block int, target double")
    for conversion, want in (("sum", (0.5, 1.0)), ("mean", (4.0, 6.0)), ("first", (5.5, 8.0)), ("last", (2.5, 4.0))):
        r = {x.k: x for x in policy.benchmark_errors(paths, low, ["k"], "block", "t", "x", "target", conversion).collect()}
        assert (r["a"].benchmark_mae, r["a"].benchmark_max) == want, conversion
    rough = {r.k: r.roughness_score for r in policy.roughness(paths, ["k"], "t", "x").collect()}
    assert abs(rough["a"] - (0 + 2) / 2 / 4.5) < 1e-12 and rough["b"] is None


RUNS = "route string, profile string, task string, status string, selected_method string, selected_score double, improvement double, benchmark_mae double, roughness_score double, revision_risk_mae double"


def test_profiles_are_ranked_in_order(spark):
    runs = [
        ("r", "one", "t1", "ok", "denton", 1.0, 0.0, 0.0, 1.0, 1.0),
        ("r", "one", "t2", "ok", "Chow_Lin ", 3.0, 0.2, 0.0, 1.0, 2.0),
        ("r", "two", "t1", "ok", "denton", 2.0, 0.1, 0.0, 1.0, 0.5),
        ("r", "two", "t2", "ok", "", 2.0, 0.1, 0.0, 1.0, 1.5),
        ("r", "fails", "t1", "error", None, None, None, None, None, None),
        ("r", "fails", "t2", "ok", "denton", 0.1, 0.9, 0.0, 0.1, 0.1),
        ("r", "idle", "t1", "skipped", None, None, None, 9.0, 1.0, 1.0),
        ("q", "nan", "t1", "ok", "denton", float("nan"), None, 1.0, None, None),
        ("q", "rough", "t1", "ok", "denton", None, None, 1.0, 2.0, None),
        ("q", "smooth", "t1", "ok", "denton", None, None, 1.0, 1.0, None),
    ]
    got = {(r.route, r.profile): r for r in policy.rank_profiles(policy.profile_summary(spark.createDataFrame(runs, RUNS))).collect()}
    one = got["r", "one"]
    assert one.median_selected_score == 2 and one.mean_improvement == 0.1 and one.other_share == 0.5 and one.n_evaluated == 2
    # equal in failures, runs and scores: two revises less
    assert [p for p, _ in sorted(((p, r["place"]) for (q, p), r in got.items() if q == "r"), key=lambda x: x[1])] == ["two", "one", "idle", "fails"]
    assert [p for p, _ in sorted(((p, r["place"]) for (q, p), r in got.items() if q == "q"), key=lambda x: x[1])] == ["nan", "smooth", "rough"]
    assert got["r", "idle"].median_benchmark_mae is None and got["r", "fails"].failure_rate == 0.5 and got["r", "two"].other_share == 0
    assert policy.rank_profiles(policy.profile_summary(spark.createDataFrame([], RUNS))).count() == 0
