"""Gates, fragility and control screens on literals."""

import datetime
import random

import numpy as np
import pytest

from macrotide.operators import gates


def test_reasons_of_gates(spark):
    df = spark.createDataFrame([("a", True, True), ("b", False, None), ("c", None, False), ("d", False, False)], "k string, lead boolean, wspec boolean")
    assert {r.k: (r.action, r.reasons) for r in gates.gate_summary(df, ["k"], ["lead", "wspec"]).collect()} == {"a": ("hold", "PASS"), "b": ("demote", "LEAD_FAIL"), "c": ("demote", "WSPEC_FAIL"), "d": ("demote", "LEAD_FAIL;WSPEC_FAIL")}
    strict = {r.k: r.reasons for r in gates.gate_summary(df, ["k"], ["lead", "wspec"], missing_fails=True).collect()}
    assert strict["b"] == "LEAD_FAIL;WSPEC_FAIL" and strict["a"] == "PASS"


def test_shares_reach_their_limits(spark):
    rows = [("a", True, False)] + [("a", False, True)] * 9 + [("b", None, False)] * 4
    df = spark.createDataFrame(rows, "g string, lead boolean, wspec boolean")
    got = {r.g: r for r in gates.fragility_shares(df, ["g"], {"lead": 0.1, "wspec": 0.95}).collect()}
    assert (got["a"].lead_share, got["a"].lead_fragile, got["a"].wspec_fragile, got["a"].fragile) == (0.1, True, False, True)
    assert (got["b"].lead_share, got["b"].lead_fragile, got["b"].fragile) == (0.0, False, False)


def test_controls_are_like_the_outcome_and_still(spark):
    rng = random.Random(4)
    t = [rng.gauss(0, 1) for _ in range(60)]
    y = [rng.gauss(0, 1) for _ in range(60)]
    series = {"alike": [v + rng.gauss(0, 0.1) for v in y], "moved": [0.3 * y[k] + (t[k - 2] if k > 1 else 0) for k in range(60)], "other": [rng.gauss(0, 1) * (k % 2) for k in range(60)], "flat": [1.0] * 60, "Y": y}
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(days=k)
    panel = spark.createDataFrame([(s, day(k), float(v)) for s, vs in series.items() for k, v in enumerate(vs)], "series string, date date, value double")
    questions = spark.createDataFrame([("T", "Y", day(k), t[k], y[k]) for k in range(60)], "treatment string, outcome string, date date, t double, y double")
    got = {r.candidate: r for r in gates.control_screen(panel, questions, most_t=3.0, k=1).collect()}
    assert set(got) == {"alike", "moved", "other", "flat"} and (got["alike"].decision, got["alike"].place) == ("select", 1)
    assert "NULL_SCREEN_FAIL" in got["moved"].reasons and got["flat"].reasons == "SIMILARITY_FAIL;NULL_SCREEN_FAIL" and got["flat"].similarity is None
    c = np.array(series["alike"])
    ts = []
    for h in range(1, 5):
        r = np.corrcoef(t[:-h], c[h:])[0, 1]
        ts.append(abs(r) * np.sqrt((60 - h - 2) / (1 - r * r)))
    assert got["alike"].lead_t == pytest.approx(max(ts)) and got["alike"].score == pytest.approx(0.65 * got["alike"].similarity + 0.35 / (1 + max(ts)))


FITS = "k int, obs_per_regressor double, condition double, rank_deficit int, selected int, dropped int, capped boolean, skip_reason string"


def test_reliability_tiers_by_hand(spark):
    rows = [
        (1, 5.0, 10.0, 0, 4, 0, False, None),  # best rows, best condition, nothing dropped
        (2, 4.0, 100.0, 0, 4, 1, False, None),
        (3, 3.0, 1e4, 0, 4, 0, True, None),
        (4, 2.0, 1e6, 0, 0, 1, None, None),  # nothing selected: the share is of one
        (5, 1.2, 10.0, 0, 4, 0, False, None),  # too few rows
        (6, 5.0, 1e11, 0, 4, 0, False, None),
        (7, 5.0, 10.0, 1, 4, 0, False, None),
        (8, 9.0, 1.0, 0, 4, 0, False, "no_rows"),
        (9, None, 10.0, 0, 4, 0, False, None),  # no score
    ]
    got = {r.k: r for r in gates.reliability_tiers(spark.createDataFrame(rows, FITS)).collect()}
    # shares at or below: rows 4, 3, 2, 1 of four; conditions of 1 and 9 tie at (4 + 5) / 2 of five; drops of 1, 3, 9 tie at 4 of five
    want = {1: 0.5 + 0.3 * 4.5 / 5 + 0.2 * 4 / 5, 2: 0.5 * 3 / 4 + 0.3 * 3 / 5 + 0.2 * 2 / 5 - 0.1, 3: 0.5 * 2 / 4 + 0.3 * 2 / 5 + 0.2 * 4 / 5 - 0.1, 4: 0.5 / 4 + 0.3 / 5 + 0.2 / 5 - 0.1}
    for k, v in want.items():
        assert abs(got[k].score - v) < 1e-12, k
    assert [got[k].tier for k in range(1, 10)] == ["high", "medium", "medium", "low", "low", "low", "low", "skip", "low"]
    assert got[9].score is None and got[5].score is None and got[5].hard_low and got[4].dropped_share == 1 and got[2].dropped_share == 0.25
    assert gates.reliability_tiers(spark.createDataFrame([], FITS)).count() == 0


def test_capped_fits_need_more_for_high(spark):
    base = [(k, 1.5, 1e9, 0, 4, 0, False, None) for k in range(10, 30)]
    rows = [(1, 5.0, 10.0, 0, 4, 0, True, None), (2, 2.9, 20.0, 0, 4, 0, True, None), *base]
    got = {r.k: r for r in gates.reliability_tiers(spark.createDataFrame(rows, FITS)).collect()}
    # 1: 0.5 + 0.3 + 0.2 * 11.5 / 22 - 0.1; below 0.85, so that the cap keeps it from high
    assert abs(got[1].score - (0.7 + 0.2 * 11.5 / 22)) < 1e-12 and got[1].tier == "medium" and got[2].tier == "medium"
    free = {r.k: r for r in gates.reliability_tiers(spark.createDataFrame([(1, 5.0, 10.0, 0, 4, 0, False, None), *base], FITS)).collect()}
    assert free[1].tier == "high"


def test_recipes_by_hand(spark):
    from datetime import date

    from macrotide.operators import recipes

    values = {"a": [1.0, 3.0, 6.0, 10.0, 15.0, 21.0], "b": [2.0, 4.0, 8.0, 16.0, 32.0, 64.0], "c": [0.0, 3.0, 8.0, None, 24.0, 35.0], "none": [1.0] * 6}
    days = [date(2020, m, 28) for m in range(1, 7)]
    panel = spark.createDataFrame([(s, d, v) for s, row in values.items() for d, v in zip(days, row)], "series string, date date, value double")
    table = spark.createDataFrame([("a", None, 2, 1, 1, None), ("b", None, 1, 0, None, "multiplicative"), ("c", 0.5, 0, None, 3, "additive")], "series string, lam double, diff_order int, seasonal_diff_order int, period int, adjustment string")
    seasonal = spark.createDataFrame([("b", d, f) for d, f in zip(days, [2.0, 1.0, 2.0, 0.0, 2.0, 1.0])] + [("c", days[1], 3.0), ("a", days[5], 9.0)], "series string, date date, part double")
    out = {}
    for r in recipes.replay(panel, table, seasonal).collect():
        out.setdefault(r.series, {})[r.date] = r.replayed
    assert sorted(out) == ["a", "b", "c"]
    got = {s: [v[d] for d in days] for s, v in out.items()}
    assert got["a"] == [None, None, None, None, 0.0, 0.0]  # second differences are 1 throughout; a period of 1 counts as 2
    assert got["b"] == [None, 3.0, 0.0, None, None, 48.0]  # 1, 4, 4, none, 16, 64
    assert [None if v is None else round(v, 9) for v in got["c"]] == [0.0, 0.0, 4.0, None, 8.0, 10.0]  # 2 (sqrt(1 + x) - 1)
    assert recipes.replay(panel, table.limit(0)).count() == 0
