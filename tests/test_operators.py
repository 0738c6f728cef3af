"""Operators on small literal series."""

import datetime as dt
import math

from pyspark.sql import functions as F

from macrotide.functions.columns import clip, normal_p
from macrotide.operators import calendar, cleaning, events, inference


def series(spark, values, start=(2020, 1), name="s"):
    rows = []
    for i, v in enumerate(values):
        y, m = divmod(start[1] - 1 + i, 12)
        first = dt.date(start[0] + (y + (m + 1) // 12), (m + 1) % 12 + 1, 1)
        rows.append((name, first - dt.timedelta(1), None if v is None else float(v)))
    return spark.createDataFrame(rows, "series string, date date, value double")


def values(df, column):
    return [r[0] for r in df.orderBy("date").select(column).collect()]


def test_cleaning_removes_an_outlier_and_fills_a_gap(spark):
    panel = series(spark, [1, 2, 3, 100, None, 5, 6, 7])
    assert panel.filter("value is null").count() == 1
    winsorized = cleaning.winsorize(panel, 0.0, 0.9).select("series", "date", F.col("winsorized").alias("value"))
    filtered = cleaning.hampel(winsorized, 3, 3.0).select("series", "date", F.col("filtered").alias("value"))
    out = values(cleaning.fill_time(filtered), "filled")
    assert len(out) == 8 and None not in out and max(out) < 100


def test_bounds_and_smoothing_stay_within_bounds(spark):
    panel = series(spark, range(-10, 41, 10)).withColumn("value", clip(F.col("value"), 0.0, 25.0))
    assert all(0 <= v <= 25 for v in values(cleaning.smooth(panel, 2), "smoothed"))


def test_ema_by_hand(spark):
    assert values(cleaning.ema(series(spark, [1, 2, None, 4]), 3), "ema") == [1.0, 1.5, 1.5, 2.75]


def test_holm_by_hand(spark):
    rows = spark.createDataFrame([("f", k, p) for k, p in zip("abcd", (0.02, 0.10, 0.01, 0.20))] + [("f", "e", None)], "family string, k string, p double")
    got = {r.k: r.holm for r in inference.step_up(rows, ["family"], ["k"]).collect()}
    assert got["e"] is None
    assert [round(got[k], 9) for k in "abcd"] == [0.06, 0.2, 0.04, 0.2]


def test_romano_wolf_by_hand(spark):
    hypotheses = spark.createDataFrame([("f", "a", 3.2), ("f", "b", 2.1), ("f", "c", 1.0)], "family string, k string, abs_t double")
    null = [(1.0, 0.5, 0.4), (2.0, 2.5, 0.2), (0.1, 0.2, 1.5), (3.5, 0.3, 1.2)]
    draws = spark.createDataFrame([("f", k, i, t) for i, row in enumerate(null) for k, t in zip("abc", row)], "family string, k string, draw int, null_t double")
    got = {r.k: r.romano_wolf for r in inference.romano_wolf(hypotheses, draws, ["family"], ["k"]).collect()}
    assert [round(got[k], 9) for k in "abc"] == [0.4, 0.4, 0.6]


def test_calibration_by_hand(spark):
    targets = spark.createDataFrame([("t", 5.0)], "name string, z double")
    controls = spark.createDataFrame([("a", 0.5), ("b", -0.4), ("c", 0.25)], "name string, z double")
    row = inference.control_calibration(targets, controls, least=3).first()
    assert row.empirical_p == 0.25 and row.inflation == 1.0


def test_lags_never_look_past_the_cutoff(spark):
    days = [("s", dt.date(2020, 1, 1) + dt.timedelta(i), float(i)) for i in range(200)]
    panel = spark.createDataFrame(days, "series string, date date, value double")
    cutoffs = spark.createDataFrame([(dt.date(2020, 6, 30), dt.date(2020, 4, 1))], "quarter_end date, cutoff date")
    later = panel.withColumn("value", F.when(F.col("date") > F.lit("2020-04-01").cast("date"), -1.0).otherwise(F.col("value")))
    a, b = (sorted(map(tuple, calendar.lag_grid(p, cutoffs, {"d": 5, "w": 3, "m": 2, "q": 1}).collect())) for p in (panel, later))
    assert a == b and len(a) == 11 and all(r[-1] <= dt.date(2020, 4, 1) for r in a)


def test_events_are_thinned_greedily(spark):
    rows = spark.createDataFrame([("s", i) for i in (1, 3, 5, 6, 9, 30)], "series string, i int")
    assert sorted(r.i for r in events.thinned(rows, 4).collect()) == [1, 5, 9, 30]


def test_pro_rata_keeps_the_totals(spark):
    seed = series(spark, range(1, 7), (2019, 1))
    low = spark.createDataFrame([("s", dt.date(2019, 3, 31), 100.0), ("s", dt.date(2019, 6, 30), 120.0)], "series string, quarter_end date, total double")
    out = values(calendar.pro_rata(low, seed), "scaled")
    assert math.isclose(sum(out[:3]), 100) and math.isclose(sum(out[3:]), 120) and min(out) > 0


def test_normal_p(spark):
    row = spark.range(1).select(*[normal_p(F.lit(z)).alias(f"z{i}") for i, z in enumerate((0.0, 1.0, -1.96, 3.0))]).first()
    assert all(abs(p - math.erfc(abs(z) / math.sqrt(2))) < 2e-7 for p, z in zip(row, (0.0, 1.0, -1.96, 3.0)))


def test_empty_panels(spark):
    empty = series(spark, [])
    for out in (cleaning.winsorize(empty, 0.1, 0.9), cleaning.fill_time(empty), cleaning.ema(empty, 3), calendar.resample(empty, "M"), calendar.month_grid(empty)):
        assert out.count() == 0


def test_denton_meets_the_totals_and_keeps_a_line(spark):
    from macrotide.operators import denton

    low = spark.createDataFrame([("s", dt.date(2019, 3 * q, 28), float(9 * q - 3)) for q in (1, 2, 3, 4)] + [("t", dt.date(2019, 3, 28), 5.0), ("t", dt.date(2019, 6, 28), 5.0)], "series string, date date, value double")
    rows = denton.denton_panel(low, 3).collect()
    path = [r.path for r in sorted(rows, key=lambda r: (r.date, r.slot)) if r.series == "s"]
    assert all(abs(a - b) < 1e-4 for a, b in zip(path, range(1, 13)))
    assert abs(sum(r.path for r in rows if r.series == "t") - 10) < 1e-6
