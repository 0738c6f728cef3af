"""Denton paths against dense solves, and panels by hand."""

import time
from datetime import date

import numpy as np
import pandas as pd
import pytest

from macrotide.operators import denton


def dense(values, per, conversion, power, ridge, prior):
    """The whole Kuhn-Tucker system at once."""
    n = len(values) * per
    d = np.diff(np.eye(n), power, axis=0)
    h = d.T @ d + ridge * np.eye(n)
    w = {"sum": np.ones(per), "mean": np.full(per, 1 / per), "first": np.eye(per)[0], "last": np.eye(per)[-1]}[conversion]
    held = np.isfinite(values)
    c = np.kron(np.eye(len(values)), w)[held]
    kkt = np.block([[h, c.T], [c, np.zeros((held.sum(),) * 2)]])
    return np.linalg.solve(kkt, np.concatenate([h @ prior, values[held]]))[:n]


@pytest.mark.parametrize("conversion", denton.CONVERSIONS)
@pytest.mark.parametrize("power", [1, 2])
@pytest.mark.parametrize("per", [2, 3, 4, 12])
def test_blocks_equal_the_dense_solve(conversion, power, per):
    rng = np.random.default_rng(per)
    values = 100 + np.cumsum(rng.normal(size=15))
    prior = rng.normal(size=15 * per)
    for p, v in ((np.zeros(15 * per), values), (prior, values), (prior, np.where(np.arange(15) % 4 == 2, np.nan, values))):
        got = denton.smoothest(v, per, conversion, power, 1e-6, p)
        assert np.allclose(got, dense(v, per, conversion, power, 1e-6, p), rtol=1e-6, atol=1e-6)
    meets = got.reshape(15, per) @ denton.weights_of(per, conversion)
    held = np.isfinite(v)
    assert np.allclose(meets[held], v[held])


def test_long_series_are_fast():
    values = 50 + np.cumsum(np.random.default_rng(0).normal(size=2000))
    began = time.time()
    path = denton.smoothest(values, 12)
    assert time.time() - began < 1 and np.allclose(path.reshape(-1, 12).sum(1), values, atol=1e-6)
    assert np.abs(np.diff(path, 2)).max() < 1


def test_short_series_and_bad_arguments(spark):
    assert np.allclose(denton.smoothest(np.array([6.0]), 2, "sum"), [3, 3])
    assert np.allclose(denton.smoothest(np.array([6.0]), 4, "sum"), 1.5, atol=1e-6)
    with pytest.raises(ValueError):
        denton.smoothest(np.array([1.0, 2.0]), 1)
    low = spark.createDataFrame([("a", date(2020, 3, 31), 1.0)], "series string, date date, value double")
    with pytest.raises(ValueError):
        denton.denton_panel(low, 3, "median")


def test_prior_anchors_by_hand():
    # two years of months from January 2020: sums 120 and 240, anchored at the ends of July
    path = denton.anchored(np.array([2020 * 12, 2021 * 12]), np.array([120.0, 240.0]), 12, 12, "sum")
    assert np.allclose(path[:7], 10) and np.allclose(path[18:], 20)
    days = (date(2021, 1, 31) - date(2020, 7, 31)).days / 365
    assert abs(path[12] - (10 + 10 * days)) < 1e-12
    quarters = denton.anchored(np.array([2020 * 12, 2021 * 12]), np.array([1.0, 2.0]), 12, 4, "mean")
    assert quarters[1] == 1 and quarters[5] == 2 and abs(quarters[2] - (1 + (date(2020, 9, 30) - date(2020, 6, 30)).days / 365)) < 1e-12
    assert denton.anchored(np.array([2020 * 12, 2021 * 12]), np.array([1.0, 2.0]), 12, 4, "first")[4] == 2
    assert denton.anchored(np.array([2020 * 12, 2021 * 12, 2022 * 12]), np.array([1.0, np.nan, 3.0]), 12, 4, "last")[7] == pytest.approx(2, abs=0.01)


def test_positive_blocks_by_hand():
    path = np.array([-1.0, 2.0, 3.0, -1.0, -2.0, -3.0])
    assert np.allclose(denton.positive_blocks(path, np.array([10.0, 6.0]), 3, "sum"), [0, 4, 6, 2, 2, 2])
    assert np.allclose(denton.positive_blocks(path, np.array([10.0, 6.0]), 3, "mean"), [0, 12, 18, 6, 6, 6])
    assert np.allclose(denton.positive_blocks(path, np.array([4.0, -6.0]), 3, "last"), [0, 2, 4, 0, 0, 0])
    assert np.allclose(denton.positive_blocks(path, np.array([4.0, np.nan]), 3, "first"), [4, 2, 3, 0, 0, 0])


@pytest.mark.parametrize("mode, per, span, conversion, power", [("classic", 3, 3, "sum", 2), ("classic", 4, 12, "last", 2), ("prior", 12, 12, "mean", 1), ("prior", 4, 12, "sum", 2)])
def test_panels(spark, mode, per, span, conversion, power):
    rng = np.random.default_rng(9)
    rows, series = [], {}
    for s in range(4):
        values = 100 + np.cumsum(rng.normal(size=9 + s))
        dates = [date(2000 + (i * span) // 12, (i * span) % 12 + span, 28) for i in range(len(values))]
        series[f"s{s}"] = list(zip(dates, values))
        rows += [(f"s{s}", d, float(v)) for d, v in zip(dates, values)]
    rows = [r for r in rows if r[:2] != ("s1", series["s1"][3][0])] + [("s2", date(2050, 1, 1), None)]
    low = spark.createDataFrame(rows, "series string, date date, value double")
    got = denton.denton_panel(low, per, conversion, mode, span, power).toPandas()
    for name, items in series.items():
        own = got[got.series == name].sort_values(["period", "slot"])
        gap = name == "s1"
        values = np.array([v for i, (d, v) in enumerate(items) if not (gap and i == 3)])
        if mode == "classic":
            want = dense(values, per, conversion, 2, 1e-8, np.zeros(len(values) * per))
        else:
            values = np.array([np.nan if gap and i == 3 else v for i, (d, v) in enumerate(items)])
            starts = 2000 * 12 + np.arange(len(values)) * span
            want = dense(values, per, conversion, power, 1e-6, denton.anchored(starts, values, span, per, conversion))
            assert own.date.isna().sum() == (per if gap else 0)
        assert np.allclose(own.path, want, rtol=1e-5, atol=1e-5)
    assert denton.denton_panel(low.limit(0), per, conversion, mode, span).count() == 0
    twice = spark.createDataFrame([("a", date(2020, 1, 31), 1.0), ("a", date(2020, 1, 30), 1.0)], low.schema)
    with pytest.raises(Exception, match="two values"):
        denton.denton_panel(twice, 3).count()
    assert isinstance(got, pd.DataFrame)
