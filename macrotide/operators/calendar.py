"""Frequencies: resampling, stacking, spreading, as-of lookups and lag grids of long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter_end(d: Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter").cast("date")


def period_end(d: Column, freq: str) -> Column:
    """The last day of the period that holds a date: D, W (Sunday), M, Q or Y."""
    ends = {"D": d, "W": F.date_add(F.trunc(d, "week"), 6), "M": F.last_day(d), "Q": quarter_end(d), "Y": F.make_date(F.year(d), F.lit(12), F.lit(31))}
    return ends[freq]


def resample(panel: DataFrame, freq: str, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Sum, mean, first and last of the values in each period; periods without values are left out."""
    held = panel.filter(F.col(x).isNotNull())
    return held.groupBy(by, period_end(F.col(at), freq).alias("period")).agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min_by(x, at).alias("first"), F.max_by(x, at).alias("last"))


def stack_months(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Months as m1, m2 and m3 of their quarter's end."""
    slot = (F.month(at) - 1) % 3 + 1
    return panel.groupBy(by, quarter_end(F.col(at)).alias("quarter_end")).agg(*[F.max(F.when(slot == k, F.col(x))).alias(f"m{k}") for k in (1, 2, 3)])


def selective_stack(panel: DataFrame, density: float = 2.0, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(series, slot, quarter_end, value): dense series as three slots a quarter, others as their quarterly mean (slot 0)."""
    held = panel.filter(F.col(x).isNotNull())
    quarters = F.months_between(quarter_end(F.max(at)), quarter_end(F.min(at))) / 3 + 1
    dense = held.groupBy(by).agg((F.count("*") / quarters >= density).alias("dense"))
    rows = held.join(dense, by).withColumn("slot", F.when(F.col("dense"), (F.month(at) - 1) % 3 + 1).otherwise(0))
    return rows.groupBy(by, "slot", quarter_end(F.col(at)).alias("quarter_end")).agg(F.avg(x).alias(x))


def month_grid(panel: DataFrame, by: str = "series", at: str = "date") -> DataFrame:
    """(series, date) of every month end between a series' first and last date."""
    ends = panel.groupBy(by).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    months = F.sequence(F.trunc("lo", "month").cast("date"), F.trunc("hi", "month").cast("date"), F.expr("interval 1 month"))
    return ends.select(by, F.explode(months).alias("start")).select(by, F.last_day("start").alias(at))


def low_to_monthly(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Values of low-frequency dates on the month grid, with the last one carried forward."""
    rows = month_grid(panel, by, at).join(panel.select(by, at, x), [by, at], "left")
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(x, ignorenulls=True).over(w))


def quarterly_sparse(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """The quarter's sum on quarter-end rows of the month grid, missing elsewhere."""
    sums = panel.groupBy(by, quarter_end(F.col(at)).alias(at)).agg(F.sum(x).alias("quarterly"))
    return month_grid(panel, by, at).join(sums, [by, at], "left")


def frequency(panel: DataFrame, by: str = "series", at: str = "date") -> DataFrame:
    """(series, median_gap, freq) from the median gap between dates."""
    gaps = panel.withColumn("gap", F.datediff(F.col(at), F.lag(at).over(Window.partitionBy(by).orderBy(at))))
    median = gaps.groupBy(by).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    g = F.col("median_gap")
    freq = F.when(g.between(0.5, 2), "d").when(g.between(5, 9), "w").when(g.between(26, 32), "m").when(g.between(80, 100), "q").otherwise("unknown")
    return median.withColumn("freq", freq)


def as_of(targets: DataFrame, panel: DataFrame, at: str, by: str = "series", on: str = "date", x: str = "value") -> DataFrame:
    """The last value at or before each target's ``at``: targets and observations in one window, so one shuffle by series."""
    extra = [c for c in targets.columns if c not in (by, at)]
    asked = targets.select(by, F.col(at).alias("__at"), F.lit(1).alias("__asks"), F.lit(None).cast("double").alias("__x"), F.lit(None).cast("date").alias("__on"), F.struct(*(extra or [F.lit(0).alias("none")])).alias("__extra"))
    blank = F.lit(None).cast(asked.schema["__extra"].dataType)
    seen = panel.filter(F.col(x).isNotNull()).select(by, F.col(on).alias("__at"), F.lit(0).alias("__asks"), F.col(x).cast("double").alias("__x"), F.col(on).alias("__on"), blank.alias("__extra"))
    w = Window.partitionBy(by).orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(seen).withColumns({x: F.last("__x", ignorenulls=True).over(w), "as_of": F.last("__on", ignorenulls=True).over(w)})
    return both.filter("__asks = 1").select(by, F.col("__at").alias(at), *[F.col(f"__extra.{c}").alias(c) for c in extra], x, "as_of")


#: How many days or months one lag goes back, by frequency.
LAG_STEPS = {"d": "date_sub(cutoff, lag)", "w": "date_sub(cutoff, 7 * lag)", "m": "last_day(add_months(cutoff, -lag))", "q": "date_sub(add_months(trunc(cutoff, 'quarter'), 3 - 3 * lag), 1)"}


def lag_grid(panel: DataFrame, cutoffs: DataFrame, lags: dict[str, int], by: str = "series") -> DataFrame:
    """(series, quarter_end, freq, lag, value): values as of each cutoff less k days, weeks, month ends or quarter ends; never later than the cutoff.

    cutoffs: (quarter_end, cutoff).
    """
    series = panel.select(by).distinct()
    wanted = None
    for freq, most in lags.items():
        one = cutoffs.withColumns({"freq": F.lit(freq), "lag": F.explode(F.sequence(F.lit(1), F.lit(most)))}).withColumn("wanted", F.least(F.expr(LAG_STEPS[freq]), F.col("cutoff")))
        wanted = one if wanted is None else wanted.unionByName(one)
    # every series is asked at every cutoff and lag: the product of two lists, not of observations
    targets = wanted.crossJoin(series).select(by, "quarter_end", "freq", "lag", "wanted")
    return as_of(targets, panel, "wanted", by)


def pro_rata(low: DataFrame, seed: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """A seed path scaled in each quarter to the quarter's total; an equal split where the seed sums to about 0.

    low: (series, quarter_end, total); seed: (series, date, value).
    """
    w = Window.partitionBy(by, "quarter_end")
    rows = seed.withColumn("quarter_end", quarter_end(F.col(at))).join(low, [by, "quarter_end"])
    whole = F.sum(x).over(w)
    return rows.withColumn("scaled", F.when(F.abs(whole) > 1e-12, F.col(x) * F.col("total") / whole).otherwise(F.col("total") / F.count("*").over(w)))
