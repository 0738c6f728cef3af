"""Cleaning, filling and window transforms of long panels (series, date, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import clip, corr

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def along(by: str = "series", at: str = "date"):
    return Window.partitionBy(by).orderBy(at)


def winsorize(panel: DataFrame, lo: float, hi: float, by: str = "series", x: str = "value") -> DataFrame:
    """x clipped to its quantiles within ``by``."""
    bounds = panel.groupBy(by).agg(F.percentile(x, F.lit(lo)).alias("lo"), F.percentile(x, F.lit(hi)).alias("hi"))
    return panel.join(bounds, by).withColumn("winsorized", clip(F.col(x), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def zscore_clip(panel: DataFrame, k: float, by: str = "series", x: str = "value") -> DataFrame:
    """x clipped to mean +- k population deviations within ``by``; left alone if the deviation is 0."""
    stats = panel.groupBy(by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    held = clip(F.col(x), F.col("mean") - k * F.col("sd"), F.col("mean") + k * F.col("sd"))
    return panel.join(stats, by).withColumn("clipped", F.when(F.col("sd") > 0, held).otherwise(F.col(x))).drop("mean", "sd")


def hampel(panel: DataFrame, width: int, limit: float, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """x replaced by its rolling median where it is over ``limit`` scaled median deviations away."""
    back, ahead = (width // 2, width // 2) if width % 2 else (width // 2, width // 2 - 1)
    frame = along(by, at).rowsBetween(-back, ahead)
    enough = max(1, width // 2)
    median = F.when(F.count(x).over(frame) >= enough, F.percentile(x, F.lit(0.5)).over(frame))
    out = panel.withColumn("median", median).withColumn("deviation", F.abs(F.col(x) - F.col("median")))
    scale = F.when(F.count("deviation").over(frame) >= enough, 1.4826 * F.percentile("deviation", F.lit(0.5)).over(frame))
    out = out.withColumn("scale", scale)
    return out.withColumn("filtered", F.when((F.col("scale") > 0) & (F.col("deviation") > limit * F.col("scale")), F.col("median")).otherwise(F.col(x))).drop("median", "deviation", "scale")


def smooth(panel: DataFrame, width: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Trailing mean over ``width`` rows, of as many as there are."""
    return panel.withColumn("smoothed", F.avg(x).over(along(by, at).rowsBetween(-(width - 1), 0)))


def fill(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """forward, backward and both (forward, then backward) fills of missing x."""
    forward = F.last(x, ignorenulls=True).over(along(by, at).rowsBetween(FIRST, 0))
    backward = F.first(x, ignorenulls=True).over(along(by, at).rowsBetween(0, LAST))
    return panel.withColumns({"forward": forward, "backward": backward, "both": F.coalesce(forward, backward)})


def fill_time(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Missing x interpolated by elapsed days between its neighbours; flat beyond the ends."""
    w = along(by, at)
    held = F.when(F.col(x).isNotNull(), F.struct(F.col(at).alias("d"), F.col(x).alias("v")))
    out = panel.withColumns({"before": F.last(held, ignorenulls=True).over(w.rowsBetween(FIRST, 0)), "after": F.first(held, ignorenulls=True).over(w.rowsBetween(0, LAST))})
    share = F.datediff(F.col(at), F.col("before.d")) / F.datediff(F.col("after.d"), F.col("before.d"))
    mixed = F.col("before.v") + (F.col("after.v") - F.col("before.v")) * share
    return out.withColumn("filled", F.coalesce(F.col(x), mixed, F.col("before.v"), F.col("after.v"))).drop("before", "after")


def changes(panel: DataFrame, k: int = 1, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """lagged, lead, difference and growth over k rows."""
    w = along(by, at)
    before = F.lag(x, k).over(w)
    return panel.withColumns({"lagged": before, "ahead": F.lead(x, k).over(w), "difference": F.col(x) - before, "growth": F.try_divide(F.col(x), before) - 1})


def lead_outcome(panel: DataFrame, horizon: int, cumulated: int, placebo: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """x at +horizon, the sum of the next ``cumulated`` (whole only), and x at -placebo."""
    w = along(by, at)
    ahead = w.rowsBetween(1, cumulated)
    return panel.withColumns({"at_horizon": F.lead(x, horizon).over(w), "cumulative": F.when(F.count(x).over(ahead) == cumulated, F.sum(x).over(ahead)), "placebo": F.lag(x, placebo).over(w)})


def standardize(panel: DataFrame, sample: bool = True, floor: float = 0.0, by: str = "series", x: str = "value") -> DataFrame:
    """(x - mean) / deviation within ``by``; missing where the deviation is not above ``floor``."""
    stats = panel.groupBy(by).agg(F.avg(x).alias("mean"), (F.stddev_samp(x) if sample else F.stddev_pop(x)).alias("sd"))
    return panel.join(stats, by).withColumn("standardized", F.when(F.col("sd") > floor, (F.col(x) - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def stationary(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value", least: float = 1e-8) -> DataFrame:
    """Differences and log differences, and auto: log differences if all of a series is positive."""
    w = along(by, at)
    log = F.ln(F.greatest(F.col(x), F.lit(least)))
    positive = panel.groupBy(by).agg((F.min(x) > 0).alias("positive"))
    out = panel.join(positive, by).withColumns({"difference": F.col(x) - F.lag(x).over(w), "log_difference": log - F.lag(log).over(w)})
    return out.withColumn("auto", F.when(F.col("positive"), F.col("log_difference")).otherwise(F.col("difference"))).drop("positive")


def invert_stationary(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Levels from first values and cumulated log differences."""
    w = along(by, at).rowsBetween(FIRST, 0)
    return panel.withColumn("restored", F.first(x, ignorenulls=True).over(w) * F.exp(F.sum(F.coalesce("log_difference", F.lit(0.0))).over(w)))


def ema(panel: DataFrame, span: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Exponential average without adjustment, alpha = 2 / (span + 1); a missing value keeps the last average.

    Each row folds the values before it whose weight is not below the precision of a double, so
    that no array is longer than some 19 spans, however long the series.
    """
    alpha = 2.0 / (span + 1)
    reach = 1 if alpha >= 1 else math.ceil(37 / -math.log(1 - alpha))
    rows = panel.withColumn("__k", F.count(x).over(along(by, at)))
    held = F.collect_list(F.col(x).cast("double")).over(Window.partitionBy(by).orderBy("__k").rangeBetween(1 - reach, 0))
    fold = F.aggregate(held, F.lit(None).cast("double"), lambda last, v: F.when(last.isNull(), v).otherwise(alpha * v + (1 - alpha) * last))
    return rows.withColumn("ema", fold).select(by, at, F.col(x).cast("double").alias(x), "ema")


def persistence(panel: DataFrame, by: str = "series", at: str = "date", x: str = "value", least_pairs: int = 10) -> DataFrame:
    """Observed share, median gap in months, first autocorrelation, relative variance of differences, and their interquartile range."""
    w = along(by, at)
    rows = panel.filter(F.col(x).isNotNull()).withColumns({"before": F.lag(x).over(w), "gap": F.datediff(F.col(at), F.lag(at).over(w)) / 30.4375})
    rows = rows.withColumn("diff", F.col(x) - F.col("before"))
    whole = panel.groupBy(by).agg((F.count(x) / F.count("*")).alias("observed_share"))
    stats = rows.groupBy(by).agg(
        F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.when(F.count("before") >= least_pairs, corr("before", x)).alias("autocorrelation"),
        F.try_divide(F.var_pop("diff"), F.var_pop(x)).alias("difference_ratio"), (F.percentile("diff", F.lit(0.75)) - F.percentile("diff", F.lit(0.25))).alias("difference_iqr"),
    )
    return whole.join(stats, by)
