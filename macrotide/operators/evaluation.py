"""Measures of candidates against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr

#: For r2 the highest value is the best, for errors the lowest.
HIGHER = ("r2",)


def evaluate_candidates(rows: DataFrame, by: list[str], metric: str = "rmse", candidate: str = "candidate", truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(*by, candidate, n, mae, rmse, mape, r2, place, recommended) of rows (.., truth, guess); rows without one of both don't count.

    mape leaves truths of about 0 out; r2 is null where the truth does not vary. A candidate
    without the metric comes last; ties go by name.
    """
    held = rows.dropna(subset=[truth, guess])
    error, t = F.col(guess) - F.col(truth), F.col(truth)
    spread = F.var_pop(t) * F.count("*")
    out = held.groupBy(*by, candidate).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.when(F.abs(t) > 1e-8, F.abs(error / t))).alias("mape"), (1 - F.sum(error * error) / F.when(spread > 1e-12, spread)).alias("r2")
    )
    score = F.round(metric, 9)
    order = score.desc_nulls_last() if metric in HIGHER else score.asc_nulls_last()
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order, candidate)))
    return out.withColumn("recommended", F.col("place") == 1)


def indicator_quality(rows: DataFrame, by: list[str], at: str, y: str, zs: list[str], far: float = 6.0) -> DataFrame:
    """How fit indicators zs are to spread y, for each group of low-frequency rows.

    coverage: the share of rows with y that have any indicator; rank: of the indicators' matrix; strength: their mean
    deviation; corr, corr_mean, corr_median: the largest, mean and median |correlation| with y; growth_corr: that of
    changes of y and of the indicators' mean; zero and negative shares of both; outliers, outlier_z: the share of means beyond
    ``far`` robust deviations (1.4826 times the median distance), and the farthest; ratio_share, ratio_cv, ratio_drift,
    ratio_median: where y / mean exists, its deviation over its |mean|, how far the median of the last third (two rows
    at least) lies from that of the first over the median |ratio|, and that median. Missing correlations count as 0;
    rank and correlations need rows with y and all indicators.
    """
    whole = Window.partitionBy(*by)
    z = [F.col(c).cast("double") for c in zs]
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in z), F.lit(0))
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in z), F.lit(0.0)) / F.nullif(known, F.lit(0))
    held = rows.filter(F.col(y).isNotNull()).withColumn("__m", mean)
    some = F.col("__m").isNotNull()
    held = held.withColumn("__ratio", F.when(some & (F.abs("__m") > 1e-10), F.col(y) / F.col("__m")))
    order = whole.orderBy(at)
    seen = Window.partitionBy(*by, F.col("__m").isNotNull()).orderBy(at)
    held = held.withColumns({"__dm": F.when(some, F.col("__m") - F.lag("__m").over(seen)), "__dy": F.when(some, F.col(y) - F.lag(y).over(seen)), "__mid": F.percentile("__m", F.lit(0.5)).over(whole), "__i": F.count("__ratio").over(order), "__k": F.count("__ratio").over(whole)})
    held = held.withColumn("__off", F.abs(F.col("__m") - F.col("__mid"))).withColumn("__mad", F.percentile("__off", F.lit(0.5)).over(whole))
    far_ = F.col("__off") / F.greatest(F.lit(1e-12), 1.4826 * F.col("__mad"))
    tail = F.greatest(F.lit(2), F.floor(F.col("__k") / 3))
    ratio = F.col("__ratio")
    first, last = F.when(F.col("__i") <= tail, ratio), F.when(F.col("__i") > F.col("__k") - tail, ratio)
    none = F.lit(0.0)
    rs = [F.coalesce(F.abs(corr(c, F.col(y))), none) for c in z]
    grams = [F.sum(F.when(known == len(zs), z[i] * z[j])) for i in range(len(zs)) for j in range(len(zs))]
    share = lambda c: F.coalesce(F.avg(F.when(some, c.cast("int"))), none)
    sums = held.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(some.cast("int")).alias("coverage"), F.array(*grams).alias("__gram"),
        F.array(*[F.stddev_pop(c) for c in z]).alias("__sd"), F.array(*rs).alias("__corr"), F.coalesce(corr("__dm", "__dy"), none).alias("growth_corr"),
        share(F.abs("__m") <= 1e-10).alias("zero_share"), share(F.col("__m") < 0).alias("negative_share"), share(F.abs(y) <= 1e-10).alias("target_zero_share"), share(F.col(y) < 0).alias("target_negative_share"),
        share(far_ > far).alias("outliers"), F.coalesce(F.max(far_), none).alias("outlier_z"), share(ratio.isNotNull()).alias("ratio_share"),
        F.coalesce(F.stddev_pop(ratio) / F.greatest(F.abs(F.avg(ratio)), F.lit(1e-8)), none).alias("ratio_cv"),
        F.coalesce(F.percentile(F.abs(ratio), F.lit(0.5)), none).alias("ratio_median"), F.percentile(first, F.lit(0.5)).alias("__first"), F.percentile(last, F.lit(0.5)).alias("__last"),
    )
    drift = F.coalesce(F.abs(F.col("__last") - F.col("__first")) / F.greatest(F.col("ratio_median"), F.lit(1e-8)), none)
    known_sd = F.filter("__sd", lambda v: v.isNotNull())
    strength = F.when(F.size(known_sd) > 0, F.aggregate(known_sd, none, lambda a, v: a + v) / F.size(known_sd)).otherwise(0.0)
    ranked = F.array_sort("__corr")
    k = len(zs)
    middle = (F.element_at(ranked, (k + 1) // 2) + F.element_at(ranked, k // 2 + 1)) / 2
    out = sums.withColumns({"strength": strength, "corr": F.array_max("__corr"), "corr_mean": F.aggregate("__corr", none, lambda a, v: a + v) / k, "corr_median": middle, "ratio_drift": drift, "rank": gram_rank(F.col("__gram"), k)})
    measures = ["coverage", "rank", "strength", "corr", "corr_mean", "corr_median", "growth_corr", "zero_share", "negative_share", "target_zero_share", "target_negative_share", "outliers", "outlier_z", "ratio_share", "ratio_cv", "ratio_drift", "ratio_median"]
    return out.select(*by, "n", *measures)


def gram_rank(gram: Column, k: int) -> Column:
    """The rank of k columns from their products (an array of k * k): columns are swept out one after another, and count if more than 1e-10 of them is left."""
    diagonal = F.array(*[F.coalesce(F.get(gram, F.lit(i * k + i)), F.lit(0.0)) for i in range(k)])
    rank, left = F.lit(0), F.transform(gram, lambda v: F.coalesce(v, F.lit(0.0)))
    for j in range(k):
        pivot = F.get(left, F.lit(j * k + j))
        held = pivot > 1e-10 * F.get(diagonal, F.lit(j))
        rank = rank + held.cast("int")
        left = F.when(held, _swept(left, pivot, j, k)).otherwise(left)
    return rank


def _swept(s: Column, pivot: Column, j: int, k: int) -> Column:
    """Products less what column j explains of them."""
    return F.transform(s, lambda v, i: v - F.get(s, (F.floor(i / k) * k + j).cast("int")) * F.get(s, (i % k + j * k).cast("int")) / pivot)
