"""Stored transformation recipes replayed over a panel, each series by its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from macrotide.functions.columns import yeo_johnson


def differenced(values: Column, order: Column, lag: Column) -> Column:
    """An array differenced ``order`` times at a distance of ``lag`` places; what reaches before its start is null."""
    steps = F.when(order > 0, F.sequence(F.lit(1), order)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, values, lambda a, _: F.transform(a, lambda v, i: v - F.get(a, i - lag)))


def replay(panel: DataFrame, recipes: DataFrame, seasonal: DataFrame | None = None, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(series, date, replayed): each series without its seasonal part, Yeo-Johnson transformed, and differenced as its recipe says.

    recipes: (series, lam, diff_order, seasonal_diff_order, period, adjustment); a null or missing
    lam means no transform, null orders 0, a null period 12, and periods below 2 count as 2. seasonal: (series,
    date, part), taken off where adjustment is ``additive`` and divided by where it is
    ``multiplicative`` (a part of 0 leaves no value). Differences go by rows of the series, by whatever
    order and period it has: a series travels as one array, its history. A series without a recipe is left out.
    """
    rows = panel.select(by, at, F.col(x).cast("double").alias("__x")).join(recipes, by)
    if seasonal is not None:
        rows = rows.join(seasonal.select(by, at, F.col("part").alias("__part")), [by, at], "left")
        part = F.col("__part")
        rows = rows.withColumn("__x", F.when((F.col("adjustment") == "additive") & part.isNotNull(), F.col("__x") - part).when((F.col("adjustment") == "multiplicative") & part.isNotNull(), F.try_divide("__x", part)).otherwise(F.col("__x")))
    lam = F.col("lam").cast("double")
    rows = rows.withColumn("__x", F.when(lam.isNotNull(), yeo_johnson(F.col("__x"), F.coalesce(lam, F.lit(1.0)))).otherwise(F.col("__x")))
    plain = {c: F.coalesce(F.first(c).cast("int"), F.lit(v)) for c, v in (("diff_order", 0), ("seasonal_diff_order", 0), ("period", 12))}
    series = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, "__x"))).alias("__rows"), *[v.alias(f"__{c}") for c, v in plain.items()])
    once = differenced(F.col("__rows.__x"), F.col("__diff_order"), F.lit(1))
    series = series.withColumn("__once", once)
    twice = differenced(F.col("__once"), F.col("__seasonal_diff_order"), F.greatest(F.col("__period"), F.lit(2)))
    return series.select(by, F.inline(F.arrays_zip(F.col(f"__rows.{at}").alias(at), twice.alias("replayed")))).toDF(by, at, "replayed")
