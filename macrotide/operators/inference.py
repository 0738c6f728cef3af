"""Multiple testing, ranking and calibration of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.shipping import cut


def step_up(results: DataFrame, family: list[str], key: list[str], p: str = "p") -> DataFrame:
    """Adds bh, by and holm values within each family; missing p-values stay missing and don't count."""
    held = results.filter(F.col(p).isNotNull())
    up = Window.partitionBy(*family).orderBy(p, *key)
    ranked = held.withColumns({"__i": F.row_number().over(up), "__n": F.count("*").over(Window.partitionBy(*family))})
    ranked = ranked.withColumn("__h", F.aggregate(F.sequence(F.lit(1), F.col("__n").cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i))
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    past = up.rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col(p) * F.col("__n") / F.col("__i")
    out = ranked.withColumns({
        "bh": F.least(F.lit(1.0), F.min(raw).over(rest)),
        "by": F.least(F.lit(1.0), F.min(raw * F.col("__h")).over(rest)),
        "holm": F.least(F.lit(1.0), F.max((F.col("__n") - F.col("__i") + 1) * F.col(p)).over(past)),
    }).drop("__i", "__n", "__h")
    missing = results.filter(F.col(p).isNull()).withColumns({c: F.lit(None).cast("double") for c in ("bh", "by", "holm")})
    return out.unionByName(missing)


def average_rank(over: list[str], order: Column) -> Column:
    """Share of rows at or below, ties sharing their mean rank."""
    w = Window.partitionBy(*over).orderBy(order)
    ties = Window.partitionBy(*over, order)
    return (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(Window.partitionBy(*over))


def null_draws(results: DataFrame, draws: int, key: list[str]) -> DataFrame:
    """(…results, draw, abs_t): portable null draws from hashes, for tests and step-downs."""
    rows = results.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double")
    return rows.withColumn("abs_t", 3.5 * bits / 4294967296.0)


def romano_wolf(hypotheses: DataFrame, draws: DataFrame, family: list[str], key: list[str]) -> DataFrame:
    """Step-down max-t p-values from (family, key, abs_t) and null draws (family, key, draw, null_t).

    Hypotheses go by falling |t|; each is compared with the draws' maxima over itself and those
    after it: (1 + count) / (draws + 1), made monotone.
    """
    order = Window.partitionBy(*family).orderBy(F.desc("abs_t"), *key)
    ranked = hypotheses.withColumn("place", F.row_number().over(order))
    rows = draws.join(ranked.select(*family, *key, "abs_t", "place"), [*family, *key])
    suffix = Window.partitionBy(*family, "draw").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("top", F.max("null_t").over(suffix))
    counted = rows.groupBy(*family, *key, "place").agg(((1 + F.sum((F.col("top") >= F.col("abs_t")).cast("int"))) / (F.count("*") + 1)).alias("raw"))
    past = Window.partitionBy(*family).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("romano_wolf", F.max("raw").over(past)).drop("raw")


def ranged_sums(rows: DataFrame, value: str, weight: Column) -> DataFrame:
    """(value, own, below, total) for each distinct non-null value: the sums of weights at it, below it and of all, in an order dealt to ranges."""
    sums = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.sum(weight).alias("own"))
    ranged = cut(sums.repartitionByRange(value).withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = ranged.groupBy("__part").agg(F.sum("own").alias("__p"))
    parts = parts.select("__part", F.coalesce(F.sum("__p").over(earlier), F.lit(0)).alias("__before"), F.sum("__p").over(Window.partitionBy()).alias("total"))
    here = F.coalesce(F.sum("own").over(Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__here", here).join(F.broadcast(parts), "__part").select(value, "own", (F.col("__before") + F.col("__here")).alias("below"), "total")


def control_calibration(targets: DataFrame, controls: DataFrame, z: str = "z", least: int = 20) -> DataFrame:
    """Empirical p of |z| among negative controls' |z|, and the factor by which their spread inflates errors.

    Targets and controls are put in one order by |z|, in which controls are counted; nothing comes
    out with fewer than ``least`` controls. A target without z has no p.
    """
    size = F.abs(z)
    spread = controls.filter(size.isNotNull()).agg(F.greatest(F.lit(1.0), F.percentile(size, F.lit(0.95)) / 1.96).alias("inflation"), F.count("*").alias("n_controls"))
    both = targets.select(size.alias("__z"), F.lit(0).alias("__c")).unionByName(controls.select(size.alias("__z"), F.lit(1).alias("__c")))
    counts = ranged_sums(both, "__z", F.col("__c")).select("__z", (F.col("total") - F.col("below")).alias("__beyond"))
    rows = targets.withColumn("__z", size).join(counts, "__z", "left").crossJoin(F.broadcast(spread.filter(F.col("n_controls") >= least)))  # one row
    return rows.withColumn("empirical_p", (1 + F.col("__beyond")) / (1 + F.col("n_controls"))).drop("__z", "__beyond")


def latest(rows: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """One row for each (null-safe) key: the first by ``newest``."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).filter("__r = 1").drop("__r")
