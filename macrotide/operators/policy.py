"""Choice of disaggregation profiles by route: errors against benchmarks, roughness, revisions between vintages, and a ranking by all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vintages(low: DataFrame, by: list[str], at: str, holdouts: list[int]) -> DataFrame:
    """The rows of each history as they stood: once for every number of last rows held out, in ``vintage``; a history that has no more rows than that has no such vintage."""
    whole = Window.partitionBy(*by)
    rows = low.withColumns({"__left": F.row_number().over(whole.orderBy(F.desc(at))) - 1, "__n": F.count("*").over(whole)})
    rows = rows.withColumn("vintage", F.explode(F.array(*[F.lit(h) for h in holdouts])))
    return rows.filter((F.col("__left") >= F.col("vintage")) & (F.col("__n") > F.col("vintage"))).drop("__left", "__n")


def revision_risk(paths: DataFrame, by: list[str], at: str, x: str, tail: int = 0) -> DataFrame:
    """(*by, vintage, revision_risk_mae, revision_risk_max): how far paths of a vintage lie from those of vintage 0, over the ``tail`` last dates that both have (0: all)."""
    held = paths.filter(F.col(x).isNotNull())
    full = held.filter("vintage = 0").select(*by, at, F.col(x).alias("__full"))
    both = held.filter("vintage <> 0").join(full, [*by, at])
    if tail > 0:
        both = both.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "vintage").orderBy(F.desc(at)))).filter(F.col("__r") <= tail)
    off = F.abs(F.col("__full") - F.col(x))
    return both.groupBy(*by, "vintage").agg(F.avg(off).alias("revision_risk_mae"), F.max(off).alias("revision_risk_max"))


def benchmark_errors(paths: DataFrame, low: DataFrame, by: list[str], block: str, at: str, x: str, target: str, conversion: str = "sum") -> DataFrame:
    """(*by, benchmark_mae, benchmark_max): how far the sums, means, first or last values of a path's blocks lie from the low-frequency values.

    low: (a part of by, block, target); blocks that only one side has don't count.
    """
    made = {"sum": F.sum(x), "mean": F.avg(x), "first": F.min_by(x, at), "last": F.max_by(x, at)}[conversion]
    held = paths.filter(F.col(x).isNotNull()).groupBy(*by, block).agg(made.alias("__made"))
    keys = [c for c in (*by, block) if c in low.columns]
    off = F.abs(F.col("__made") - F.col(target))
    return held.join(low.filter(F.col(target).isNotNull()).select(*keys, target), keys).groupBy(*by).agg(F.avg(off).alias("benchmark_mae"), F.max(off).alias("benchmark_max"))


def roughness(paths: DataFrame, by: list[str], at: str, x: str) -> DataFrame:
    """(*by, roughness_score): mean |second difference| of the values in order over their mean size (1 if that is 0); null below three values."""
    w = Window.partitionBy(*by).orderBy(at)
    rows = paths.filter(F.col(x).isNotNull()).withColumn("__d", F.col(x) - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w))
    size = F.avg(F.abs(x))
    return rows.groupBy(*by).agg((F.avg(F.abs("__d")) / F.when(size > 1e-12, size).otherwise(1.0)).alias("roughness_score"))


#: What profiles are ranked by, in order, and whether less is better; a missing figure comes last.
ORDER = {"failure_rate": True, "n_evaluated": False, "median_selected_score": True, "median_benchmark_mae": True, "median_roughness": True, "median_revision_risk_mae": True, "median_improvement": False}


def _named(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def usage(choices: DataFrame) -> DataFrame:
    """(route, constraint, method, n) of the choices that are ``ok`` and name a method.

    choices: (status, method_used, method, route, low, high, constraint, constraint_type, conversion). The method used
    counts before the one asked for; a route without a name is <low>-><high> if the two differ; a constraint
    without a name is its type, else the conversion. Routes are upper case without blanks, the others lower case.
    """
    part = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    pieces = F.transform(F.split(part("route"), "->"), lambda v: F.trim(v))
    route = F.when(F.size(pieces) == 2, F.array_join(pieces, "->")).otherwise(part("route"))
    route = F.when(part("route") != "", route).when((part("low") != "") & (part("high") != "") & (part("low") != part("high")), F.concat_ws("->", part("low"), part("high"))).otherwise("")
    first = lambda *cs: F.coalesce(*[F.nullif(_named(c), F.lit("")) for c in cs], F.lit(""))
    rows = choices.filter(_named("status") == "ok").select(route.alias("route"), first("constraint", "constraint_type", "conversion").alias("constraint"), first("method_used", "method").alias("method"))
    return rows.filter("method <> ''").groupBy("route", "constraint", "method").agg(F.count("*").alias("n"))


def usage_compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(route, constraint, method, baseline, candidate, delta): how often each method is used in two runs, 0 where it is not; tables as for ``usage``."""
    keys = ["route", "constraint", "method"]
    both = usage(baseline).withColumnRenamed("n", "baseline").join(usage(candidate).withColumnRenamed("n", "candidate"), keys, "full").fillna(0, ["baseline", "candidate"])
    return both.withColumn("delta", F.col("candidate") - F.col("baseline"))


def metric_compare(baseline: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """(*key, baseline, candidate, delta, ratio) of (*key, value) in two runs; what only one has is null in the other."""
    both = baseline.select(*key, F.col("value").alias("baseline")).join(candidate.select(*key, F.col("value").alias("candidate")), key, "full")
    return both.withColumns({"delta": F.col("candidate") - F.col("baseline"), "ratio": F.try_divide("candidate", F.nullif("baseline", F.lit(0.0)))})


def profile_summary(runs: DataFrame, route: str = "route", profile: str = "profile", task: str = "task", base: str = "denton") -> DataFrame:
    """One row for each route and profile from runs: (route, profile, task, status, selected_method, selected_score, improvement, benchmark_mae, roughness_score, revision_risk_mae).

    failure_rate: the share of runs with the status ``error``; scores and improvements are of runs that
    have a score, errors, roughness and revisions of runs that are ``ok``; other_share: how many of
    the methods named differ from ``base``.
    """
    ok, scored = F.col("status") == "ok", F.col("selected_score").isNotNull()

    def of(held: Column, c: str, name: str) -> list[Column]:
        value = F.when(held & ~F.isnan(c), F.col(c))
        return [F.avg(value).alias(f"mean_{name}"), F.percentile(value, F.lit(0.5)).alias(f"median_{name}")]

    named = F.when(scored & (F.trim("selected_method") != ""), F.lower(F.trim("selected_method")))
    sums = [F.count("*").alias("n_rows"), F.count_distinct(task).alias("n_tasks"), F.count_if(scored).alias("n_evaluated"), F.count_if(F.col("status") == "error").alias("error_count"), F.avg((F.col("status") == "error").cast("int")).alias("failure_rate")]
    sums += of(scored, "selected_score", "selected_score") + of(scored, "improvement", "improvement") + of(ok, "benchmark_mae", "benchmark_mae") + of(ok, "roughness_score", "roughness") + of(ok, "revision_risk_mae", "revision_risk_mae")
    sums.append(F.try_divide(F.count_if(named != base), F.count(named)).alias("other_share"))
    return runs.groupBy(route, profile).agg(*sums)


def rank_profiles(summary: DataFrame, route: str = "route", profile: str = "profile", digits: int = 12) -> DataFrame:
    """``summary`` with each profile's place in its route: by failure rate, runs scored, then medians of score, benchmark error, roughness, revisions and improvement, then by name."""
    order = [(F.asc_nulls_last if less else F.desc_nulls_last)(F.round(c, digits)) for c, less in ORDER.items()]
    return summary.withColumn("place", F.row_number().over(Window.partitionBy(route).orderBy(*order, profile)))
