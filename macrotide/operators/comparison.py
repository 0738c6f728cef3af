"""Two versions of a results table held against each other, from one pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def side_by_side(results: DataFrame, key: list[str], version: str, base: str, other: str, columns: list[str]) -> DataFrame:
    """(*key, <column>_a, <column>_b ..) of the rows that both versions have: a of ``base``, b of ``other``. A key has one row in a version; of several the largest values are taken."""
    held = results.filter(F.col(version).isin(base, other))
    sides = [F.max(F.when(F.col(version) == v, F.col(c))).alias(f"{c}_{s}") for s, v in (("a", base), ("b", other)) for c in columns]
    seen = [F.count_if(F.col(version) == v).alias(f"__{s}") for s, v in (("a", base), ("b", other))]
    return held.groupBy(*key).agg(*sides, *seen).filter("__a > 0 and __b > 0").drop("__a", "__b")


def placed(results: DataFrame, within: list[str], estimate: str, ties: list[str]) -> DataFrame:
    """Adds ``place`` by falling size of the estimate."""
    w = Window.partitionBy(*within).orderBy(F.desc(F.abs(estimate)), *ties)
    return results.withColumn("place", F.row_number().over(w).cast("long"))


def domain_shift(results: DataFrame, key: list[str], version: str, base: str, other: str, within: list[str], alpha: float = 0.1, estimate: str = "estimate", p: str = "p") -> DataFrame:
    """(*key, sign_flip, significance_flip, rank_shift): what changes from one version to the other; places are within ``within`` and the version."""
    rows = placed(results, [version, *within], estimate, [k for k in key if k not in within])
    both = side_by_side(rows, key, version, base, other, [estimate, p, "place"])
    flip = (F.signum(f"{estimate}_a") != F.signum(f"{estimate}_b")).cast("int")
    return both.select(*key, flip.alias("sign_flip"), ((F.col(f"{p}_a") < alpha) != (F.col(f"{p}_b") < alpha)).cast("int").alias("significance_flip"), (F.col("place_b") - F.col("place_a")).alias("rank_shift"))


#: Shares of the agreement score: signs, key findings, places and key findings kept (fixed values).
AGREEMENT = {"sign": 0.4, "key": 0.3, "place": 0.2, "kept": 0.1}


def spec_stability(results: DataFrame, key: list[str], version: str, base: str, other: str, within: list[str], keyed: Column | None = None, estimate: str = "estimate") -> DataFrame:
    """(*within, n, sign_match, priority_match, median_shift, key_retention, score): how far a version agrees with the baseline.

    ``keyed`` says which rows are key findings (p below 0.1 unless given); key_retention is the share
    of the baseline's that stay, 0 if it has none. Places are within ``within`` and the version.
    """
    keyed = F.col("p") < 0.1 if keyed is None else keyed
    rows = placed(results, [version, *within], estimate, [k for k in key if k not in within]).withColumn("__keyed", keyed.cast("int"))
    both = side_by_side(rows, key, version, base, other, [estimate, "place", "__keyed"])
    sign = F.avg((F.signum(f"{estimate}_a") == F.signum(f"{estimate}_b")).cast("int"))
    same = F.avg((F.col("__keyed_a") == F.col("__keyed_b")).cast("int"))
    shift = F.percentile(F.abs(F.col("place_a") - F.col("place_b")), F.lit(0.5))
    kept = F.coalesce(F.avg(F.when(F.col("__keyed_a") == 1, F.col("__keyed_b"))), F.lit(0.0))
    score = AGREEMENT["sign"] * sign + AGREEMENT["key"] * same + AGREEMENT["place"] / (1 + shift) + AGREEMENT["kept"] * kept
    return both.groupBy(*within).agg(F.count("*").alias("n"), sign.alias("sign_match"), same.alias("priority_match"), shift.alias("median_shift"), kept.alias("key_retention"), score.alias("score"))


def choose_baseline(results: DataFrame, key: list[str], version: str, within: list[str], names: list[str], estimate: str = "estimate") -> DataFrame:
    """(*within, baseline): the version with the most rows among the keys of each group; of equal ones the first of ``names``, then by name."""
    order = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        order = F.when(F.col(version) == name, i).otherwise(order)
    counts = results.filter(F.col(estimate).isNotNull()).groupBy(*within, version).agg(F.count_distinct(*key).alias("__n"))
    return counts.groupBy(*within).agg(F.min_by(version, F.struct(-F.col("__n"), order, F.col(version))).alias("baseline"))


def headline_rows(results: DataFrame, key: list[str], target: float = 0.05, eps: str = "eps", chooses: Column | None = None) -> DataFrame:
    """One row for each (null-safe) key among the rows that ``chooses`` holds for (the estimator ``tmle`` unless given): the eps nearest to ``target``, of two as near the smaller; missing ones last. All other rows stay."""
    chooses = F.coalesce(F.col("estimator") == "tmle" if chooses is None else chooses, F.lit(False))
    w = Window.partitionBy("__among", *key).orderBy(F.asc_nulls_last(F.round(F.abs(F.col(eps) - target), 12)), F.asc_nulls_last(eps))
    rows = results.withColumn("__among", chooses).withColumn("__r", F.row_number().over(w))
    return rows.filter(~F.col("__among") | (F.col("__r") == 1)).drop("__among", "__r")


def variant_range(base: DataFrame, variants: DataFrame, key: list[str], within: list[str] | None = None, score: str = "score") -> DataFrame:
    """(*within, *key, score, least, greatest, variants, place): base scores by falling size, and the range of the same key's scores in variants, null without any. variants: (*within, *key, score)."""
    within = within or []
    spread = variants.filter(F.col(score).isNotNull()).groupBy(*within, *key).agg(F.min(score).alias("least"), F.max(score).alias("greatest"), F.count("*").alias("variants"))
    rows = base.select(*within, *key, score).join(spread, [*within, *key], "left").withColumn("variants", F.coalesce("variants", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc_nulls_last(F.round(score, 9)), *key)))
