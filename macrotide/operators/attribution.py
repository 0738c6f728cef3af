"""What factors explain of outcomes, and how much of a response goes through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from macrotide.operators.controls import partial_out
from macrotide.operators.inference import step_up


def variance_attribution(rows: DataFrame, by: list[str], y: str, factors: list[str], least: int = 24) -> DataFrame:
    """(*by, model, factor, n, r2): the share of y's variance that all factors explain together (full_factors, all) and each alone (single_factor).

    All fits of a group are on the rows that have y and every factor; groups with fewer than
    ``least`` of them are left out. A share is null where y does not vary; a factor that does not vary explains 0.
    """
    held = rows.dropna(subset=[y, *factors])
    left = partial_out(held, by, [y], factors)
    whole = left.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(f"r_{y}") * F.col(f"r_{y}")).alias("__left"), F.regr_syy(F.col(y), F.lit(1.0)).alias("__all"), *[F.regr_r2(y, f).alias(f"__r_{i}") for i, f in enumerate(factors)], *[F.regr_sxx(F.lit(1.0), F.col(f)).alias(f"__s_{i}") for i, f in enumerate(factors)])
    whole = whole.filter(F.col("n") >= least)
    some = F.col("__all") > 0
    items = [F.struct(F.lit("full_factors").alias("model"), F.lit("all").alias("factor"), F.when(some, 1 - F.try_divide("__left", "__all")).alias("r2"))]
    items += [F.struct(F.lit("single_factor").alias("model"), F.lit(f).alias("factor"), F.when(some, F.when(F.col(f"__s_{i}") > 0, F.col(f"__r_{i}")).otherwise(0.0)).alias("r2")) for i, f in enumerate(factors)]
    return whole.select(*by, "n", F.explode(F.array(*items)).alias("m")).select(*by, "m.model", "m.factor", "n", "m.r2")


def channel_mediation(responses: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each response of an outcome and factor through which it may go, at the same horizon.

    responses: (treatment, horizon, kind: outcome or factor, name, beta, p); links: (outcome, factor,
    beta, share, r2). channel: the factor's response times its slope on the outcome; weighted: times the
    factor's share; mediated_share: of the outcome's response (null where that is within 1e-12 of 0);
    screening_p: the larger of both responses' p, or the one there is.
    """
    key = ["treatment", "horizon"]
    outcomes = responses.filter("kind = 'outcome'").select(*key, F.col("name").alias("outcome"), F.col("beta").alias("outcome_beta"), F.col("p").alias("outcome_p"))
    factors = responses.filter("kind = 'factor'").select(*key, F.col("name").alias("factor"), F.col("beta").alias("factor_beta"), F.col("p").alias("factor_p"))
    linked = links.select("outcome", "factor", F.col("beta").alias("link_beta"), F.col("share").alias("factor_share"), F.col("r2").alias("link_r2"))
    rows = outcomes.join(linked, "outcome").join(factors, [*key, "factor"])
    rows = rows.withColumn("channel", F.col("factor_beta") * F.col("link_beta")).withColumn("weighted", F.col("channel") * F.col("factor_share"))
    share = F.when(F.abs("outcome_beta") > 1e-12, F.col("weighted") / F.col("outcome_beta"))
    return rows.withColumns({"mediated_share": share, "screening_p": F.greatest("outcome_p", "factor_p")})


def rank_channels(channels: DataFrame, alpha: float = 0.10) -> DataFrame:
    """``channel_mediation`` rows with q (Benjamini-Hochberg over all that have a p), priority (strong to p 0.05, moderate to 0.10, else weak), robust (q within alpha) and place.

    Places go by q, size of weighted and of plain channel, p, and then by names and horizon; missing values last.
    """
    key = ["treatment", "outcome", "factor", "horizon"]
    rows = step_up(channels.withColumn("__all", F.lit(1)), ["__all"], key, "screening_p").withColumnRenamed("bh", "q").drop("by", "holm", "__all")
    p = F.col("screening_p")
    rows = rows.withColumns({"priority": F.when(p <= 0.05, "strong").when(p <= 0.10, "moderate").otherwise("weak"), "robust": F.coalesce(F.col("q") <= alpha, F.lit(False))})
    order = [F.asc_nulls_last(F.round("q", 9)), F.desc_nulls_last(F.abs(F.round("weighted", 9))), F.desc_nulls_last(F.abs(F.round("channel", 9))), F.asc_nulls_last(F.round("screening_p", 9)), *[F.asc_nulls_last(c) for c in key]]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row for each finding
