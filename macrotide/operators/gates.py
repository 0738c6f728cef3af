"""Gates over check tables, shares of fragile questions, and screens of negative-control candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr
from macrotide.operators.inference import ranged_sums


def gate_summary(checks: DataFrame, key: list[str], gates: list[str], missing_fails: bool = False) -> DataFrame:
    """(*key, action, reasons) from boolean columns that say whether a gate is passed.

    ``demote`` with ``<GATE>_FAIL`` of each gate that is not passed, in their order, else ``hold``
    with ``PASS``. A missing check passes unless ``missing_fails``.
    """
    failed = [~F.coalesce(F.col(g), F.lit(not missing_fails)) for g in gates]
    reasons = F.concat_ws(";", *[F.when(f, f"{g.upper()}_FAIL") for f, g in zip(failed, gates)])
    out = checks.withColumn("reasons", reasons)
    return out.select(*key, F.when(F.col("reasons") == "", "hold").otherwise("demote").alias("action"), F.when(F.col("reasons") == "", "PASS").otherwise(F.col("reasons")).alias("reasons"))


def fragility_shares(checks: DataFrame, by: list[str], limits: dict[str, float]) -> DataFrame:
    """(*by, <check>_share, <check>_fragile .., fragile): the share of rows that fail each check, and whether it reaches its limit.

    Check columns say whether a row fails; rows without the check don't count. Without any, the
    share is 0 and nothing is fragile.
    """
    out = checks.groupBy(*by).agg(*[F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)).alias(f"{c}_share") for c in limits], *[F.count(c).alias(f"__n_{c}") for c in limits])
    out = out.withColumns({f"{c}_fragile": (F.col(f"__n_{c}") > 0) & (F.col(f"{c}_share") >= limit) for c, limit in limits.items()})
    either = reduce(lambda a, b: a | b, [F.col(f"{c}_fragile") for c in limits])
    return out.withColumn("fragile", either).drop(*[f"__n_{c}" for c in limits])


def control_screen(panel: DataFrame, questions: DataFrame, leads: int = 4, least: int = 24, least_similarity: float = 0.2, most_t: float = 1.645, k: int = 5, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(treatment, outcome, candidate, n, similarity, lead_t, score, place, decision, reasons): outcomes that the treatment should not move.

    questions: (treatment, outcome, date, t, y). A candidate is like the outcome (|correlation|,
    over at least ``least`` dates) and does not follow the treatment: lead_t is the largest |t|
    of its values 1 .. ``leads`` rows ahead on the treatment. The score is 0.65 similarity +
    0.35 / (1 + lead_t). ``select``: among the best ``k`` and passing both; ``drop``: failing
    one; ``demote``: passing both but placed behind. What cannot be measured fails. The
    question's own series are no candidates.
    """
    w = Window.partitionBy(by).orderBy(at)
    ahead = panel.select(F.col(by).alias("candidate"), at, F.col(x).alias("c"), *[F.lead(x, h).over(w).alias(f"c{h}") for h in range(1, leads + 1)])
    rows = questions.join(ahead, at).filter((F.col("candidate") != F.col("treatment")) & (F.col("candidate") != F.col("outcome")))
    key = ["treatment", "outcome"]
    n = F.count(F.when(F.col("y").isNotNull() & F.col("c").isNotNull(), 1))
    pairs = {h: F.count(F.when(F.col("t").isNotNull() & F.col(f"c{h}").isNotNull(), 1)) for h in range(1, leads + 1)}
    out = rows.groupBy(*key, "candidate").agg(n.alias("n"), F.abs(corr("y", "c")).alias("similarity"), *[corr("t", f"c{h}").alias(f"__r{h}") for h in pairs], *[m.alias(f"__n{h}") for h, m in pairs.items()])
    ts = [F.abs(F.col(f"__r{h}")) * F.sqrt(F.when(F.col(f"__n{h}") > 2, F.col(f"__n{h}") - 2) / F.when(F.abs(f"__r{h}") < 1 - 1e-12, 1 - F.col(f"__r{h}") * F.col(f"__r{h}"))) for h in pairs]
    out = out.withColumns({"similarity": F.when(F.col("n") >= least, F.col("similarity")), "lead_t": F.greatest(*ts) if leads > 1 else ts[0]})
    out = out.withColumn("score", 0.65 * F.coalesce("similarity", F.lit(0.0)) + F.coalesce(0.35 / (1 + F.col("lead_t")), F.lit(0.0)))
    order = [F.round("score", 9).desc(), F.round("similarity", 9).desc_nulls_last(), F.round("lead_t", 9).asc_nulls_last(), F.col("candidate")]
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    similar, still = F.coalesce(F.col("similarity") >= least_similarity, F.lit(False)), F.coalesce(F.col("lead_t") <= most_t, F.lit(False))
    decision = F.when(~(similar & still), "drop").when(F.col("place") <= k, "select").otherwise("demote")
    reasons = F.concat_ws(";", F.when(~similar, "SIMILARITY_FAIL"), F.when(~still, "NULL_SCREEN_FAIL"), F.when(similar & still, F.when(F.col("place") <= k, "PASS").otherwise("RANK")))
    return out.select(*key, "candidate", "n", "similarity", "lead_t", "score", "place", decision.alias("decision"), reasons.alias("reasons"))


#: Fixed values of ``reliability_tiers``: rows below or beyond these are low whatever their rank; weights of the ranks; cuts; and what lifts a capped row to high.
LEAST_OBS, MOST_CONDITION = 1.25, 1e10
RANK_WEIGHTS = {"obs": 0.50, "cond": 0.30, "drop": 0.20}
MEDIUM, HIGH, VERY_STRONG, STRONG_OBS, STRONG_CONDITION = 0.33, 0.67, 0.85, 3.0, 1e6
PENALTY = 0.10


def reliability_tiers(fits: DataFrame, obs: str = "obs_per_regressor", condition: str = "condition", deficit: str = "rank_deficit", selected: str = "selected", dropped: str = "dropped", capped: str = "capped", skipped: str = "skip_reason") -> DataFrame:
    """Adds tier (skip, low, medium, high), score, dropped_share, hard_low, rank_obs, rank_cond and rank_drop to design diagnostics of fits.

    Fits with a skip reason, with fewer than 1.25 rows a regressor, a condition number above 1e10
    or a rank deficit are not ranked. Of the others, the score is half the share of them with as
    many rows a regressor or fewer, 0.3 that of log10 condition (lower is better) and 0.2 that of
    the share of controls dropped, ties at their mean, less 0.1 if the controls were capped and 0.1 if
    any was dropped, within 0 and 1. Medium is from 0.33, high from 0.67; capped fits need 0.85, 3
    rows a regressor and a condition of at most 1e6 for high. A fit whose rows or condition are
    missing has no score and is low. Ranks count within the whole table, in ranges and not in
    one task: shares come from counts of equal values.
    """
    capped_, no = F.coalesce(F.col(capped).cast("boolean"), F.lit(False)), F.lit(False)
    share = F.coalesce(F.col(dropped), F.lit(0)) / F.when(F.col(selected) > 0, F.col(selected)).otherwise(1)
    hard = F.coalesce(F.col(obs) < LEAST_OBS, no) | F.coalesce(F.col(condition) > MOST_CONDITION, no) | F.coalesce(F.col(deficit) > 0, no)
    rows = fits.withColumns({"dropped_share": share, "hard_low": hard, "__skip": F.col(skipped).isNotNull()}).withColumn("__in", ~F.col("__skip") & ~F.col("hard_low"))
    values = {"obs": F.col(obs).cast("double"), "cond": F.when(F.col(condition) > 0, -F.log10(condition)), "drop": -F.col("dropped_share")}
    rows = rows.withColumns({f"__{k}": F.when(F.col("__in"), v) for k, v in values.items()})
    for k in values:
        rows = _with_share_below(rows, f"__{k}", f"rank_{k}")
    blended = sum((w * F.col(f"rank_{k}") for k, w in RANK_WEIGHTS.items()), F.lit(0.0))
    blended = blended - PENALTY * capped_.cast("int") - PENALTY * (F.col("dropped_share") > 0).cast("int")
    rows = rows.withColumn("score", F.when(blended.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), blended))))
    strong = (F.col("score") >= VERY_STRONG) & F.coalesce(F.col(obs) >= STRONG_OBS, no) & F.coalesce(F.col(condition) <= STRONG_CONDITION, no)
    high = (F.col("score") >= HIGH) & (~capped_ | strong)
    tier = F.when(F.col("__skip"), "skip").when(high, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    return rows.withColumn("tier", tier).drop("__skip", "__in", *[f"__{k}" for k in values])


def _with_share_below(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the share of non-null values at or below each, ties at their mean rank."""
    share = (F.col("below") + (F.col("own") + 1) / 2) / F.col("total")
    return rows.join(ranged_sums(rows, value, F.lit(1)).select(value, share.alias(name)), value, "left")
