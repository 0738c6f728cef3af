"""Expansion of jobs to question packs, and of screened instruments and controls to contracts and permutation targets, with the reasons of what is skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns that a contract's id is made of, in order (fixed).
ID_COLUMNS = ["contract_type", "treatment", "outcome", "instrument", "nc_outcome", "force_w_series", "w_spec", "horizon", "sample_split_id", "resid_mode", "fold_spec", "seed"]


def safe_token(text: Column) -> Column:
    """Letters and digits in lower case, runs of anything else as one underscore; ``item`` if nothing is left."""
    token = F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(token == "", "item").otherwise(token)


def question_packs(jobs: DataFrame, order: str = "job", horizon_start: int = -4, horizon_end: int = 8, enabled_limit: int = 1, enabled_ids: list[str] | None = None, include: dict[str, list[str]] | None = None, exclude: dict[str, list[str]] | None = None, use_job_horizons: bool = True, settings: dict | None = None) -> DataFrame:
    """One row for each treatment and outcome that jobs ask for, and for each job that is skipped.

    jobs: (job, treatment, outcome, horizons: array, mode), taken in the order of ``job``. A pack
    has question_id (auto_<treatment>_<outcome>, numbered from 2 where names meet), label, enabled (the
    first ``enabled_limit`` packs, all if it is negative, or ``enabled_ids``), horizon_start, horizon_end
    (no less than any job's horizon), modes and ``settings`` as constant columns; its skip_reason is
    null. A skipped job has its number in ``job`` and a reason: no_treatment, no_outcome, not_included, excluded. include and exclude: lists under ``treatment`` and ``outcome``.
    """
    include, exclude = include or {}, exclude or {}
    trimmed = jobs.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("treatment", "outcome")})
    reason = F.when(F.col("treatment") == "", "no_treatment").when(F.col("outcome") == "", "no_outcome")
    for c in ("treatment", "outcome"):
        if include.get(c):
            reason = reason.when(~F.col(c).isin(include[c]), "not_included")
    for c in ("treatment", "outcome"):
        if exclude.get(c):
            reason = reason.when(F.col(c).isin(exclude[c]), "excluded")
    judged = trimmed.withColumn("skip_reason", reason)
    top = F.coalesce(F.array_max("horizons"), F.lit(horizon_end))
    modes = F.array_join(F.array_sort(F.collect_set(F.when(F.trim("mode") != "", F.trim("mode")))), ",")
    packs = judged.filter("skip_reason is null").groupBy("treatment", "outcome").agg(F.min(order).alias("first_job"), F.max(top).alias("top"), modes.alias("modes"))
    base = F.concat_ws("_", F.lit("auto"), safe_token(F.col("treatment")), safe_token(F.col("outcome")))
    packs = packs.withColumns({"base": base, "index": F.row_number().over(Window.orderBy("first_job", "treatment", "outcome"))})  # a row for each pair asked for
    for _ in range(2):  # a numbered name may meet another pack's own
        k = F.row_number().over(Window.partitionBy("base").orderBy("index"))
        packs = packs.withColumn("base", F.when(k == 1, F.col("base")).otherwise(F.concat_ws("_", "base", k)))
    enabled = F.col("base").isin(enabled_ids) if enabled_ids else (F.lit(True) if enabled_limit < 0 else F.col("index") <= enabled_limit)
    end = F.greatest(F.lit(horizon_end), F.col("top")) if use_job_horizons else F.lit(horizon_end)
    label = F.concat(F.lit("Auto: "), "treatment", F.lit(" -> "), "outcome")
    made = packs.select("treatment", "outcome", F.lit(None).cast(jobs.schema[order].dataType).alias("job"), F.col("base").alias("question_id"), label.alias("label"), enabled.alias("enabled"), F.lit(horizon_start).alias("horizon_start"), end.cast("int").alias("horizon_end"), F.when(F.col("modes") == "", "unknown").otherwise(F.col("modes")).alias("modes"), F.lit(None).cast("string").alias("skip_reason"))
    skipped = judged.filter("skip_reason is not null").select("treatment", "outcome", F.col(order).alias("job"), "skip_reason")
    return made.unionByName(skipped, allowMissingColumns=True).withColumns({k: F.lit(v) for k, v in (settings or {}).items()})


def pack_questions(packs: DataFrame, horizons: list[int], designs: list[str]) -> DataFrame:
    """(question_id, treatment, outcome, horizon, design): what enabled packs ask, for those of ``horizons`` that lie in their range."""
    rows = packs.filter(F.col("skip_reason").isNull() & F.col("enabled"))
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).filter("horizon between horizon_start and horizon_end")
    return rows.select("question_id", "treatment", "outcome", "horizon", F.explode(F.array(*[F.lit(d) for d in designs])).alias("design"))


def _matched(controls: DataFrame, questions: DataFrame) -> DataFrame:
    """Control rows with the treatment they are for: the one they name, if the map asks for it with their outcome, else every one that the map has with it."""
    pairs = questions.select("treatment", "outcome").distinct()
    rows = controls.withColumns({"hint": F.trim(F.coalesce("treatment", F.lit(""))), "outcome": F.trim(F.coalesce("target_outcome", F.lit("")))}).drop("treatment", "target_outcome").filter("outcome <> ''")
    named = rows.join(pairs.select(F.col("treatment").alias("hint"), "outcome"), ["hint", "outcome"], "left_semi").withColumn("treatment", F.col("hint"))
    others = rows.join(pairs.select(F.col("treatment").alias("hint"), "outcome"), ["hint", "outcome"], "left_anti").join(pairs, "outcome")
    return named.unionByName(others)


def _w_spec(transform: Column, lag: Column) -> Column:
    """<transform>_lag<k>; a missing transform is raw, a lag that is missing or negative 0."""
    return F.concat(F.lower(F.trim(F.coalesce(transform, F.lit("raw")))), F.lit("_lag"), F.when(lag >= 0, lag).otherwise(0).cast("int").cast("string"))


def contracts(instruments: DataFrame, controls: DataFrame, questions: DataFrame, fields: dict[str, str | int]) -> DataFrame:
    """Contracts of every selected instrument and control, for the horizons that the question map asks for, each with contract_id.

    instruments: (treatment, candidate, transform, lag, selected); controls: (treatment, target_outcome,
    nc_outcome, rank, score, selected); questions: (treatment, outcome, horizon of 0 or more); fields: sample_split_id,
    resid_mode, fold_spec, seed. An instrument gives iv_lp and iv_dml, a control nc_test, and the best control of a
    treatment and outcome (lowest rank, then highest score, then name; missing ranks last) one nc_adjust_main.
    The id is the type and the first 16 digits of a SHA-1 of all other columns. Rows that repeat stay; names are trimmed.
    """
    asked = questions.filter("horizon >= 0").select("treatment", "outcome", F.col("horizon").cast("int").alias("horizon")).distinct()
    none = F.lit("")
    iv = instruments.filter("selected").withColumn("treatment", F.trim("treatment")).join(asked, "treatment")
    iv = iv.withColumn("contract_type", F.explode(F.array(F.lit("iv_lp"), F.lit("iv_dml"))))
    iv = iv.select("contract_type", "treatment", "outcome", F.trim("candidate").alias("instrument"), none.alias("nc_outcome"), none.alias("force_w_series"), _w_spec(F.col("transform"), F.col("lag")).alias("w_spec"), "horizon")
    matched = _matched(controls.filter("selected"), asked)
    nc = F.trim(F.coalesce("nc_outcome", none))
    test = matched.join(asked, ["treatment", "outcome"]).select(F.lit("nc_test").alias("contract_type"), "treatment", "outcome", none.alias("instrument"), nc.alias("nc_outcome"), none.alias("force_w_series"), F.lit("default").alias("w_spec"), "horizon")
    best = Window.partitionBy("treatment", "outcome").orderBy(F.asc_nulls_last("rank"), F.desc_nulls_last("score"), nc)
    main = matched.filter(nc != "").withColumn("__r", F.row_number().over(best)).filter("__r = 1").join(asked, ["treatment", "outcome"])
    main = main.select(F.lit("nc_adjust_main").alias("contract_type"), "treatment", "outcome", none.alias("instrument"), nc.alias("nc_outcome"), nc.alias("force_w_series"), F.lit("default").alias("w_spec"), "horizon")
    rows = reduce(DataFrame.unionByName, [iv, test, main]).withColumns({k: F.lit(fields[k]) for k in ID_COLUMNS[-4:]})
    digest = F.substring(F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in ID_COLUMNS])), 1, 16)
    return rows.withColumn("contract_id", F.concat_ws("_", "contract_type", digest))


def contract_skips(instruments: DataFrame, controls: DataFrame, questions: DataFrame) -> DataFrame:
    """(kind, treatment, outcome, name, reason) of the rows that ``contracts`` makes nothing of: not_selected, no_treatment or no_outcome, or no_question."""
    asked = questions.filter("horizon >= 0")
    iv = instruments.select(F.lit("instrument").alias("kind"), F.trim(F.coalesce("treatment", F.lit(""))).alias("treatment"), F.lit("").alias("outcome"), F.trim("candidate").alias("name"), "selected")
    iv = iv.join(asked.select("treatment").distinct().withColumn("__asked", F.lit(True)), "treatment", "left").withColumn("__empty", F.when(F.col("treatment") == "", "no_treatment"))
    nc = controls.select(F.lit("control").alias("kind"), F.trim(F.coalesce("treatment", F.lit(""))).alias("treatment"), F.trim(F.coalesce("target_outcome", F.lit(""))).alias("outcome"), F.trim("nc_outcome").alias("name"), "selected")
    nc = nc.join(asked.select("outcome").distinct().withColumn("__asked", F.lit(True)), "outcome", "left").withColumn("__empty", F.when(F.col("outcome") == "", "no_outcome"))
    reason = F.when(~F.coalesce("selected", F.lit(False)), "not_selected").when(F.col("__empty").isNotNull(), F.col("__empty")).when(F.col("__asked").isNull(), "no_question")
    return iv.unionByName(nc).withColumn("reason", reason).filter("reason is not null").select("kind", "treatment", "outcome", "name", "reason")


def permutation_targets(contract_rows: DataFrame) -> DataFrame:
    """(treatment, outcome, horizon, w_spec): what is to be permuted once for all contracts of instruments and control tests that share it."""
    return contract_rows.filter("contract_type in ('iv_lp', 'nc_test')").select("treatment", "outcome", "horizon", "w_spec").distinct()
