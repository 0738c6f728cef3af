"""Instruments: screens by fits chained over folds, and strength, two-stage estimates and robust sets for any number of them, given controls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import chi2_p, normal_p
from macrotide.operators.controls import design_guards, partial_out

#: Factors on a candidate's score for what it fails (fixed values).
PENALTIES = {"pass_directionality": 0.65, "forward_chain_ok": 0.60, "pretrend_ok": 0.85, "specificity_ok": 0.85}
WEAK_PENALTY, WEAK_F = 0.55, 10.0
FRAGILE = {"lead_fail": 0.80, "episode_fail": 0.80, "wspec_fail": 0.90}
#: What a screen's checks are called in its reasons, in order.
REASONS = {"pass_feasibility": "FEASIBILITY_FAIL", "pass_directionality": "DIRECTIONALITY_FAIL", "forward_chain_ok": "FORWARD_CHAIN_FAIL", "pretrend_ok": "PRETREND_FAIL", "specificity_ok": "SPECIFICITY_FAIL"}


def candidate_forms(candidates: DataFrame, transforms: list[str], max_lag: int, by: str = "candidate", at: str = "date", x: str = "value", least: int = 10) -> DataFrame:
    """(candidate, transform, lag, date, z) of (candidate, date, value): each transform, ``lag`` rows late.

    diff; logdiff (of positive neighbours); innov: the value less a + b * value, with a and b from
    the fit of values on the one before over ``least`` rows or more. Rows without a z are left out.
    """
    w = Window.partitionBy(by).orderBy(at)
    rows = candidates.withColumn("before", F.lag(x).over(w))
    v, before, whole = F.col(x), F.col("before"), Window.partitionBy(by)
    pairs = F.count(F.when(v.isNotNull() & before.isNotNull(), 1)).over(whole)
    slope, base = F.regr_slope(v, before).over(whole), F.regr_intercept(v, before).over(whole)
    forms = {"diff": v - before, "logdiff": F.when((v > 0) & (before > 0), F.ln(v) - F.ln(before)), "innov": F.when(pairs >= least, v - base - slope * v)}
    long = rows.select(by, at, *[forms[t].alias(t) for t in transforms]).select(by, at, F.explode(F.array(*[F.struct(F.lit(t).alias("transform"), F.col(t).alias("z")) for t in transforms])).alias("f")).select(by, at, "f.*")
    late = Window.partitionBy(by, "transform").orderBy(at)
    lags = [F.struct(F.lit(k).alias("lag"), (F.lag("z", k).over(late) if k else F.col("z")).alias("z")) for k in range(max_lag + 1)]
    return long.select(by, "transform", at, F.array(*lags).alias("l")).select(by, "transform", at, F.explode("l").alias("l")).select(by, "transform", "l.lag", at, "l.z").filter("z is not null")


def fold_of(place: Column, n: Column, folds: int) -> Column:
    """The fold (from 0) of the row at ``place`` (from 0) among n, in runs that differ by one row at most, longer ones first."""
    size, more = F.floor(n / folds), n % folds  # 0 where there are fewer rows than folds
    return F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")


def _slope(s: dict[str, Column]) -> tuple[Column, Column]:
    """(intercept, slope) of y on z from sums; without variation of z the slope is 0."""
    spread = s["n"] * s["zz"] - s["z"] * s["z"]
    b = F.when(spread > 1e-12 * F.greatest(s["n"] * s["zz"], F.lit(1e-300)), (s["n"] * s["zy"] - s["z"] * s["y"]) / spread).otherwise(0.0)
    return F.try_divide(s["y"] - b * s["z"], s["n"]), b


def chained_fits(rows: DataFrame, keys: list[str], at: str, y: str, z: str, folds: int = 5, least_train: int = 12) -> DataFrame:
    """(*keys, n, r2_cv, r2_cv_pooled) of the fit of y on z in each group, judged on folds of consecutive rows.

    r2_cv: every fold is foretold by the rows before it, if these are ``least_train`` or more;
    r2_cv_pooled: by all others. Both are 1 less the squared errors over the squared distances from
    the group's mean, within -1 and 1; null for groups too short for their folds. Fits come from
    sums of each fold, added up along folds; a group's rows are only ordered once.
    """
    held = rows.filter(F.col(y).isNotNull() & F.col(z).isNotNull())
    whole = Window.partitionBy(*keys)
    held = held.withColumns({"__i": F.row_number().over(whole.orderBy(at)) - 1, "__n": F.count("*").over(whole), "__y": F.col(y) - F.avg(y).over(whole), "__z": F.col(z) - F.avg(z).over(whole)})
    sums = {"n": F.count("*"), "z": F.sum("__z"), "y": F.sum("__y"), "zz": F.sum(F.col("__z") * F.col("__z")), "zy": F.sum(F.col("__z") * F.col("__y")), "yy": F.sum(F.col("__y") * F.col("__y"))}
    parts = held.groupBy(*keys, fold_of(F.col("__i"), F.col("__n"), folds).alias("__fold")).agg(*[s.alias(f"own_{k}") for k, s in sums.items()])
    before = whole.orderBy("__fold").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({**{f"fore_{k}": F.sum(f"own_{k}").over(before) for k in sums}, **{f"rest_{k}": F.sum(f"own_{k}").over(whole) - F.col(f"own_{k}") for k in sums}})
    own = {k: F.col(f"own_{k}") for k in sums}
    for side, least in (("fore", least_train), ("rest", 3)):
        a, b = _slope({k: F.col(f"{side}_{k}") for k in sums})
        parts = parts.withColumns({f"{side}_a": a, f"{side}_b": b}).withColumn(f"{side}_held", F.coalesce(F.col(f"{side}_n") >= least, F.lit(False)))
        a, b = F.col(f"{side}_a"), F.col(f"{side}_b")
        parts = parts.withColumn(f"{side}_error", own["yy"] - 2 * a * own["y"] - 2 * b * own["zy"] + own["n"] * a * a + 2 * a * b * own["z"] + b * b * own["zz"])
    n = F.sum("own_n")
    enough = {"fore": n >= max(12, 2 * folds, least_train + 2, folds + 2), "rest": n >= max(10, folds + 1)}

    def share(side: str) -> Column:
        held = F.col(f"{side}_held")
        error, total = F.sum(F.when(held, F.col(f"{side}_error"))), F.sum(F.when(held, F.col("own_yy")))
        return F.when(enough[side] & (total > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - error / total)))

    return parts.groupBy(*keys).agg(n.alias("n"), share("fore").alias("r2_cv"), share("rest").alias("r2_cv_pooled"))


def _abs_t(r2: Column, n: Column) -> Column:
    """|t| of a slope; null below three rows, without variation, and for a perfect fit."""
    return F.when((n >= 3) & (r2 < 1), F.sqrt(r2 * F.greatest(n - 2, F.lit(1)) / (1 - r2)))


def instrument_screen(treatments: DataFrame, candidates: DataFrame, pairs: DataFrame, transforms: list[str], max_lag: int = 4, least_rows: int = 24, lead_max: int = 2, p_max: float = 0.1, forward_min: float = 0.0, gap_max: float = 0.25, folds: int = 5, top: int = 5, most_other: float = 0.30, most_lead_t: float = 2.0, fragility: DataFrame | None = None) -> DataFrame:
    """One row for each (treatment, candidate, transform, lag): checks, score, place in its treatment and whether it is among the first ``top``.

    treatments: (treatment, date, y); candidates: (candidate, date, value); pairs: (treatment,
    candidate). Fits are of y on z (``candidate_forms``) with a constant. ``t_pre_max`` is the
    largest |t| of y one to ``lead_max`` rows ahead, ``rho_max_other`` the largest |correlation| of z
    with another treatment. fragility: (treatment, lead_fail, episode_fail, wspec_fail). Checks that
    cannot be made (too few rows, no variation) fail, but for leads, which then pass.
    """
    key = ["treatment", "candidate", "transform", "lag"]
    w = Window.partitionBy("treatment").orderBy("date")
    ys = treatments.withColumns({f"y{k}": F.lead("y", k).over(w) for k in range(1, lead_max + 1)})
    sides = pairs.select("treatment").distinct().join(ys, "treatment")
    forms = candidate_forms(candidates, transforms, max_lag)
    # every treatment of the screen meets every candidate of it: what is not asked for still counts as "other"
    asked = pairs.select("candidate").distinct().crossJoin(pairs.select("treatment").distinct())  # names only
    rows = asked.join(forms, "candidate").join(sides, ["treatment", "date"])
    z = F.col("z")
    leads = [x for k in range(1, lead_max + 1) for x in (F.regr_r2(f"y{k}", z).alias(f"lead_r2_{k}"), F.regr_count(F.col(f"y{k}"), z).alias(f"lead_n_{k}"))]
    both = F.col("y").isNotNull()
    fits = rows.groupBy(*key).agg(F.count(F.when(both, z)).alias("rows"), F.var_pop(F.when(both, z)).alias("spread"), F.regr_r2("y", z).alias("r2"), F.min(F.when(both, F.col("date"))).alias("sample_start"), F.max(F.when(both, F.col("date"))).alias("sample_end"), *leads)
    size = F.sqrt("r2")
    order = Window.partitionBy("candidate", "transform", "lag").orderBy(F.desc_nulls_last("size")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fits = fits.withColumn("size", F.when(F.col("rows") >= 3, size)).withColumns({"most": F.first("size").over(order), "second": F.nth_value("size", 2).over(order), "first_treatment": F.first("treatment").over(order)})
    fits = fits.withColumn("rho_max_other", F.coalesce(F.when(F.col("first_treatment") == F.col("treatment"), F.col("second")).otherwise(F.col("most")), F.lit(0.0)))
    fits = fits.join(pairs.distinct(), ["treatment", "candidate"]).join(chained_fits(rows, key, "date", "y", "z", folds).drop("n"), key, "left")
    if fragility is not None:
        fits = fits.join(fragility, "treatment", "left")
    fits = fits.withColumns({c: F.coalesce(F.col(c), F.lit(False)) if fragility is not None else F.lit(False) for c in FRAGILE})

    fits = fits.withColumn("pass_feasibility", (F.col("rows") >= least_rows) & F.coalesce(F.col("spread") >= 1e-12, F.lit(False)))
    able = lambda c: F.when(F.col("pass_feasibility"), c)
    fits = fits.withColumns({"first_stage_t": able(_abs_t(F.col("r2"), F.col("rows"))), "partial_r2": able(F.col("r2")), "r2_cv": able(F.col("r2_cv")), "r2_cv_pooled": able(F.col("r2_cv_pooled")), "t_pre_max": F.greatest(F.lit(None), F.lit(None).cast("double"), *[_abs_t(F.col(f"lead_r2_{k}"), F.col(f"lead_n_{k}")) for k in range(1, lead_max + 1)])})
    fits = fits.withColumns({"first_stage_f": F.col("first_stage_t") * F.col("first_stage_t"), "cv_leak_gap": F.col("r2_cv_pooled") - F.col("r2_cv")})
    no = F.lit(False)
    fits = fits.withColumns({
        "pass_directionality": F.coalesce(normal_p(F.col("first_stage_t")) <= p_max, no),
        "forward_chain_ok": F.coalesce((F.col("r2_cv") >= forward_min) & F.coalesce(F.col("cv_leak_gap") <= gap_max, F.lit(True)), no),
        "pretrend_ok": F.coalesce(F.col("t_pre_max") <= most_lead_t, F.lit(True)),
        "specificity_ok": F.col("rho_max_other") < most_other,
        "weak_iv": F.coalesce(F.col("first_stage_f") < WEAK_F, no),
    })
    unit = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), F.lit(0.0))
    parts = 0.40 * F.coalesce(F.least(F.lit(1.0), F.col("first_stage_t") / 10), F.lit(0.0)) + 0.25 * F.coalesce(F.least(F.lit(1.0), F.log1p("first_stage_f") / math.log1p(400.0)), F.lit(0.0))
    parts = parts + 0.20 * F.when(F.col("partial_r2").isNotNull(), unit(F.col("partial_r2"))).otherwise(0.0) + 0.15 * F.when(F.col("r2_cv").isNotNull(), unit(F.col("r2_cv"))).otherwise(0.0)
    for check, factor in PENALTIES.items():
        parts = parts * F.when(F.col(check), 1.0).otherwise(factor)
    for flag, factor in {"weak_iv": WEAK_PENALTY, **FRAGILE}.items():
        parts = parts * F.when(F.col(flag), factor).otherwise(1.0)
    known = F.col("first_stage_t").isNotNull() | F.col("partial_r2").isNotNull() | F.col("r2_cv").isNotNull()
    fits = fits.withColumn("score", F.when(known, F.least(F.lit(1.0), parts)))
    place = F.row_number().over(Window.partitionBy("treatment").orderBy(F.desc_nulls_last(F.round("score", 10)), "candidate", "transform", "lag"))
    out = fits.withColumn("place", place)
    out = out.withColumn("selected", (F.col("place") <= top) & F.col("pass_feasibility") & F.col("pass_directionality") & F.col("forward_chain_ok"))
    kept = ["rows", "sample_start", "sample_end", "first_stage_t", "first_stage_f", "partial_r2", "r2_cv", "r2_cv_pooled", "cv_leak_gap", "t_pre_max", "rho_max_other", *REASONS, "weak_iv", *FRAGILE, "score", "place", "selected"]
    return out.select(*key, *kept)


def screen_decisions(screened: DataFrame) -> DataFrame:
    """(treatment, candidate, decision, reasons) of an ``instrument_screen``: what no form of a candidate passes, and whether its best form was selected.

    drop: no form is feasible; select: the best form (by score) was selected; else demote.
    """
    best = F.max_by("selected", F.struct(F.coalesce(F.round("score", 10), F.lit(-1.0)), -F.col("place")))
    flags = [F.max(c).alias(c) for c in [*REASONS, "weak_iv", *FRAGILE]]
    sums = screened.groupBy("treatment", "candidate").agg(best.alias("selected"), *flags)
    failed = [F.when(~F.col(c), F.lit(name)) for c, name in REASONS.items()] + [F.when(F.col("weak_iv"), F.lit("WEAK_IV"))] + [F.when(F.col(c), F.lit(f"BASELINE_{c.upper()}")) for c in FRAGILE]
    sums = sums.withColumn("reasons", F.concat_ws(";", *failed))
    reasons = F.when(F.col("reasons") != "", F.col("reasons")).when(F.col("selected"), "PASS").otherwise("RANK")
    decision = F.when(~F.col("pass_feasibility"), "drop").when(F.col("selected"), "select").otherwise("demote")
    return sums.select("treatment", "candidate", decision.alias("decision"), reasons.alias("reasons"))


def _hac_products(rows: DataFrame, by: list[str], at: str, scores: list[str], lags: int) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """Rows get the lags of scores; the sums, for i <= j, of the long-run products of scores with Bartlett weights."""
    w = Window.partitionBy(*by).orderBy(at)
    late = {(c, k): F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for c in scores for k in range(1, lags + 1)}
    named = {key: f"__late_{key[0]}_{key[1]}" for key in late}
    rows = rows.withColumns({named[key]: v for key, v in late.items()})
    out = {}
    for i, a in enumerate(scores):
        for j in range(i, len(scores)):
            b = scores[j]
            term = F.col(a) * F.col(b)
            for k in range(1, lags + 1):
                term = term + (1 - k / (lags + 1)) * (F.col(a) * F.col(named[b, k]) + F.col(b) * F.col(named[a, k]))
            out[i, j] = F.sum(term)
    return rows, out


def score_moments(df: DataFrame, by: list[str], at: str, targets: list[str], zs: list[str], ws: list[str], lags: int) -> DataFrame:
    """(*by, n, reason, pi, q, omega, ss): what tests of instruments need, once controls are cleared.

    targets and zs are cleared of a constant and ws in each group. pi: slopes of each target on all zs,
    one array a target; q: the k x k sums of products of zs; omega: long-run (Bartlett) sums of products
    of the scores z * residual, all scores of the first target first; ss: sums of squares of each cleared target and of
    its residual. Rows with a null in any column are left out; a group that has no fit has a reason.
    """
    held = df.dropna(subset=[*targets, *zs, *ws])
    if ws:
        cleared = partial_out(held, by, [*targets, *zs], ws)
    else:
        whole = Window.partitionBy(*by)
        cleared = held.withColumns({f"r_{c}": F.col(c) - F.avg(c).over(whole) for c in (*targets, *zs)})
    z = [f"r_{c}" for c in zs]
    fits = design_guards(cleared, by, [f"r_{t}" for t in targets], z, free=1, most_condition=1e14).drop("n", "used", "condition")
    rows = cleared.join(fits, by)
    left = {f"u_{i}": F.col(f"r_{t}") - sum((F.col(f"b_r_{t}")[j + 1] * F.col(c) for j, c in enumerate(z)), F.lit(0.0)) for i, t in enumerate(targets)}
    rows = rows.withColumns(left)
    scores = {f"s_{i}_{j}": F.col(f"u_{i}") * F.col(c) for i in range(len(targets)) for j, c in enumerate(z)}
    rows = rows.withColumns(scores)
    rows, products = _hac_products(rows, by, at, list(scores), lags)
    m, k = len(scores), len(zs)
    sums = [F.count("*").alias("n"), F.first("reason").alias("reason"), F.array(*[F.slice(F.first(f"b_r_{t}"), 2, k) for t in targets]).alias("pi")]
    sums.append(F.array(*[F.sum(F.col(a) * F.col(b)) for a in z for b in z]).alias("q"))
    sums.append(F.array(*[products[min(i, j), max(i, j)] for i in range(m) for j in range(m)]).alias("omega"))
    sums.append(F.array(*[F.array(F.sum(F.col(f"r_{t}") * F.col(f"r_{t}")), F.sum(F.col(f"u_{i}") * F.col(f"u_{i}"))) for i, t in enumerate(targets)]).alias("ss"))
    return rows.groupBy(*by).agg(*sums)


def _wald(pi: np.ndarray, q: np.ndarray, omega: np.ndarray) -> float:
    """pi' Q omega^-1 Q pi; NaN if omega is singular, or more ill-conditioned than 1e16."""
    if not np.isfinite(omega).all() or not np.linalg.cond(omega) <= 1e16:
        return np.nan
    stat = float(pi @ q @ np.linalg.solve(omega, q @ pi))
    return stat if stat > 0 else np.nan


def first_stage_strength(df: DataFrame, by: list[str], at: str, d: str, zs: list[str], ws: list[str] | None = None, lags: int = 4) -> DataFrame:
    """(*by, n, reason, t, f_eff, underid_p, partial_r2): how strongly the instruments zs move d in each group, given controls ws.

    t: the largest |HAC t| of an instrument; f_eff: the robust Wald statistic of all of them over
    their number; underid_p: its chi-square tail; partial_r2: the share of d's cleared squares that they
    explain. Null where the group has no fit (``reason``) or the long-run covariance is singular.
    """
    k = len(zs)
    moments = score_moments(df, by, at, [d], zs, ws or [], lags)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for pi, q, omega, ss, reason in zip(frame["pi"], frame["q"], frame["omega"], frame["ss"], frame["reason"]):
                pi, q, omega = np.array(pi[0], float), np.array(q, float).reshape(k, k), np.array(omega, float).reshape(k, k)
                if reason is not None or not np.linalg.cond(q) <= 1e14:
                    out.append((np.nan, np.nan, np.nan))
                    continue
                inverse = np.linalg.inv(q)
                cov = np.diag(inverse @ omega @ inverse)
                t = np.max(np.abs(pi) / np.sqrt(cov)) if (cov > 0).all() else np.nan
                out.append((t, _wald(pi, q, omega), (ss[0][0] - ss[0][1]) / ss[0][0] if ss[0][0] > 0 else np.nan))
            found = pd.DataFrame(out, columns=["t", "wald", "partial_r2"])
            yield pd.concat([frame[[*by, "n", "reason"]].reset_index(drop=True), found], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "n"]) + ", reason string, t double, wald double, partial_r2 double"
    out = moments.mapInPandas(run, schema)
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("t", "wald", "partial_r2")})
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("partial_r2")))
    return out.select(*by, "n", "reason", "t", (F.col("wald") / k).alias("f_eff"), chi2_p(F.col("wald"), k).alias("underid_p"), F.when(F.col("partial_r2").isNotNull(), unit).alias("partial_r2"))


def two_stage(df: DataFrame, by: list[str], at: str, y: str, d: str, zs: list[str], ws: list[str] | None = None, lags: int = 4) -> DataFrame:
    """(*by, n, beta, se, z, p): two-stage least squares of y on d by any number of instruments, given controls ws, with HAC errors.

    y, d and zs are cleared of a constant and ws; the first stage's fit of d is then the
    instrument. Groups without a first stage are left out.
    """
    held = df.dropna(subset=[y, d, *zs, *(ws or [])])
    if ws:
        rows = partial_out(held, by, [y, d, *zs], ws)
    else:
        whole = Window.partitionBy(*by)
        rows = held.withColumns({f"r_{c}": F.col(c) - F.avg(c).over(whole) for c in (y, d, *zs)})
    z = [f"r_{c}" for c in zs]
    fits = design_guards(rows, by, [f"r_{d}"], z, free=1).filter("reason is null").select(*by, f"b_r_{d}")
    rows = rows.join(fits, by).withColumn("__hat", sum((F.col(f"b_r_{d}")[j + 1] * F.col(c) for j, c in enumerate(z)), F.lit(0.0)))
    slopes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("__hat") * F.col(f"r_{y}")).alias("__hy"), F.sum(F.col("__hat") * F.col(f"r_{d}")).alias("__hd"))
    rows = rows.join(slopes, by).withColumn("beta", F.try_divide("__hy", F.nullif("__hd", F.lit(0.0))))
    rows = rows.withColumn("__s", F.col("__hat") * (F.col(f"r_{y}") - F.col("beta") * F.col(f"r_{d}")))
    rows, products = _hac_products(rows, by, at, ["__s"], lags)
    out = rows.groupBy(*by).agg(F.first("n").alias("n"), F.first("beta").alias("beta"), F.first("__hd").alias("__hd"), products[0, 0].alias("__meat"))
    out = out.withColumn("se", F.try_divide(F.sqrt(F.greatest("__meat", F.lit(0.0))), F.abs("__hd"))).withColumn("z", F.try_divide("beta", "se"))
    return out.select(*by, "n", "beta", "se", "z", normal_p(F.col("z")).alias("p"))


def anderson_rubin(df: DataFrame, by: list[str], at: str, y: str, d: str, zs: list[str], ws: list[str] | None = None, lags: int = 4, alpha: float = 0.05, points: int = 61, radius: float = 6.0, expansions: int = 3) -> DataFrame:
    """(*by, n, theta, lo, hi, status): the effects of d on y that any number of instruments do not reject together.

    For an effect theta the instruments should not move y - theta d: their robust Wald statistic
    is a ratio of quadratics in theta, made from one pass of sums. It is held against the
    chi-square of as many degrees of freedom on a grid around the two-stage estimate, ``radius`` of
    its errors wide, which is doubled until the set lies inside: ``inside``, else ``edge`` or ``empty``.
    """
    k = len(zs)
    moments = score_moments(df, by, at, [y, d], zs, ws or [], lags).filter("reason is null")
    critical = _chi2_quantile(1 - alpha, k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for pi, q, omega in zip(frame["pi"], frame["q"], frame["omega"]):
                (py, pd_), q, omega = (np.array(p, float) for p in pi), np.array(q, float).reshape(k, k), np.array(omega, float).reshape(2 * k, 2 * k)
                yy, yd, dd = omega[:k, :k], omega[:k, k:], omega[k:, k:]
                pull = pd_ @ q @ pd_
                theta = float(pd_ @ q @ py / pull) if pull > 0 else np.nan
                error = np.sqrt(max(pd_ @ (yy - theta * (yd + yd.T) + theta**2 * dd) @ pd_, 0)) / pull if pull > 0 else np.nan
                found = (theta, np.nan, np.nan, "empty")
                if np.isfinite(error):
                    reach = radius * error if error > 0 else 1.0
                    for e in range(expansions + 1):
                        grid = theta + reach * 2**e * np.linspace(-1, 1, points)
                        fits = np.array([not _wald(py - v * pd_, q, yy - v * (yd + yd.T) + v * v * dd) > critical for v in grid])
                        at_ = np.flatnonzero(fits)
                        if not len(at_):
                            found = (theta, np.nan, np.nan, "empty")
                            continue
                        inside = at_[0] > 0 and at_[-1] < points - 1
                        found = (theta, float(grid[at_[0]]), float(grid[at_[-1]]), "inside" if inside else "edge")
                        if inside:
                            break
                out.append(found)
            yield pd.concat([frame[[*by, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["theta", "lo", "hi", "status"])], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema}
    out = moments.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "n"]) + ", theta double, lo double, hi double, status string")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("theta", "lo", "hi")})


def _chi2_tail(x: float, df: int) -> float:
    half, odd = x / 2, df % 2
    term, total = (2 * math.sqrt(half / math.pi) * math.exp(-half), math.erfc(math.sqrt(half))) if odd else (math.exp(-half), 0.0)
    for i in range((df - odd) // 2):
        total += term
        term *= half / (i + (1.5 if odd else 1.0))
    return total


def _chi2_quantile(share: float, df: int) -> float:
    """Where the chi-square distribution reaches a share, by halving."""
    lo, hi = 0.0, 10.0 * df + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - _chi2_tail(mid, df) < share else (lo, mid)
    return (lo + hi) / 2
