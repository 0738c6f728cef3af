"""Paths from low-frequency totals and an indicator: proportional and regression methods, and the choice between methods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr

#: Autocorrelations that are tried, by method.
RHOS = {"chow_lin": [-0.9 + 0.05 * k for k in range(38)], "litterman": [0.98 * k / 39 for k in range(40)], "fernandez": [0.0]}

#: What an indicator must reach for a method (fixed values); ``denton`` needs nothing.
LOOSE = {"coverage": 0.45, "strength": 1e-5, "rank": 1, "corr": 0.18, "ratio_share": 0.45, "ratio_cv": 10.0, "ratio_drift": 8.0, "outliers": 0.55}
RULES = {"chow_lin": {"coverage": 0.55, "strength": 1e-5, "rank": 1, "corr": 0.22, "ratio_share": 0.5, "ratio_cv": 8.0, "ratio_drift": 6.0, "outliers": 0.5}, "denton_proportional": LOOSE, "litterman": LOOSE, "fernandez": LOOSE}
#: Of a rule, these are upper bounds.
UPPER = ("ratio_cv", "ratio_drift", "outliers")


def blocks(low: DataFrame, high: DataFrame, per: int, by: str = "series") -> DataFrame:
    """(series, block, total, reason, slots): a row for each total, with its indicator's values in order of date.

    low: (series, block, total). high: (series, block, date, indicator). ``reason`` says why a
    series cannot follow its indicator in proportion: ``missing_total``, ``nonpositive_total``,
    ``missing_indicator`` (not ``per`` values in each block) or ``nonpositive_indicator``.
    """
    slots = high.groupBy(by, "block").agg(F.array_sort(F.collect_list(F.struct("date", F.col("indicator").cast("double").alias("indicator")))).alias("slots"))
    rows = low.join(slots, [by, "block"], "left")
    bad = F.exists("slots", lambda s: s["indicator"].isNull() | F.isnan(s["indicator"]))
    one = F.when(F.col("total").isNull() | F.isnan("total"), 1).when(F.col("slots").isNull() | (F.size("slots") != per) | bad, 3).when(F.col("total") <= 0, 2).when(F.exists("slots", lambda s: s["indicator"] <= 0), 4)
    first = F.min(one).over(Window.partitionBy(by))
    names = F.array(*[F.lit(n) for n in ("missing_total", "nonpositive_total", "missing_indicator", "nonpositive_indicator")])
    return rows.withColumn("reason", F.when(first.isNotNull(), F.get(names, first - 1)))


def proportional(ratios_of: np.ndarray, totals: np.ndarray, per: int) -> np.ndarray:
    """The path whose ratio to the indicator changes least from slot to slot and whose blocks sum to the totals.

    Ratios are least-squares under one constraint a block. Between blocks, the problem is solved
    through the covariance of a random walk, which is the inverse of the squared differences.
    """
    z = ratios_of.reshape(len(totals), per)
    whole = z.sum(1)
    n = z.size
    at = np.arange(n)
    walk = np.minimum.outer(at, at).astype(float)  # ratios less the first one
    meets = np.zeros((len(totals), n))
    for i, row in enumerate(z):
        meets[i, i * per : (i + 1) * per] = row
    spread = walk @ meets.T
    inner = meets @ spread
    system = np.block([[inner, whole[:, None]], [whole[None, :], np.zeros((1, 1))]])
    found = np.linalg.lstsq(system, np.concatenate([totals, [0.0]]), rcond=None)[0]
    return (spread @ found[:-1] + found[-1]) * z.ravel()


def _paths(rows: DataFrame, by: str, solve, extra: str = "") -> DataFrame:
    """(series, block, date, path, reason ..) from rows of ``blocks``; a task gets one row for each of a series' blocks."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{by}` {kinds[by]}, block {kinds['block']}, date date, path double, reason string{extra}"
    return rows.groupBy(by).applyInPandas(solve, schema)


def denton_proportional(low: DataFrame, high: DataFrame, per: int, by: str = "series") -> DataFrame:
    """(series, block, date, path, reason): totals spread in proportion to an indicator, with the ratio as even as can be.

    A series with a ``reason`` (see ``blocks``) is spread as if its indicator were constant;
    with ``missing_total`` or ``missing_indicator`` only over dates that exist, a block at a
    time, and the path is null where the total is.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block").reset_index(drop=True)
        reason = frame["reason"].iloc[0]
        slots = [list(s) if s is not None else [] for s in frame["slots"]]
        sizes = [len(s) for s in slots]
        totals = frame["total"].to_numpy(float)
        if reason in ("missing_total", "missing_indicator"):
            path = np.concatenate([np.full(k, t / k) for t, k in zip(totals, sizes) if k] or [np.zeros(0)])
        else:
            z = np.ones(sum(sizes)) if reason else np.array([s["indicator"] for b in slots for s in b])
            path = proportional(z, totals, per)
        dates = [s["date"] for b in slots for s in b]
        return pd.DataFrame({by: frame[by].iloc[0], "block": np.repeat(frame["block"].to_numpy(), sizes), "date": dates, "path": path, "reason": reason})

    return _paths(blocks(low, high, per, by), by, solve)


def _covariance(method: str, n: int, rho: float) -> np.ndarray:
    """Covariance of a high-frequency error, scaled to a mean variance of 1: autoregressive, or a walk of autoregressive steps."""
    at = np.arange(n)
    if method == "chow_lin":
        cov = rho ** np.abs(np.subtract.outer(at, at))
    else:
        lag = np.subtract.outer(at, at)
        steps = np.where(lag >= 0, (1 - rho ** (np.maximum(lag, 0) + 1.0)) / (1 - rho), 0)
        cov = steps @ steps.T
    return cov / np.mean(np.diag(cov))


def gls_fit(method: str, rho: float, totals: np.ndarray, indicator: np.ndarray, per: int, ridge: float = 1e-8) -> tuple[float, np.ndarray]:
    """(log likelihood up to a constant, path) of totals that are regressed on a constant and the indicator's sums."""
    n, q = indicator.size, len(totals)
    design = np.column_stack([np.ones(n), indicator])
    low = design.reshape(q, per, 2).sum(1)
    high = _covariance(method, n, rho)
    across = high.reshape(n, q, per).sum(2)
    cov = across.reshape(q, per, q).sum(1) + ridge * np.eye(q)
    weighed = np.linalg.solve(cov, low)
    beta = np.linalg.lstsq(low.T @ weighed, weighed.T @ totals, rcond=None)[0]
    left = totals - low @ beta
    solved = np.linalg.solve(cov, left)
    sign, size = np.linalg.slogdet(cov)
    score = -0.5 * (size + q * np.log(max(left @ solved, 1e-12) / q)) if sign > 0 else -np.inf
    return float(score), design @ beta + across @ solved


def gls_disagg(low: DataFrame, high: DataFrame, per: int, method: str, by: str = "series", least: int = 6) -> DataFrame:
    """(series, block, date, path, reason, rho): totals regressed on the indicator's sums, errors spread by the method's covariance.

    ``method``: ``chow_lin``, ``litterman`` or ``fernandez``. The autocorrelation is the likeliest
    of ``RHOS``, each of which is a task of its own; with fewer than ``least`` totals it is 0.5
    (chow_lin) or 0.7. Series without a total or an indicator value give no path but the reason.
    """
    rows = blocks(low, high, per, by)
    fit = rows.filter("reason is null or reason like 'nonpositive%'").withColumn("reason", F.lit(None).cast("string"))
    counts = fit.groupBy(by).agg(F.count("*").alias("__n"))
    tries = F.when(F.col("__n") < least, F.array(F.lit({"chow_lin": 0.5, "fernandez": 0.0}.get(method, 0.7)))).otherwise(F.array(*[F.lit(r) for r in RHOS[method]]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def arrays(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        frame = frame.sort_values("block").reset_index(drop=True)
        return frame, frame["total"].to_numpy(float), np.array([s["indicator"] for b in frame["slots"] for s in b])

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        frame, totals, z = arrays(frame)
        rho = float(frame["rho"].iloc[0])
        return pd.DataFrame({by: [frame[by].iloc[0]], "rho": rho, "score": gls_fit(method, rho, totals, z, per)[0]})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame, totals, z = arrays(frame)
        rho = float(frame["rho"].iloc[0])
        dates = [s["date"] for b in frame["slots"] for s in b]
        return pd.DataFrame({by: frame[by].iloc[0], "block": np.repeat(frame["block"].to_numpy(), per), "date": dates, "path": gls_fit(method, rho, totals, z, per)[1], "reason": None, "rho": rho})

    spread = fit.join(counts, by).withColumn("rho", F.explode(tries)).drop("__n")
    best = spread.groupBy(by, "rho").applyInPandas(score, f"`{by}` {kinds[by]}, rho double, score double").groupBy(by).agg(F.max_by("rho", F.struct(F.round("score", 9), -F.abs("rho"))).alias("rho"))
    paths = _paths(fit.join(best, by), by, solve, ", rho double")
    none = rows.filter("reason like 'missing%'").select(by, "block", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("path"), "reason", F.lit(None).cast("double").alias("rho"))
    return paths.unionByName(none)


def method_gates(diagnostics: DataFrame, rules: dict[str, dict[str, float]] = RULES, least: int = 8, base: str = "denton") -> DataFrame:
    """Adds ``gate`` to rows of (.., method, n, coverage, strength, rank, corr, ratio_share, ratio_cv, ratio_drift, outliers): ``pass`` or why not.

    ``few_rows``, ``unknown_method``, or the first measure that misses its bound, in the order
    of the rules. A missing measure misses; a measure that the table lacks isn't asked for.
    """
    gate = F.when(F.col("method") == base, "pass").when(F.col("n") < least, "few_rows").when(~F.col("method").isin(list(rules)), "unknown_method")
    for name in LOOSE:
        if name not in diagnostics.columns:
            continue
        bound = F.coalesce(*[F.when(F.col("method") == m, F.lit(float(r[name]))) for m, r in rules.items() if name in r])
        met = F.col(name) <= bound if name in UPPER else F.col(name) >= bound
        gate = gate.when(bound.isNotNull() & ~F.coalesce(met, F.lit(False)), name)
    return diagnostics.withColumn("gate", gate.otherwise("pass"))


def holdout_scores(quarters: DataFrame, holds: int = 4, by: str = "series", at: str = "block") -> DataFrame:
    """(series, method, held, rmse): one-step errors of the last ``holds`` totals, from what comes before each.

    quarters: (series, block, total, indicator). ``denton`` keeps the last total,
    ``denton_proportional`` its ratio to the indicator, ``chow_lin`` regresses levels,
    ``fernandez`` (and ``litterman``) adds the slope of changes on changes. Fits before each
    total are sums of a running window; at least three totals come before the first one.
    """
    w = Window.partitionBy(by).orderBy(at)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = quarters.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(by)), "__dt": F.col("total") - F.lag("total").over(w), "__dz": F.col("indicator") - F.lag("indicator").over(w), "__t1": F.lag("total").over(w), "__z1": F.lag("indicator").over(w)})
    var, cov = F.var_pop("indicator").over(past), F.covar_pop("total", "indicator").over(past)
    slope = F.when(var > 1e-12, cov / F.when(var > 1e-12, var))
    moves = F.sum(F.col("__dz") * F.col("__dz")).over(past)
    step = F.when(moves > 1e-12, F.sum(F.col("__dt") * F.col("__dz")).over(past) / F.when(moves > 1e-12, moves))
    guess = {
        "denton": F.col("__t1"),
        "denton_proportional": F.col("__t1") * F.try_divide("indicator", "__z1"),
        "chow_lin": F.avg("total").over(past) + slope * (F.col("indicator") - F.avg("indicator").over(past)),
        "fernandez": F.col("__t1") + step * F.col("__dz"),
        "litterman": F.col("__t1") + step * F.col("__dz"),
    }
    guessed = rows.withColumns({f"__g_{m}": g for m, g in guess.items()}).filter((F.col("__i") > F.col("__n") - holds) & (F.col("__i") > 3))
    long = guessed.select(by, "total", "__t1", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"__g_{m}").alias("guess")) for m in guess])).alias("x")).select(by, "total", "__t1", "x.*")
    error = F.col("total") - F.coalesce("guess", "__t1")
    return long.groupBy(by, "method").agg(F.count("*").alias("held"), F.sqrt(F.avg(error * error)).alias("rmse"))


def select_method(gated: DataFrame, by: str = "series", score: str = "rmse", least_gain: float = 0.02, base: str = "denton") -> DataFrame:
    """(series, method, score, base_score, gain, outcome): the method of least score that passes its gate, if it gains ``least_gain`` on the base.

    ``outcome``: ``selected``, ``base_kept`` (too little gain) or ``base_only`` (nothing else passed).
    """
    order = F.struct(F.round(score, 9), "method")
    held = gated.filter((F.col("gate") == "pass") & F.col(score).isNotNull())
    best = held.groupBy(by).agg(F.min_by(F.when(F.col("method") != base, F.struct("method", score)), F.when(F.col("method") != base, order)).alias("best"), F.min(F.when(F.col("method") == base, F.col(score))).alias("base_score"))
    gain = F.when(F.col("base_score") > 1e-12, 1 - F.col(f"best.{score}") / F.col("base_score"))
    out = best.withColumn("gain", gain).withColumn("outcome", F.when(F.col("best").isNull(), "base_only").when(F.coalesce(F.col("gain") >= least_gain, F.col("base_score").isNull()), "selected").otherwise("base_kept"))
    chosen = F.col("outcome") == "selected"
    return out.select(by, F.when(chosen, F.col("best.method")).otherwise(base).alias("method"), F.when(chosen, F.col(f"best.{score}")).otherwise(F.col("base_score")).alias("score"), "base_score", "gain", "outcome")


def choose_path(quarters: DataFrame, spread: DataFrame, overrides: DataFrame | None = None, least: int = 8, coverage: float = 0.8, least_var: float = 1e-8, least_corr: float = 0.3, least_r2: float = 0.1, alpha: float = 0.05, by: str = "series", at: str = "block") -> DataFrame:
    """(series, n, coverage, corr, r2, q, p, reason, path): whether a series' path may follow its indicator (``primary``) or not (``secondary``).

    quarters: (series, block, total, indicator), nulls where one is missing. spread: (series,
    variance) of the indicator. ``reason`` is the first thing that speaks against it:
    ``flat_indicator``, ``few_rows``, ``coverage``, ``corr``, ``r2`` or ``residuals``, where the
    Ljung-Box statistic of four autocorrelations of what the indicator leaves has p below
    ``alpha``. overrides: (series, path) that hold whatever the figures say.
    """
    both = quarters.filter("total is not null and indicator is not null")
    fit = both.groupBy(by).agg(F.count("*").alias("n"), corr("total", "indicator").alias("corr"), F.regr_slope("total", "indicator").alias("__b"), F.avg("total").alias("__mt"), F.avg("indicator").alias("__mi"))
    left = both.join(fit, by).withColumn("__e", F.col("total") - F.col("__mt") - F.col("__b") * (F.col("indicator") - F.col("__mi")))
    w = Window.partitionBy(by).orderBy(at)
    lags = left.withColumns({f"__p{k}": F.col("__e") * F.lag("__e", k).over(w) for k in range(1, 5)})
    sums = lags.groupBy(by).agg(F.sum(F.col("__e") * F.col("__e")).alias("__ee"), *[F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)).alias(f"__s{k}") for k in range(1, 5)])
    whole = quarters.groupBy(by).agg(F.count("total").alias("__totals"))
    out = whole.join(fit, by, "left").join(sums, by, "left").join(spread.select(by, "variance"), by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n")
    still = F.coalesce(F.col("__ee") < 1e-12 * F.greatest(n - 1, F.lit(1)), F.lit(True))
    q = sum((F.pow(F.col(f"__s{k}") / F.when(~still, F.col("__ee")), F.lit(2)) / F.when(n > k, n - k) for k in range(2, 5)), F.pow(F.col("__s1") / F.when(~still, F.col("__ee")), F.lit(2)) / F.when(n > 1, n - 1))
    out = out.withColumns({"coverage": F.try_divide("n", "__totals"), "r2": F.col("corr") * F.col("corr"), "q": n * (n + 2) * q})
    out = out.withColumn("p", F.exp(-F.col("q") / 2) * (1 + F.col("q") / 2))  # of chi-squared with four degrees

    def missed(c: str, bound: float):
        return F.coalesce(F.abs(c) < bound, F.lit(True))

    reason = F.when(missed("variance", least_var), "flat_indicator").when(n < least, "few_rows").when(missed("coverage", coverage), "coverage").when(missed("corr", least_corr), "corr").when(missed("r2", least_r2), "r2").when(F.col("p") < alpha, "residuals")
    out = out.withColumn("reason", reason).withColumn("path", F.when(F.col("reason").isNull(), "primary").otherwise("secondary"))
    if overrides is not None:
        asked = overrides.select(by, F.col("path").alias("__path"))
        out = out.join(asked, by, "left").withColumns({"reason": F.when(F.col("__path").isNotNull(), "override").otherwise(F.col("reason")), "path": F.coalesce("__path", "path")})
    return out.select(by, "n", "coverage", "corr", "r2", "q", "p", "reason", "path")
