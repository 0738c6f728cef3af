"""Evidence of driver-target pairs: a small vector autoregression in every window, the choice of a window's model, and scores over windows of both kinds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import chi2_p, normal_p
from macrotide.operators.screening import rolling_cointegration


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1 of each row's values, ties sharing their mean rank."""
    below = (values[:, None, :] < values[:, :, None]).sum(2)
    same = (values[:, None, :] == values[:, :, None]).sum(2)
    return below + (same + 1) / 2


def _row_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(size > 1e-12, (a * b).sum(1) / np.where(size > 0, size, 1), np.nan)


def _lagged(y: np.ndarray, x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows (rows of y and x): regressors (1, y and x one row before, ..) and targets (y, x), from row ``skip`` on."""
    width = y.shape[1]
    before = [v[:, skip - k : width - k] for k in range(1, lags + 1) for v in (y, x)]
    return np.stack([np.ones_like(y[:, skip:]), *before], 2), np.stack([y[:, skip:], x[:, skip:]], 2)


def _least_squares(z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, inverse of Z'Z, residuals) of every window; NaN where regressors are collinear."""
    inner = np.swapaxes(z, 1, 2) @ z
    size = np.sqrt(np.einsum("nii->ni", inner))
    scaled = inner / np.maximum(size[:, :, None] * size[:, None, :], 1e-300)
    bad = ~(np.linalg.cond(scaled) < 1e12)
    scaled[bad] = np.eye(z.shape[2])
    inverse = np.linalg.inv(scaled) / np.maximum(size[:, :, None] * size[:, None, :], 1e-300)
    inverse[bad] = np.nan
    b = inverse @ (np.swapaxes(z, 1, 2) @ t)
    return b, inverse, t - z @ b


def lag_order(y: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Lags of every window by Akaike's criterion over 0 to ``most``, all judged on the same rows; where none is best, 2 at most are taken."""
    size = y.shape[1] - most
    found = []
    for p in range(most + 1):
        _, _, left = _least_squares(*_lagged(y, x, p, most))
        cross = np.swapaxes(left, 1, 2) @ left / size
        with np.errstate(divide="ignore", invalid="ignore"):
            found.append(np.log(np.linalg.det(cross)) + 2 / size * (4 * p + 2))
    found = np.stack(found, 1)
    best = np.argmin(np.where(np.isnan(found), np.inf, found), 1)
    return np.where(best > 0, best, min(most, 2))


def autoregression(y: np.ndarray, x: np.ndarray, lags: int) -> dict[str, np.ndarray]:
    """Both directions of a two-variable autoregression of every window (rows of y, the target, and x, the driver).

    coef: the sum of the source's lag slopes; se: its error, from the slopes' covariance; wald:
    that all of them are zero; std and std_se: in standard deviations of the window.
    """
    z, t = _lagged(y, x, lags, lags)
    b, inverse, left = _least_squares(z, t)
    free = z.shape[1] - z.shape[2]
    out = {"residual_corr": _row_correlation(left[:, :, 0], left[:, :, 1])}
    spread = [np.where(s > 0, s, 1.0) for s in (y.std(1, ddof=1), x.std(1, ddof=1))]
    for name, target, source in (("driver_to_target", 0, 1), ("target_to_driver", 1, 0)):
        at = [1 + 2 * k + source for k in range(lags)]
        slopes = b[:, at, target]
        sigma = (left[:, :, target] ** 2).sum(1) / max(free, 1)
        cov = inverse[:, at][:, :, at] * sigma[:, None, None]
        held = np.isfinite(cov).all((1, 2)) & (sigma > 1e-12 * spread[target] ** 2)
        safe = np.where(held[:, None, None], cov, np.eye(lags))
        wald = np.where(held, np.einsum("ni,nij,nj->n", slopes, np.linalg.inv(safe), slopes), np.nan)
        coef, se = slopes.sum(1), np.sqrt(np.where(held, cov.sum((1, 2)), np.nan))
        scale = spread[source] / spread[target]
        out |= {f"{name}_{k}": v for k, v in (("coef", coef), ("se", se), ("wald", wald), ("std", coef * scale), ("std_se", se * scale))}
    return out


def pair_windows(panel: DataFrame, pairs: DataFrame, width: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(driver, target, date, x: array, y: array): every whole window of ``width`` rows that both series have. pairs: (driver, target)."""
    held = panel.filter(F.col(x).isNotNull())
    target, driver = (held.select(F.col(by).alias(side), at, F.col(x).cast("double").alias(v)) for side, v in (("target", "y"), ("driver", "x")))
    rows = pairs.join(target, "target").join(driver, ["driver", at])
    w = Window.partitionBy("driver", "target").orderBy(at).rowsBetween(1 - width, 0)
    rows = rows.withColumns({"n": F.count("*").over(w), "xs": F.collect_list("x").over(w), "ys": F.collect_list("y").over(w)})
    return rows.filter(F.col("n") == width).select("driver", "target", at, F.col("xs").alias("x"), F.col("ys").alias("y"))


def driver_response(panel: DataFrame, pairs: DataFrame, width: int, max_lags: int = 2, choose: bool = True, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Both directions' responses of every pair in every whole window of ``width`` rows.

    pairs: (driver, target). Columns: lags (by ``lag_order``, or ``max_lags`` where ``choose`` is
    false), residual_corr, spearman (rank correlation of the window's values), and for
    driver_to_target and target_to_driver: coef, se, p (Wald, chi-square), std, std_se. Nulls are
    left out before windows are cut. A window whose regressors are collinear has nulls for all
    but spearman; without variation that is null too.
    """
    sides = [f"{d}_{k}" for d in ("driver_to_target", "target_to_driver") for k in ("coef", "se", "wald", "std", "std_se")]
    names = ["residual_corr", *sides]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[["driver", "target", at]].reset_index(drop=True)
            if not len(frame):
                continue
            v, y = np.stack(frame["x"]), np.stack(frame["y"])
            lags = lag_order(y, v, max_lags) if choose else np.full(len(frame), max_lags)
            found = pd.DataFrame(np.nan, out.index, names)
            for p in np.unique(lags):
                own = np.flatnonzero(lags == p)
                found.iloc[own] = np.stack([autoregression(y[own], v[own], int(p))[c] for c in names], 1)
            yield pd.concat([out, pd.DataFrame({"lags": lags.astype("int64"), "spearman": _row_correlation(average_ranks(v), average_ranks(y))}), found], axis=1)

    windows = pair_windows(panel, pairs, width, by, at, x)
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("driver", "target", at)) + ", lags long, spearman double" + "".join(f", {c} double" for c in names)
    out = windows.mapInPandas(run, schema)
    out = out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    for d in ("driver_to_target", "target_to_driver"):
        out = out.withColumn(f"{d}_p", chi2_p(F.col(f"{d}_wald"), F.col("lags"))).drop(f"{d}_wald")
    return out


def model_windows(levels: DataFrame, moves: DataFrame, pairs: DataFrame, width: int, max_lags: int = 2, choose: bool = True, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(driver, target, date, model, r, p, t, beta, alpha): one row for each pair and date that has a whole window of either kind.

    A window of ``levels`` in which the two are cointegrated is a VECM row: beta is the target's
    slope on the driver, alpha the speed at which the target closes the gap, t and p (normal)
    are alpha's. Any other window is a VAR row from ``moves`` (``driver_response``): r is the
    correlation of residuals, t its t statistic and p the driver's Wald p. pairs: (driver, target).
    """
    key = ["driver", "target", at]
    steady = rolling_cointegration(levels, pairs, width, by, at, x).select(*key, F.col("t").alias("gap_t"), F.col("beta").alias("gap_beta"), F.col("speed").alias("gap_speed"), "regime")
    found = driver_response(moves, pairs, width, max_lags, choose, by, at, x).select(*key, "lags", "residual_corr", F.col("driver_to_target_p").alias("lag_p"))
    tied, r = F.col("regime").eqNullSafe("cointegrated"), F.col("residual_corr")
    t = F.when(F.abs(r) < 1, r * F.sqrt((width - 2 - F.col("lags")) / (1 - r * r)))
    both = found.join(steady, key, "full").filter(tied | F.col("lags").isNotNull())  # a filter of regimes alone would be pushed into the window sums and multiply them
    vecm, var = (lambda c: F.when(tied, c)), (lambda c: F.when(~tied, c))
    return both.select(
        *key, F.when(tied, "VECM").otherwise("VAR").alias("model"), var(r).alias("r"), F.when(tied, normal_p(F.col("gap_t"))).otherwise(F.col("lag_p")).alias("p"),
        F.when(tied, F.col("gap_t")).otherwise(t).alias("t"), vecm(F.col("gap_beta")).alias("beta"), vecm(F.col("gap_speed")).alias("alpha"),
    )


def _gates(significance: str, alpha: float, most_t: float, keys: list[str]) -> Column:
    """Whether a window is significant, by p, by |t| or by either; by |t| in a group that has no p at all."""
    by_p, by_t = F.coalesce(F.col("p") <= alpha, F.lit(False)), F.coalesce(F.abs("t") > most_t, F.lit(False))
    if significance == "t":
        return by_t
    if significance == "either":
        return by_p | by_t
    return F.when(F.count("p").over(Window.partitionBy(*keys)) > 0, by_p).otherwise(by_t)


def weighed(windows: DataFrame, keys: list[str], alpha: float = 0.05, most_t: float = 1.28, q: str | None = None) -> DataFrame:
    """Adds ``weight``, 0 .. 1: how far a window's q (else p) lies below ``alpha``; in a group without either, how far |t| lies beyond ``most_t``."""
    w = Window.partitionBy(*keys)
    value = F.col("p") if q is None else F.when(F.count(q).over(w) > 0, F.coalesce(q, "p")).otherwise(F.col("p"))
    held = windows.withColumn("__e", value).withColumn("__e", F.when((F.col("__e") >= 0) & (F.col("__e") <= 1), F.col("__e")))
    clipped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    by_p = clipped(1 - F.col("__e") / alpha) if alpha > 0 else F.lit(None).cast("double")
    by_t = clipped((F.abs("t") - most_t) / most_t)
    has = (F.count("__e").over(w) > 0) & F.lit(alpha > 0)
    return held.withColumn("weight", F.coalesce(F.when(has, by_p).otherwise(by_t), F.lit(0.0))).drop("__e")


def directional_scores(windows: DataFrame, keys: list[str], alpha: float = 0.05, most_t: float = 1.28, weights: tuple[float, float] = (0.7, 0.3), prior: float = 12.0, beta_scale: float | None = None, significance: str = "p", q: str | None = None) -> DataFrame:
    """(*keys, direction, n, var_coverage, var_strength, vecm_coverage, vecm_strength, n_eff, beta_scale, score) of windows by ``model_windows``.

    Two rows, positive and negative, for each group. A VAR window counts for the sign of r, with
    effect min(|r|, 1); a VECM window for the sign of beta if alpha < 0, with effect
    tanh(|beta| / scale), where the scale is the group's median |beta| over its VECM windows (their
    mean where that is 0; at least 0.001; 1 without any). Coverage is the weight (``weighed``) of a
    kind's significant windows over the number of its windows, strength their weighted mean
    effect, and the score 100 times the two products, weighted by ``weights``, times
    n_eff / (n_eff + prior) with n_eff the weight of both kinds.
    """
    rows = weighed(windows, keys, alpha, most_t, q).withColumn("__gate", _gates(significance, alpha, most_t, keys))
    vecm = F.when(F.col("model") == "VECM", F.abs("beta"))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({"__mid": F.percentile(vecm, F.lit(0.5)).over(whole), "__mean": F.avg(vecm).over(whole)})
    found = F.when(F.col("__mid") > 0, F.col("__mid")).when(F.col("__mean") > 0, F.col("__mean")).otherwise(F.lit(1.0))
    rows = rows.withColumn("beta_scale", F.greatest(found, F.lit(1e-3)) if beta_scale is None else F.lit(float(beta_scale)))
    effect = F.when(F.col("model") == "VAR", F.least(F.abs("r"), F.lit(1.0))).otherwise(F.tanh(F.abs("beta") / F.greatest(F.col("beta_scale"), F.lit(1e-3))))
    sign = F.when(F.col("model") == "VAR", F.signum("r")).when(F.col("alpha") < 0, F.signum("beta"))
    rows = rows.withColumns({"__effect": effect, "__sign": F.when(F.col("__gate"), sign)})
    sums = [F.count("*").alias("n"), F.first("beta_scale").alias("beta_scale")]
    for model in ("var", "vecm"):
        own = F.col("model") == model.upper()
        sums.append(F.sum(own.cast("int")).alias(f"n_{model}"))
        for name, s in (("positive", 1), ("negative", -1)):
            held = own & (F.col("__sign") == s)
            sums += [F.sum(F.when(held, F.col("weight")).otherwise(0.0)).alias(f"w_{model}_{name}"), F.sum(F.when(held, F.col("weight") * F.col("__effect")).otherwise(0.0)).alias(f"e_{model}_{name}")]
    out = rows.groupBy(*keys).agg(*sums)
    out = out.withColumn("direction", F.explode(F.array(F.lit("positive"), F.lit("negative"))))
    side = lambda c: F.when(F.col("direction") == "positive", F.col(f"{c}_positive")).otherwise(F.col(f"{c}_negative"))
    for model in ("var", "vecm"):
        out = out.withColumn(f"{model}_coverage", F.least(F.lit(1.0), F.coalesce(F.try_divide(side(f"w_{model}"), F.col(f"n_{model}")), F.lit(0.0))))
        out = out.withColumn(f"{model}_strength", F.coalesce(F.try_divide(side(f"e_{model}"), side(f"w_{model}")), F.lit(0.0)))
    out = out.withColumn("n_eff", side("w_var") + side("w_vecm"))
    share = [w / sum(weights) for w in weights]
    raw = share[0] * F.col("var_coverage") * F.col("var_strength") + share[1] * F.col("vecm_coverage") * F.col("vecm_strength")
    reliability = F.coalesce(F.try_divide(F.col("n_eff"), F.col("n_eff") + prior), F.lit(0.0)) if prior > 0 else F.lit(1.0)
    kept = ["var_coverage", "var_strength", "vecm_coverage", "vecm_strength", "n_eff", "beta_scale"]
    return out.select(*keys, "direction", "n", *kept, (100 * raw * reliability).alias("score"))


def legacy_directional_scores(windows: DataFrame, keys: list[str], alpha: float = 0.05, most_t: float = 1.28, weights: tuple[float, float] = (0.7, 0.3), significance: str = "p") -> DataFrame:
    """(*keys, direction, n, score): 100 times the weighted share of significant windows of the sign, each kind's times its median |r| or |beta|; shares are of all windows."""
    rows = windows.withColumn("__gate", _gates(significance, alpha, most_t, keys))
    own = {"var": F.col("model") == "VAR", "vecm": (F.col("model") == "VECM") & (F.col("alpha") < 0)}
    value = {"var": "r", "vecm": "beta"}
    parts = []
    for name, s in (("positive", 1), ("negative", -1)):
        for (model, held), w in zip(own.items(), weights):
            hit = held & F.col("__gate") & (F.col(value[model]) * s > 0)
            size = F.percentile(F.when(hit, F.abs(value[model])), F.lit(0.5))
            parts.append((100 * w / sum(weights) * F.count_if(hit) / F.count("*") * F.coalesce(size, F.lit(0.0))).alias(f"{model}_{name}"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *parts)
    sides = [F.struct(F.lit(d).alias("direction"), (F.col(f"var_{d}") + F.col(f"vecm_{d}")).alias("score")) for d in ("positive", "negative")]
    return out.select(*keys, "n", F.explode(F.array(*sides)).alias("s")).select(*keys, "s.direction", "n", "s.score")


def independence_scores(windows: DataFrame, keys: list[str], alpha: float = 0.05, prior: float = 12.0) -> DataFrame:
    """(*keys, n, score, legacy): how little the windows of a group are related.

    score: 100 times the median of 1 - |r| over VAR windows, the share of them with p above
    ``alpha`` (missing p counts as not above; all of them if ``alpha`` is 0), the share of
    windows that are not VECM, and m / (m + prior) with m the VAR windows that have an r; 0
    without any. legacy: 100 / (1e-6 + mean |t| of the VAR windows) / (1 + VECM windows / 10), 0
    without a VAR window that has a t.
    """
    var = F.col("model") == "VAR"
    apart = F.percentile(F.when(var, 1 - F.least(F.abs("r"), F.lit(1.0))), F.lit(0.5))
    quiet = F.avg(F.when(var, F.coalesce(F.col("p") > alpha, F.lit(False)).cast("int"))) if alpha > 0 else F.lit(1.0)
    m, tied = F.count(F.when(var, F.col("r"))), F.count_if(F.col("model") == "VECM")
    reliability = m / (m + prior) if prior > 0 else F.lit(1.0)
    score = 100 * apart * quiet * (1 - tied / F.count("*")) * reliability
    legacy = 100 / (1e-6 + F.avg(F.when(var, F.abs("t")))) / (1 + tied / 10)
    return windows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(legacy, F.lit(0.0)).alias("legacy"))


def regime_of(at: Column, breaks: list[str], labels: list[str] | None = None) -> Column:
    """The regime of a date: a new one begins on each break (ISO dates, in order); names are taken from ``labels``, then regime_<n>."""
    names = [*(labels or []), *[f"regime_{k + 1}" for k in range(len(labels or []), len(breaks) + 1)]]
    out = F.lit(names[0])
    for day, name in zip(breaks, names[1:]):
        out = F.when(at >= F.lit(day).cast("date"), name).otherwise(out)
    return out


def regime_scores(windows: DataFrame, keys: list[str], breaks: list[str], labels: list[str] | None = None, weights: list[float] | None = None, combine: str = "share", min_windows: int = 1, min_share: float = 0.0, at: str = "date", **options) -> DataFrame:
    """(*keys, direction, score, regimes, dominant, dominant_share): directional scores of each regime of dates, combined.

    Regimes with fewer than ``min_windows`` windows, or a smaller share of the group's than ``min_share``, do not
    count. combine: min, mean, weight (``weights`` of the regimes that count, scaled to 1) or share (each times its share
    of windows, over 1 or their sum if that is more). A group with one regime or none that counts has the score of
    all its windows, ``regimes`` 0 and no dominant one; else that is the one with the largest share.
    """
    names = [*(labels or []), *[f"regime_{k + 1}" for k in range(len(labels or []), len(breaks) + 1)]][: len(breaks) + 1]
    rows = windows.withColumn("regime", regime_of(F.col(at), breaks, labels))
    total = windows.groupBy(*keys).agg(F.count("*").alias("__total"))
    parts = directional_scores(rows, [*keys, "regime"], **options).join(total, keys).withColumn("share", F.col("n") / F.col("__total"))
    parts = parts.filter((F.col("n") >= min_windows) & (F.col("share") >= min_share))
    given = dict(zip(names, weights or [1.0] * len(names)))
    w = F.lit(0.0)
    for name in names:
        w = F.when(F.col("regime") == name, F.lit(float(max(0.0, given.get(name, 1.0))))).otherwise(w)
    found = {
        "min": F.min("score"),
        "mean": F.avg("score"),
        "weight": F.coalesce(F.try_divide(F.sum(F.col("score") * w), F.sum(w)), F.avg("score")),
        "share": F.sum(F.col("score") * F.col("share")) / F.greatest(F.lit(1.0), F.sum("share")),
    }[combine]
    # of equal shares the first regime by name dominates
    top = F.min_by(F.struct("regime", "share"), F.struct(-F.col("share"), "regime"))
    combined = parts.groupBy(*keys, "direction").agg(F.count("*").alias("__k"), found.alias("__score"), top.alias("__top")).filter("__k > 1")
    whole = directional_scores(windows, keys, **options).select(*keys, "direction", "score")
    both = whole.join(combined, [*keys, "direction"], "left")
    return both.select(*keys, "direction", F.coalesce("__score", "score").alias("score"), F.coalesce("__k", F.lit(0)).alias("regimes"), F.col("__top.regime").alias("dominant"), F.col("__top.share").alias("dominant_share"))


def flipped(windows: DataFrame, sign: Column | int = -1) -> DataFrame:
    """Windows with the signs of r and beta changed."""
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    return windows.withColumns({"r": F.col("r") * sign, "beta": F.col("beta") * sign})


def placebo_flip(windows: DataFrame, target: str, candidate: str, **options) -> DataFrame:
    """(target, direction, candidates, top, placebo_top, top_match, top_score, placebo_top_score, delta, ratio, score_corr): scores of all candidates against those of windows with every sign turned over."""
    keys = [target, candidate]
    base = directional_scores(windows, keys, **options).select(*keys, "direction", "score")
    other = directional_scores(flipped(windows), keys, **options).select(*keys, "direction", F.col("score").alias("placebo"))
    both = base.join(other, [*keys, "direction"])
    best = lambda c: F.min_by(F.struct(F.col(candidate).alias("name"), F.col(c).alias("score")), F.struct(-F.round(c, 9), candidate))
    spread = F.stddev_pop("score") * F.stddev_pop("placebo")
    out = both.groupBy(target, "direction").agg(F.count("*").alias("candidates"), best("score").alias("a"), best("placebo").alias("b"), (F.covar_pop("score", "placebo") / F.nullif(spread, F.lit(0.0))).alias("score_corr"))
    delta = F.col("b.score") - F.col("a.score")
    return out.select(target, "direction", "candidates", F.col("a.name").alias("top"), F.col("b.name").alias("placebo_top"), (F.col("a.name") == F.col("b.name")).alias("top_match"), F.col("a.score").alias("top_score"), F.col("b.score").alias("placebo_top_score"), delta.alias("delta"), F.try_divide(delta, F.abs("a.score")).alias("ratio"), "score_corr")


def sign_randomization(windows: DataFrame, keys: list[str], draws: int = 300, at: str = "date", seed: str = "placebo", **options) -> DataFrame:
    """(*keys, direction, score, draws, empirical_p): the share of draws, one added, in which windows with random signs score as high or higher.

    The sign of a window is a bit of the MD5 of seed, keys, date and draw, the same in every run.
    """
    base = directional_scores(windows, keys, **options).select(*keys, "direction", "score")
    rows = windows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    bit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys], F.col(at).cast("string"), F.col("draw").cast("string"))), 1, 4), 16, 10).cast("int") % 2
    null = directional_scores(flipped(rows, F.when(bit == 0, 1).otherwise(-1)), [*keys, "draw"], **options).select(*keys, "direction", F.col("score").alias("null"))
    held = null.join(base, [*keys, "direction"])
    return held.groupBy(*keys, "direction").agg(F.first("score").alias("score"), F.count("*").alias("draws"), ((1 + F.count_if(F.col("null") >= F.col("score") - 1e-9)) / (1 + F.count("*"))).alias("empirical_p"))
