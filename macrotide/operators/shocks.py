"""Shocks as what controls leave of a series: elastic nets from fold moments, retry grids, and control domains."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.operators.controls import _moments, partial_out
from macrotide.operators.regression import hac_slope

#: Penalties of a path, as shares of the least one that leaves no control.
PATH = tuple(10 ** (-3 * k / 19) for k in range(20))


def median_filled(df: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """Missing xs replaced by their median in the group, and by 0 where a group has none."""
    medians = df.groupBy(*by).agg(*[F.percentile(x, F.lit(0.5)).alias(f"__m_{x}") for x in xs])
    return df.join(medians, by).withColumns({x: F.coalesce(x, f"__m_{x}", F.lit(0.0)) for x in xs}).drop(*[f"__m_{x}" for x in xs])


def net(r: np.ndarray, c: np.ndarray, l1_ratio: float, penalty: float, start: np.ndarray, rounds: int, enough: float = 1e-9) -> tuple[np.ndarray, bool]:
    """(slopes, converged) that minimise b'Rb / 2 - c'b + penalty (l1 |b|_1 + (1 - l1) b'b / 2), one slope at a time."""
    b = start.copy()
    for _ in range(rounds):
        before = b.copy()
        for j in range(len(c)):
            pull = c[j] - r[j] @ b + r[j, j] * b[j]
            b[j] = np.sign(pull) * max(abs(pull) - penalty * l1_ratio, 0) / (r[j, j] + penalty * (1 - l1_ratio))
        if np.max(np.abs(b - before)) <= enough:
            return b, True
    return b, False


def _scaled(s: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, means, deviations, correlations of the controls (0 for a constant one) and their covariances with d by deviation."""
    n = s[0, 0]
    means = s[0, 1:] / n
    cov = s[1:, 1:] / n - np.outer(means, means)
    size = np.sqrt(np.maximum(np.diag(cov), 0))
    size[size < 1e-10] = 0
    inverse = np.divide(1, size, out=np.zeros_like(size), where=size > 0)[:p]
    r = cov[:p, :p] * np.outer(inverse, inverse)
    np.fill_diagonal(r, 1)
    return n, means, inverse, r, cov[:p, p] * inverse


def _net_fit(folds: np.ndarray, l1_ratio: float, rounds: int, most: int | None) -> tuple[np.ndarray, float, float, bool]:
    """(intercept and slopes, penalty, share explained, converged) from the moments of (1, controls, d) of each fold.

    The penalty is the one of the path with the least squared error in the folds left out.
    """
    whole = folds.sum(0)
    p = whole.shape[0] - 2
    _, _, _, _, c = _scaled(whole, p)
    used = np.sort(np.argsort(-np.abs(c), kind="stable")[: most or p])  # all of them, unless a number is given
    keep = np.concatenate([[0], 1 + used, [p + 1]])
    whole, folds, k = whole[np.ix_(keep, keep)], folds[:, keep][:, :, keep], len(used)

    def path(s: np.ndarray, penalties: np.ndarray) -> tuple[list[np.ndarray], bool]:
        n, means, inverse, r, c = _scaled(s, k)
        b, out, converged = np.zeros(k), [], True
        for penalty in penalties:
            b, done = net(r, c, l1_ratio, penalty, b, rounds)
            converged &= done
            slopes = b * inverse
            out.append(np.concatenate([[means[k] - slopes @ means[:k]], slopes]))
        return out, converged

    def error(s: np.ndarray, b: np.ndarray) -> float:
        full = np.concatenate([-b, [1]])
        return float(full @ s @ full)

    most_pull = np.max(np.abs(_scaled(whole, k)[4])) / max(l1_ratio, 1e-3)
    penalties = most_pull * np.array(PATH)
    errors = np.zeros(len(penalties))
    converged = True
    held = [f for f in range(len(folds)) if 0 < folds[f][0, 0] < whole[0, 0]]
    for f in held:
        fits, done = path(whole - folds[f], penalties)
        converged &= done
        errors += [error(folds[f], b) for b in fits]
    best = int(np.argmin(errors)) if held else len(penalties) - 1
    fits, done = path(whole, penalties[: best + 1])
    total = whole[k + 1, k + 1] - whole[0, k + 1] ** 2 / whole[0, 0]
    b = np.zeros(p + 1)
    b[np.concatenate([[0], 1 + used])] = fits[-1]
    explained = 1 - error(whole, fits[-1]) / total if total > 1e-12 else np.nan
    return b, float(penalties[best]), float(explained), bool(converged and done)


def shock_fits(df: DataFrame, by: list[str], d: str, xs: list[str], fold: str, attempts: list[dict], least: int = 10) -> DataFrame:
    """(*by, attempt, n, model, penalty, r2, resid_var, converged, b: array): an elastic net of d on xs for each group and attempt.

    attempts: dicts of ``l1_ratio``, ``rounds`` and ``most`` (controls, by |correlation| with d;
    None for all), in the order of trial. Rows must have no null in xs; those without d or fold
    don't count. With fewer than ``least`` rows, d's mean is the fit (``mean_only_low_n``). A
    group's task gets one row of sums for each fold, however many rows the group has.
    """
    sums, places = _moments(df.dropna(subset=[d, fold]), [*by, fold], [*xs, d])
    p, width = len(xs), len(xs) + 2
    grid = sums.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(len(attempts) - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    columns = [*by, "attempt", "n", "model", "penalty", "r2", "resid_var", "converged", "b"]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        folds = np.zeros((len(frame), width, width))
        for k, (i, j) in enumerate(places):
            folds[:, i, j] = folds[:, j, i] = frame[f"m{k}"]
        whole, attempt = folds.sum(0), int(frame["attempt"].iloc[0])
        n = whole[0, 0]
        mean = whole[0, -1] / n
        spread = whole[-1, -1] / n - mean**2
        if n < least or not p:
            b, found = np.concatenate([[mean], np.zeros(p)]), ("mean_only_low_n" if p else "mean_only", None, 0.0, spread, True)
        else:
            asked = attempts[attempt]
            b, penalty, r2, converged = _net_fit(folds, asked["l1_ratio"], asked["rounds"], asked.get("most"))
            found = ("elastic_net", penalty, r2, spread * (1 - r2) if np.isfinite(r2) else spread, converged)
        return pd.DataFrame([[*frame[by].iloc[0], attempt, int(n), *found, b.tolist()]], columns=columns)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", attempt int, n long, model string, penalty double, r2 double, resid_var double, converged boolean, b array<double>"
    return grid.groupBy(*by, "attempt").applyInPandas(fit, schema)


def best_attempt(fits: DataFrame, by: list[str], least_r2: float = -0.05) -> DataFrame:
    """The first attempt of each group that passes (converged, a net, r2 of at least ``least_r2``), else the best one: adds ``passed``.

    Attempts that don't pass go by convergence, model, r2 and variance left, in this order.
    """
    weak = F.coalesce(F.nanvl("r2", F.lit(-1e6)), F.lit(-1e6))
    no_net, low = F.col("model") != "elastic_net", weak < least_r2
    passed = F.col("converged") & ~no_net & ~low
    order = F.struct((~passed).cast("int").alias("a"), F.when(passed, 0).otherwise((~F.col("converged")).cast("int")).alias("b"), F.when(passed, 0).otherwise(no_net.cast("int")).alias("c"), F.when(passed, 0.0).otherwise(-weak).alias("e"), F.when(passed, 0.0).otherwise(F.col("resid_var")).alias("f"), F.col("attempt").alias("g"))
    rest = [c for c in fits.columns if c not in by]
    return fits.withColumn("passed", passed).groupBy(*by).agg(F.min_by(F.struct(*rest, "passed"), order).alias("best")).select(*by, "best.*")


def shock_residual(df: DataFrame, by: list[str], d: str, fits: DataFrame, xs: list[str]) -> DataFrame:
    """Rows with ``shock``: d less the group's fit (``shock_fits`` of one attempt, or ``best_attempt``)."""
    fit = reduce(lambda a, b: a + b, [F.col("b")[0], *[F.col("b")[i + 1] * F.col(x) for i, x in enumerate(xs)]])
    return df.join(fits.select(*by, "b"), by).withColumn("shock", F.col(d) - fit).drop("b")


def top_predictors(fits: DataFrame, by: list[str], xs: list[str], most: int = 10) -> DataFrame:
    """(*by, predictor, coefficient, place) of the largest coefficients that are not 0."""
    named = F.explode(F.zip_with(F.array(*[F.lit(x) for x in xs]), F.slice("b", 2, len(xs)), lambda n, c: F.struct(n.alias("predictor"), c.alias("coefficient"))))
    rows = fits.select(*by, named.alias("x")).select(*by, "x.*").filter("coefficient <> 0")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("coefficient").desc(), "predictor"))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def domain_sensitivity(df: DataFrame, by: list[str], at: str, y: str, d: str, domains: dict[str, list[str]], lags: int = 3) -> DataFrame:
    """(domain, *by, n, beta, se, z, place, base_place, shift): the response of y to what each domain's controls leave of d.

    Groups are placed by |z| within a domain; ``shift`` is how many places one moves from the
    first domain, the base. Groups without a z come last.
    """
    found = None
    for name, xs in domains.items():
        cleared = partial_out(df, by, [d], xs).withColumnRenamed(f"r_{d}", "__shock") if xs else df.withColumn("__shock", F.col(d))
        one = hac_slope(cleared, by, at, y, "__shock", lags).withColumn("domain", F.lit(name))
        found = one if found is None else found.unionByName(one)
    strength: Column = F.round(F.abs("z"), 8).desc_nulls_last()
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(strength, *by)))
    base = placed.filter(F.col("domain") == next(iter(domains))).select(*by, F.col("place").alias("base_place"))
    return placed.join(base, by, "left").withColumn("shift", F.col("place") - F.col("base_place")).select("domain", *by, "n", "beta", "se", "z", "place", "base_place", "shift")
