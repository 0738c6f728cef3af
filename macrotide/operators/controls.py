"""Least squares on any number of controls, from moments that are summed once for each group (and fold)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.operators.regression import hac_slope

#: A control whose share of variance that the ones before it leave is below this is collinear with them.
COLLINEAR = 1e-10


def solved(s: np.ndarray, n: int, p: int, ridge: float, free: int, most_condition: float) -> tuple[list[np.ndarray], int, float, str | None]:
    """(coefficients of each target, controls used, condition, reason) from moments of (1, p controls, targets).

    Constant and collinear controls are dropped, in their order, and get the coefficient 0. With
    a reason, no fit is made: ``few_rows`` if fewer than ``free`` rows are left beside the
    coefficients, ``no_controls``, or ``ill_conditioned``. ``ridge`` is added to each control's
    correlation with itself, so that shrinkage does not depend on units or rows.
    """
    targets = s.shape[0] - 1 - p
    zero = [np.zeros(1 + p) for _ in range(targets)]
    means = s[0, 1:] / max(n, 1)
    for i, b in enumerate(zero):
        b[0] = means[p + i]
    if n < p + 1 + free:
        return zero, 0, 0.0, "few_rows"
    centred = s[1:, 1:] - n * np.outer(means, means)
    size = np.sqrt(np.maximum(np.diag(centred), 0))
    used: list[int] = []
    left = centred[:p, :p].copy()
    for j in range(p):
        if size[j] > 1e-10 and left[j, j] > COLLINEAR * centred[j, j]:
            used.append(j)
            left -= np.outer(left[:, j], left[j]) / left[j, j]
    if not used:
        return zero, 0, 0.0, "no_controls"
    scaled = centred[np.ix_(used, used)] / np.outer(size[used], size[used])
    condition = float(np.linalg.cond(scaled))
    if not condition <= most_condition:
        return zero, len(used), condition, "ill_conditioned"
    for i, b in enumerate(zero):
        b[1 + np.array(used)] = np.linalg.solve(scaled + ridge * np.eye(len(used)), centred[used, p + i] / size[used]) / size[used]
        b[0] = means[p + i] - b[1:] @ means[:p]
    return zero, len(used), condition, None


def _moments(df: DataFrame, by: list[str], names: list[str]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """n and sums m0, m1, .. of the products of (1, names), in each group."""
    terms: list[Column] = [F.lit(1.0), *[F.col(c) for c in names]]
    places = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(terms[i] * terms[j]).alias(f"m{k}") for k, (i, j) in enumerate(places)]), places


def _solve(moments: DataFrame, by: list[str], places: list[tuple[int, int]], p: int, ys: list[str], ridge: float, free: int, most_condition: float) -> DataFrame:
    """(*by, n, used, condition, reason, b_<y>: array) from a row of moments for each group."""
    width = 1 + p + len(ys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = frame[[f"m{k}" for k in range(len(places))]].to_numpy(float)
            out = []
            for row, n in zip(sums, frame["n"]):
                s = np.zeros((width, width))
                for (i, j), x in zip(places, row):
                    s[i, j] = s[j, i] = x
                betas, used, condition, reason = solved(s, int(n), p, ridge, free, most_condition)
                out.append((used, condition, reason, *[b.tolist() for b in betas]))
            found = pd.DataFrame(out, columns=["used", "condition", "reason", *[f"b_{y}" for y in ys]])
            yield pd.concat([frame[[*by, "n"]].reset_index(drop=True), found], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "n"]) + ", used int, condition double, reason string" + "".join(f", b_{y} array<double>" for y in ys)
    return moments.mapInPandas(run, schema)


def design_guards(df: DataFrame, by: list[str], ys: list[str], xs: list[str], ridge: float = 0.0, free: int = 5, most_condition: float = 1e8) -> DataFrame:
    """(*by, n, used, condition, reason, b_<y>): the fit of each y on a constant and xs in each group, or the reason for none.

    Rows with a null in any of these columns are left out; see ``solved`` for the guards.
    """
    held = df.dropna(subset=[*xs, *ys])
    moments, places = _moments(held, by, [*xs, *ys])
    return _solve(moments, by, places, len(xs), ys, ridge, free, most_condition)


def _cleared(rows: DataFrame, ys: list[str], xs: list[str]) -> DataFrame:
    """Adds r_<y>: y less its fit."""
    def fit(y: str) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"b_{y}")[0], *[F.col(f"b_{y}")[i + 1] * F.col(x) for i, x in enumerate(xs)]])

    return rows.withColumns({f"r_{y}": F.col(y) - fit(y) for y in ys}).drop(*[f"b_{y}" for y in ys])


def partial_out(df: DataFrame, by: list[str], ys: list[str], xs: list[str], ridge: float = 0.0) -> DataFrame:
    """Rows that have all columns, with r_<y>: each y less its fit on a constant and xs in its group (less its mean, if no fit can be made)."""
    fits = design_guards(df, by, ys, xs, ridge, free=1).select(*by, *[f"b_{y}" for y in ys])
    return _cleared(df.dropna(subset=[*xs, *ys]).join(fits, by), ys, xs)


def fold_fits(df: DataFrame, by: list[str], fold: str, ys: list[str], xs: list[str], ridge: float = 0.0) -> DataFrame:
    """(*by, fold, b_<y>: array): the fit of the rows of the other folds, from moments of all less those of the own fold. A fold without a fit is left out."""
    moments, places = _moments(df.dropna(subset=[*xs, *ys, fold]), [*by, fold], [*xs, *ys])
    whole = Window.partitionBy(*by)
    rest = moments.select(*by, fold, *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ["n", *[f"m{k}" for k in range(len(places))]]])
    return _solve(rest, [*by, fold], places, len(xs), ys, ridge, 0, 1e12).filter("reason is null").select(*by, fold, *[f"b_{y}" for y in ys])


def out_of_fold(df: DataFrame, by: list[str], fold: str, ys: list[str], xs: list[str], ridge: float = 0.0) -> DataFrame:
    """As ``partial_out``, with the fit of the rows of the other folds (``fold_fits``)."""
    return _cleared(df.dropna(subset=[*xs, *ys, fold]).join(fold_fits(df, by, fold, ys, xs, ridge), [*by, fold]), ys, xs)


def partially_linear(df: DataFrame, by: list[str], at: str, y: str, d: str, xs: list[str], fold: str, lags: int = 3, ridge: float = 0.0) -> DataFrame:
    """Cross-fitted effect of d on y given xs: the HAC slope of y's out-of-fold residual on d's."""
    rows = out_of_fold(df, by, fold, [y, d], xs, ridge)
    return hac_slope(rows, by, at, f"r_{y}", f"r_{d}", lags)


def ridge_sanity(df: DataFrame, by: list[str], at: str, y: str, d: str, xs: list[str], ridge: float = 0.1, lags: int = 3) -> DataFrame:
    """The HAC slope of ridge residuals, and as ``lead_z`` the z of the same with d one row ahead, which should find nothing."""
    now = hac_slope(partial_out(df, by, [y, d], xs, ridge), by, at, f"r_{y}", f"r_{d}", lags)
    ahead = df.withColumn("ahead", F.lead(d).over(Window.partitionBy(*by).orderBy(at)))
    placebo = hac_slope(partial_out(ahead, by, [y, "ahead"], xs, ridge), by, at, f"r_{y}", "r_ahead", lags).select(*by, F.col("z").alias("lead_z"))
    return now.join(placebo, by, "left")


def rolling_granger(panel: DataFrame, pairs: DataFrame, width: int, lags: int = 1, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(cause, effect, date, n, f, r): whether ``lags`` of the cause help to foretell the effect, in every whole window of ``width`` rows.

    pairs: (cause, effect). f compares the residuals of the effect on its own lags with those on
    both series' lags; r is the correlation of the effect with the cause's first lag, given the
    other lags. Products are summed over windows; each window is then solved by itself.
    """
    w = Window.partitionBy(by).orderBy(at)
    lagged = panel.withColumns({f"l{k}": F.lag(x, k).over(w) for k in range(1, lags + 1)})
    effect = lagged.select(F.col(by).alias("effect"), at, *[F.col(f"l{k}").alias(f"y{k}") for k in range(1, lags + 1)], F.col(x).alias("y"))
    cause = lagged.select(F.col(by).alias("cause"), at, *[F.col(f"l{k}").alias(f"x{k}") for k in range(1, lags + 1)])
    names = [*[f"y{k}" for k in range(1, lags + 1)], *[f"x{k}" for k in range(1, lags + 1)], "y"]
    rows = pairs.join(effect, "effect").join(cause, ["cause", at]).dropna(subset=names)
    key = ["cause", "effect"]
    means = rows.groupBy(*key).agg(*[F.avg(c).alias(f"mean_{c}") for c in names])
    rows = rows.join(means, key).select(*key, at, *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in names])
    window = Window.partitionBy(*key).orderBy(at).rowsBetween(1 - width, 0)
    terms: list[Column] = [F.lit(1.0), *[F.col(c) for c in names]]
    places = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = {f"m{k}": F.sum(terms[i] * terms[j]).over(window) for k, (i, j) in enumerate(places)}
    rows = rows.withColumns({"n": F.count("*").over(window), **sums}).filter(F.col("n") == width).select(*key, at, "n", *sums)
    free, size = width - 2 * lags - 1, len(terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = np.zeros((len(frame), size, size))
            for k, (i, j) in enumerate(places):
                s[:, i, j] = s[:, j, i] = frame[f"m{k}"]

            def left(a: list[int], b: list[int]) -> np.ndarray:
                """Cross-products of b that a does not explain."""
                inner = s[:, a][:, :, a]
                return s[:, b][:, :, b] - np.swapaxes(s[:, a][:, :, b], 1, 2) @ np.linalg.pinv(inner, hermitian=True) @ s[:, a][:, :, b]

            y = size - 1
            own, both = [0, *range(1, lags + 1)], [*range(y)]
            restricted, full = left(own, [y])[:, 0, 0], left(both, [y])[:, 0, 0]
            rest = left([i for i in both if i != lags + 1], [lags + 1, y])
            with np.errstate(divide="ignore", invalid="ignore"):
                f = np.where(full > 1e-12 * s[:, y, y], (restricted - full) / lags / (full / free), np.nan)
                r = rest[:, 0, 1] / np.sqrt(rest[:, 0, 0] * rest[:, 1, 1])
            yield pd.DataFrame({**{c: frame[c] for c in (*key, at, "n")}, "f": f, "r": r})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*key, at, "n")) + ", f double, r double")


def joint_test(df: DataFrame, by: list[str], y: str, kept: list[str], tested: list[str], least: int = 12) -> DataFrame:
    """(*by, n, f): the F of leaving ``tested`` out of the fit of y on a constant, ``kept`` and them, in groups with more than ``least`` whole rows.

    With leads of a shock as ``tested``, it tells whether an outcome moves ahead of it.
    """
    held = df.dropna(subset=[y, *kept, *tested])
    full = partial_out(held, by, [y], [*kept, *tested]).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(f"r_{y}") * F.col(f"r_{y}")).alias("full"))
    less = partial_out(held, by, [y], kept).groupBy(*by).agg(F.sum(F.col(f"r_{y}") * F.col(f"r_{y}")).alias("less"))
    free = F.col("n") - 1 - len(kept) - len(tested)
    f = F.try_divide((F.col("less") - F.col("full")) / len(tested), F.col("full") / F.when(free > 0, free))
    return full.join(less, by).filter(F.col("n") > least).select(*by, "n", f.alias("f"))
