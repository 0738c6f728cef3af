"""Effects of a treatment with cross-fitted nuisances: targeted averages, and effects that differ from row to row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import normal_p
from macrotide.functions.shipping import cut
from macrotide.operators.controls import fold_fits


def _linear(b: str, xs: list[str]) -> Column:
    return reduce(lambda u, v: u + v, [F.col(b)[0], *[F.col(b)[i + 1] * F.col(x) for i, x in enumerate(xs)]])


def propensities(df: DataFrame, by: list[str], fold: str, a: str, xs: list[str], rounds: int = 8, ridge: float = 1e-3) -> DataFrame:
    """Rows with ``g``: the probability of a = 1 by a logistic fit on the rows of the group's other folds.

    Each of the ``rounds`` Newton steps is one aggregation for each group and fold left out, so
    that no group is gathered, and reads ``df`` again; a row takes part in the fits of all folds but its own. ``ridge``
    holds the slopes where xs separate a. A group with a single fold has no fit and no rows.
    """
    held = df.dropna(subset=[a, fold, *xs])
    folds = held.select(*by, fold).distinct()
    train = held.select(*by, F.col(fold).alias("__own"), a, *xs).join(folds, by).filter(F.col(fold) != F.col("__own"))
    size = len(xs) + 1
    places = [(i, j) for i in range(size) for j in range(i, size)]
    state = cut(train.select(*by, fold).distinct().withColumn("b", F.array(*[F.lit(0.0)] * size)))
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, fold)) + ", b array<double>"
    terms: list[Column] = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                h, b = np.zeros((size, size)), np.array(row.b, float)
                for k, (i, j) in enumerate(places):
                    h[i, j] = h[j, i] = getattr(row, f"h{k}")
                hold = ridge * row.n * np.diag([1e-6, *[1.0] * (size - 1)])
                move = np.linalg.solve(h + hold, np.array([getattr(row, f"s{i}") for i in range(size)]) - hold @ b)
                out.append((b + move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))).tolist())
            yield frame[[*by, fold]].assign(b=out)

    for _ in range(rounds):
        rows = train.join(state, [*by, fold]).withColumn("__p", 1 / (1 + F.exp(-_linear("b", xs))))
        weight, left = F.col("__p") * (1 - F.col("__p")), F.col(a) - F.col("__p")
        sums = [F.sum(weight * terms[i] * terms[j]).alias(f"h{k}") for k, (i, j) in enumerate(places)] + [F.sum(left * t).alias(f"s{i}") for i, t in enumerate(terms)]
        state = cut(rows.groupBy(*by, fold).agg(F.count("*").alias("n"), F.first("b").alias("b"), *sums).mapInPandas(step, schema))
    return held.join(state, [*by, fold]).withColumn("g", 1 / (1 + F.exp(-_linear("b", xs)))).drop("b")


def tmle_ate(df: DataFrame, by: list[str], at: str, y: str, a: str, xs: list[str], fold: str, epsilons: tuple[float, ...] = (0.01, 0.05, 0.1), lags: int = 3) -> DataFrame:
    """(*by, eps, n, estimate, se, lo, hi, p, ess): the average effect of a (0 or 1) on y, targeted, for each truncation of the propensity.

    The outcome's linear fit on a and xs and the propensity come from the other folds. The error
    is the Bartlett one of the influence values; ess is the effective number of rows. Groups
    without both values of a, or without a fit, are left out.
    """
    both = df.dropna(subset=[y, a, fold, *xs])
    # written once: every Newton step reads these rows
    both = cut(both.join(both.groupBy(*by).agg(F.count_distinct(a).alias("__k")).filter("__k = 2").select(*by), by, "left_semi").select(*by, at, y, a, fold, *xs))
    rows = propensities(both, by, fold, a, xs).join(fold_fits(both, by, fold, [y], [a, *xs]), [*by, fold])
    rows = rows.withColumn("q", _linear(f"b_{y}", [a, *xs])).withColumns({"q1": F.col("q") + F.col(f"b_{y}")[1] * (1 - F.col(a)), "q0": F.col("q") - F.col(f"b_{y}")[1] * F.col(a)})
    rows = rows.select(*by, at, F.col(y).alias("y"), F.col(a).cast("double").alias("a"), "g", "q", "q1", "q0", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])).alias("eps"))
    rows = rows.withColumn("g", F.least(F.greatest("g", "eps"), 1 - F.col("eps"))).withColumn("h", F.expr("a / g - (1 - a) / (1 - g)"))
    key = [*by, "eps"]
    first = rows.groupBy(*key).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.expr("h * (y - q)")), F.sum(F.expr("h * h"))).alias("step"))
    rows = rows.join(first, key).withColumn("gap", F.expr("q1 + step / g - (q0 - step / (1 - g))"))
    mean = rows.groupBy(*key).agg(F.avg("gap").alias("estimate"), (F.pow(F.sum(F.abs("h")), F.lit(2)) / F.sum(F.expr("h * h"))).alias("ess"))
    rows = rows.join(mean, key).withColumn("ic", F.expr("h * (y - q - step * h) + gap - estimate"))
    w = Window.partitionBy(*key).orderBy(at)
    meat = F.col("ic") * F.col("ic")
    for k in range(1, lags + 1):
        meat = meat + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col("ic") * F.lag("ic", k).over(w), F.lit(0.0))
    out = rows.withColumn("meat", meat).groupBy(*key).agg(F.first("n").alias("n"), F.first("estimate").alias("estimate"), F.first("ess").alias("ess"), (F.sqrt(F.greatest(F.sum("meat"), F.lit(0.0))) / F.count("*")).alias("se"))
    z = F.try_divide("estimate", "se")
    return out.select(*key, "n", "estimate", "se", (F.col("estimate") - 1.96 * F.col("se")).alias("lo"), (F.col("estimate") + 1.96 * F.col("se")).alias("hi"), normal_p(z).alias("p"), "ess")


def r_learner(df: DataFrame, y: str, d: str, xs: list[str], fold: str, folds: list[int], trees: int = 20, depth: int = 4, seed: int = 7, least: float = 1e-6) -> tuple[DataFrame, dict[str, float]]:
    """(rows with r_y, r_d and ``effect``, importances of xs): how the effect of d on y differs with xs.

    Random forests of the other folds clear y and d; a forest of r_y / r_d, weighted by r_d
    squared, gives each row's effect. Rows with a null in these columns are left out; rows whose
    d is explained but for ``least`` don't train the effect.
    """
    rows = VectorAssembler(inputCols=xs, outputCol="__x").transform(df.dropna(subset=[y, d, fold, *xs]))

    def forest(target: str) -> RandomForestRegressor:
        return RandomForestRegressor(featuresCol="__x", labelCol=target, predictionCol=f"__{target}", numTrees=trees, maxDepth=depth, seed=seed)

    parts = []
    for f in folds:
        train, held = rows.filter(F.col(fold) != f), rows.filter(F.col(fold) == f)
        for target in (y, d):
            held = forest(target).fit(train).transform(held)
        parts.append(held)
    cleared = reduce(DataFrame.unionByName, parts).withColumns({f"r_{c}": F.col(c) - F.col(f"__{c}") for c in (y, d)}).drop(f"__{y}", f"__{d}")
    cleared = cut(cleared)
    target = cleared.filter(F.abs(f"r_{d}") > least).withColumns({"effect": F.col(f"r_{y}") / F.col(f"r_{d}"), "__w": F.col(f"r_{d}") * F.col(f"r_{d}")})
    model = forest("effect").setWeightCol("__w").fit(target)
    return model.transform(cleared).withColumnRenamed("__effect", "effect").drop("__x"), dict(zip(xs, (float(v) for v in model.featureImportances.toArray())))


def segment_effects(rows: DataFrame, by: list[str], y: str, d: str) -> DataFrame:
    """(*by, n, mean_effect, ate) of ``r_learner`` rows: the mean of the rows' effects, and the slope of r_y on r_d through 0."""
    ry, rd = F.col(f"r_{y}"), F.col(f"r_{d}")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("effect").alias("mean_effect"), F.try_divide(F.sum(ry * rd), F.sum(rd * rd)).alias("ate"))
