"""Principal components of groups of columns, from moments, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr
from macrotide.operators import calendar
from macrotide.operators.controls import _moments, design_guards


def principal(cov: np.ndarray, threshold: float, most: int, pivot_at: int | None = None, least_std: float = 1e-8) -> tuple[int, list, list, list]:
    """(k, share, scales, loadings) of a covariance matrix: the first components, signed by a column's or else their largest loading."""
    size = np.sqrt(np.maximum(np.diag(cov), 0))
    scales = np.divide(1, size, out=np.zeros_like(size), where=size > least_std)
    values, vectors = np.linalg.eigh(cov * np.outer(scales, scales))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if values.sum() <= 0:
        return 0, [], scales.tolist(), []
    share = values / values.sum()
    k = max(1, min(int(np.argmax(np.cumsum(share) >= threshold - 1e-12)) + 1, most, int((scales > 0).sum())))
    loads = []
    for v in vectors[:, :k].T:
        pivot = v[pivot_at] if pivot_at is not None else v[int(np.argmax(np.round(np.abs(v), 9)))]
        loads.append((-v if pivot < 0 else v).tolist())
    return k, share[:k].tolist(), scales.tolist(), loads


def components(df: DataFrame, by: list[str], names: list[str], threshold: float = 0.9, most: int = 5, anchor: str | None = None, least_std: float = 1e-8) -> DataFrame:
    """(*by, n, k, share, means, scales, loadings): principal components of the standardized columns of each group.

    k is the least number of components that explain ``threshold`` of the variance, from 1 to
    ``most``; share and loadings (one array a component) hold these k. Rows with a null don't
    count; a column that does not vary has the scale 0 and no loading. A component is signed so
    that the loading of ``anchor`` is positive; without one, its largest loading.
    """
    sums, places = _moments(df.dropna(subset=names), by, names)
    width = len(names) + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, n in zip(frame[[f"m{k}" for k in range(len(places))]].to_numpy(float), frame["n"]):
                s = np.zeros((width, width))
                for (i, j), x in zip(places, row):
                    s[i, j] = s[j, i] = x
                means = s[0, 1:] / n
                cov = s[1:, 1:] / n - np.outer(means, means)
                k, share, scales, loads = principal(cov, threshold, most, names.index(anchor) if anchor else None, least_std)
                out.append((k, share, means.tolist(), scales, loads))
            found = pd.DataFrame(out, columns=["k", "share", "means", "scales", "loadings"])
            yield pd.concat([frame[[*by, "n"]].reset_index(drop=True), found], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "n"]) + ", k int, share array<double>, means array<double>, scales array<double>, loadings array<array<double>>"
    return sums.mapInPandas(run, schema)


def component_scores(df: DataFrame, by: list[str], names: list[str], fits: DataFrame, most: int = 5) -> DataFrame:
    """Rows with f1 .. f<most>: their scores on the group's components, 0 beyond k; a missing column counts as its mean."""
    z = F.transform(F.arrays_zip(F.array(*[F.col(c).cast("double") for c in names]).alias("x"), F.col("means"), F.col("scales")), lambda v: F.coalesce((v["x"] - v["means"]) * v["scales"], F.lit(0.0)))
    rows = df.join(fits.select(*by, "means", "scales", "loadings"), by).withColumn("__z", z)

    def score(k: int):
        return F.when(F.size("loadings") > k, F.aggregate(F.zip_with("__z", F.get("loadings", F.lit(k)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)

    return rows.withColumns({f"f{k + 1}": score(k) for k in range(most)}).drop("means", "scales", "loadings", "__z")


def loading_table(fits: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(*by, name, factor, loading, share) of every column and component."""
    rows = fits.select(*by, F.posexplode(F.arrays_zip("loadings", "share")).alias("i", "c"))
    return rows.select(*by, (F.col("i") + 1).alias("factor"), F.col("c.share").alias("share"), F.posexplode("c.loadings").alias("j", "loading")).select(*by, F.array(*[F.lit(c) for c in names])[F.col("j")].alias("name"), "factor", "loading", "share")


def bridge_nowcast(indicators: DataFrame, names: list[str], low: DataFrame, threshold: float = 0.9, most: int = 3, by: str = "series", at: str = "date") -> DataFrame:
    """(series, date, quarter_end, bridged, nowcast): monthly paths of quarterly totals from the indicators' components.

    indicators: (date, names), a row a month. low: (series, quarter_end, total). Totals are
    fitted on the quarters' sums of scores; a month's prediction is a third of the constant and
    its own scores, and in quarters with a total it is moved by the same amount in each month so
    that it meets the total (``nowcast``). Quarters need their three months for the fit.
    """
    one = indicators.withColumn("__all", F.lit(1))
    scored = component_scores(one, ["__all"], names, components(one, ["__all"], names, threshold, most), most)
    scores = [f"f{k + 1}" for k in range(most)]
    months = scored.select(at, calendar.quarter_end(F.col(at)).alias("quarter_end"), *scores)
    quarters = months.groupBy("quarter_end").agg(F.count("*").alias("__months"), *[F.sum(c).alias(c) for c in scores])
    fits = design_guards(low.join(quarters.filter("__months = 3"), "quarter_end"), [by], ["total"], scores)
    terms = sum((F.col("b_total")[k + 1] * F.col(c) for k, c in enumerate(scores)), F.col("b_total")[0] / 3)
    series = fits.select(by, "b_total")
    paths = months.crossJoin(series).withColumn("bridged", terms)  # every series has a path: the product of two lists
    whole = paths.groupBy(by, "quarter_end").agg(F.sum("bridged").alias("__sum"), F.count("*").alias("__n")).join(low.select(by, "quarter_end", "total"), [by, "quarter_end"], "left")
    moved = F.col("bridged") + F.coalesce((F.col("total") - F.col("__sum")) / F.col("__n"), F.lit(0.0))
    return paths.join(whole, [by, "quarter_end"]).select(by, at, "quarter_end", "bridged", moved.alias("nowcast"))


def candidates_from_loadings(irf: DataFrame, loadings: DataFrame, p_max: float = 0.1, per_factor: int = 3, least_share: float = 0.0, outcome_corr: DataFrame | None = None, most_corr: float | None = None, blocked: list[str] = (), blocked_pattern: str | None = None, most: int = 5) -> DataFrame:
    """(treatment, candidate, factor, horizon, p, loading, direction, factor_share, outcome_corr, score, place): instruments from factors that respond.

    irf: (treatment, factor, horizon, beta, se, p). loadings: (factor, feature, loading), at the
    most one row for each pair. Of each factor with p of at most ``p_max``, the ``per_factor``
    features of largest |loading| are candidates, unless they are treatments, blocked, load less
    than ``least_share`` of their loadings on it, or correlate more than ``most_corr`` with an
    outcome (outcome_corr: (feature, outcome_corr), where a feature without one goes too). The
    score is |beta / se| times |loading|; a treatment keeps ``most`` candidates by p, then score.
    """
    size = F.abs("loading")
    shares = loadings.withColumn("factor_share", size / F.nullif(F.sum(size).over(Window.partitionBy("feature")), F.lit(0.0)))
    top = shares.withColumn("__r", F.row_number().over(Window.partitionBy("factor").orderBy(size.desc_nulls_last(), "feature"))).filter(F.col("__r") <= per_factor).drop("__r")
    top = top.join(irf.select(F.col("treatment").alias("feature")).distinct(), "feature", "left_anti").filter(~F.col("feature").isin(list(blocked)))
    if blocked_pattern:
        top = top.filter(~F.col("feature").rlike(blocked_pattern))
    if least_share > 0:
        top = top.filter(F.col("factor_share") >= least_share)
    top = top.join(outcome_corr, "feature", "left") if outcome_corr is not None else top.withColumn("outcome_corr", F.lit(None).cast("double"))
    if most_corr is not None:
        top = top.filter(F.col("outcome_corr") <= most_corr)
    held = irf.filter(F.col("p") <= p_max).join(top, "factor")
    score = F.abs("beta") / F.greatest(F.abs("se"), F.lit(1e-8)) * F.greatest(F.coalesce(size, F.lit(0.0)), F.lit(1e-8))
    held = held.withColumns({"score": score, "direction": F.when(F.coalesce("loading", F.lit(0.0)) >= 0, "positive").otherwise("negative")})
    order = [F.col("p"), F.round("score", 8).desc(), F.round(size, 8).desc(), F.col("factor"), F.col("horizon")]
    first = held.withColumn("__r", F.row_number().over(Window.partitionBy("treatment", "feature").orderBy(*order))).filter("__r = 1")
    place = F.row_number().over(Window.partitionBy("treatment").orderBy(*order, "feature"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("treatment", F.col("feature").alias("candidate"), "factor", "horizon", "p", "loading", "direction", "factor_share", "outcome_corr", "score", "place")


def most_outcome_corr(panel: DataFrame, outcomes: DataFrame, least: int = 20, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(feature, outcome_corr): the largest |correlation| of each series with an outcome, over at least ``least`` dates in common. outcomes: (outcome, date, y)."""
    rows = panel.select(F.col(by).alias("feature"), at, F.col(x).alias("x")).join(outcomes, at)
    pairs = rows.groupBy("feature", "outcome").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"), F.abs(corr("x", "y")).alias("r"))
    return pairs.filter(F.col("n") >= least).groupBy("feature").agg(F.max("r").alias("outcome_corr"))
