"""Filters, groups and picks of series and draws, sensitivity measures, weak-instrument sets, and sinks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr
from macrotide.functions.shipping import cut


def factor_panel_filter(stacked: DataFrame, frequencies: list[str], excluded: str | None = None, lag: int = 1, most_missing: float = 0.35, least_std: float = 1e-10, by: str = "series", x: str = "value") -> DataFrame:
    """Rows of (series, freq, lag, .., value) at one lag whose frequency is allowed and whose series is not excluded (a pattern), varies and is complete enough."""
    rows = stacked.filter((F.col("lag") == lag) & F.col("freq").isin(frequencies))
    if excluded:
        rows = rows.filter(~F.col(by).rlike(excluded))
    stats = rows.groupBy(by).agg(F.avg(F.col(x).isNull().cast("double")).alias("missing"), F.stddev_samp(x).alias("spread"))
    return rows.join(stats.filter((F.col("missing") <= most_missing) & (F.col("spread") > least_std)).select(by), by, "left_semi")


def select_controls(panel: DataFrame, targets: DataFrame, k: int, mode: str = "corr_t", forced: list[str] = (), fold: str | None = None, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(treatment, [fold,] series, variance, abs_corr, place): the ``k`` controls of each treatment that vary most or go best with it.

    targets: (treatment, date, t). ``mode``: ``variance``, ``corr_t``, or ``corr_t_then_variance``
    (half of them by |correlation|, the others by variance). ``forced`` series come first, beyond
    k; series that do not vary are left out. With a ``fold`` column on the panel, each fold's
    controls come from the rows of the others: sums of all less its own.
    """
    rows = panel.join(targets, at).dropna(subset=[x, "t"])
    key = ["treatment", by]
    v, t = F.col(x).cast("double"), F.col("t").cast("double")
    sums = {"n": F.count("*").cast("double"), "sv": F.sum(v), "st": F.sum(t), "svv": F.sum(v * v), "stt": F.sum(t * t), "svt": F.sum(v * t)}
    m = rows.groupBy(*key, *([fold] if fold else [])).agg(*[c.alias(n) for n, c in sums.items()])
    if fold:
        m = m.select(*key, fold, *[(F.sum(n).over(Window.partitionBy(*key)) - F.col(n)).alias(n) for n in sums])
    vv, tt, vt = F.expr("svv - sv * sv / n"), F.expr("stt - st * st / n"), F.expr("svt - sv * st / n")
    m = m.filter("n > 1").withColumns({"variance": vv / (F.col("n") - 1), "abs_corr": F.abs(vt) / F.sqrt(F.when(vv * tt > 1e-20, vv * tt))})
    group = ["treatment", *([fold] if fold else [])]
    is_forced = F.col(by).isin(list(forced))
    m = m.filter((F.col("variance") > 1e-12) | is_forced).withColumn("__forced", is_forced)
    w = Window.partitionBy(*group, "__forced")
    by_corr, by_var = F.round("abs_corr", 9).desc_nulls_last(), F.round("variance", 9).desc()
    if mode == "corr_t_then_variance":
        m = m.withColumn("__late", F.row_number().over(w.orderBy(by_corr, by)) > max(1, k // 2))
        order = [F.when(~F.col("__late"), F.round("abs_corr", 9)).desc_nulls_last(), by_var, F.col(by)]
    else:
        order = [by_var if mode == "variance" else by_corr, F.col(by)]
    placed = m.withColumn("place", F.row_number().over(w.orderBy(*order))).filter(F.col("__forced") | (F.col("place") <= k))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__forced").desc(), "place"))).select(*group, by, "variance", "abs_corr", "place")


def snapshot_id(rows: DataFrame, at: str = "quarter_end") -> DataFrame:
    """(snapshot_id): first and last day and number of rows; ``rows<n>`` without days, ``empty`` without rows."""
    n, days = F.count("*"), F.count(at)
    text = F.concat_ws("_", F.date_format(F.min(at), "yyyyMMdd"), F.date_format(F.max(at), "yyyyMMdd"), F.concat(F.lit("n"), n.cast("string")))
    return rows.agg(F.when(n == 0, "empty").when(days == 0, F.concat(F.lit("rows"), n.cast("string"))).otherwise(text).alias("snapshot_id"))


def oster_delta(beta0: Column, beta1: Column, r0: Column, r1: Column, most: float = 1.0) -> Column:
    """How much selection on what is not observed would explain the effect away: (b0 - b1) / b1 * (most - r1) / (r1 - r0).

    0 if both slopes are 0; null where the shares explained are not 0 <= r0 < r1 < most <= 1, or only b1 is 0.
    """
    valid = (r0 >= 0) & (r0 < r1) & (r1 < most)
    delta = (beta0 - beta1) / F.nullif(beta1, F.lit(0.0)) * (most - r1) / F.nullif(r1 - r0, F.lit(0.0))
    return F.when((beta0 == 0) & (beta1 == 0), 0.0).when(valid, delta)


def stability_ratio(beta0: Column, beta1: Column) -> Column:
    """|controlled slope| / |plain slope|; null if the plain one is 0."""
    return F.abs(beta1) / F.nullif(F.abs(beta0), F.lit(0.0))


def anderson_rubin_set(rows: DataFrame, by: list[str], at: str, y: str, d: str, z: str, lags: int = 2, points: int = 31, expansions: int = 3, critical: float = 1.959963985) -> DataFrame:
    """(*by, n, theta, lo, hi, status): the effects of d on y that the instrument z does not reject, on a grid around its estimate.

    The HAC t of z on y - theta d is a ratio of a linear and a quadratic function of theta, so
    that one pass of sums serves every grid. The grid's radius is six errors, held to 0.5 .. 20,
    and is doubled until the set lies inside: ``inside``, else ``edge`` or ``empty``.
    """
    held = rows.dropna(subset=[y, d, z])
    means = held.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in (y, d, z)])
    centred = held.join(means, by).select(*by, at, "n", *[(F.col(c) - F.col(f"mean_{c}")).alias(k) for k, c in (("y", y), ("d", d), ("z", z))])
    first = centred.groupBy(*by).agg(F.sum(F.expr("z * z")).alias("zz"), F.sum(F.expr("z * y")).alias("zy"), F.sum(F.expr("z * d")).alias("zd"))
    scored = centred.join(first.filter("zz > 0 and zd <> 0"), by).withColumns({"u": F.expr("z * (y - zy / zz * z)"), "v": F.expr("z * (d - zd / zz * z)")})
    w = Window.partitionBy(*by).orderBy(at)
    sums = {"q0": F.col("u") * F.col("u"), "q1": F.col("u") * F.col("v"), "q2": F.col("v") * F.col("v")}
    for k in range(1, lags + 1):
        weight, u, v = 1 - k / (lags + 1), F.coalesce(F.lag("u", k).over(w), F.lit(0.0)), F.coalesce(F.lag("v", k).over(w), F.lit(0.0))
        sums = {"q0": sums["q0"] + 2 * weight * F.col("u") * u, "q1": sums["q1"] + weight * (F.col("u") * v + F.col("v") * u), "q2": sums["q2"] + 2 * weight * F.col("v") * v}
    fits = scored.withColumns(sums).groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "zz", "zy", "zd")], *[F.sum(q).alias(q) for q in sums])
    fits = fits.withColumn("theta", F.expr("zy / zd"))
    error = F.sqrt(F.greatest(F.expr("q0 - 2 * theta * q1 + theta * theta * q2"), F.lit(0.0))) / F.abs("zd")
    fits = fits.withColumn("radius", F.when(error > 0, F.least(F.greatest(6 * error, F.lit(0.5)), F.lit(20.0))).otherwise(F.lit(1.0)))
    grid = fits.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(expansions - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("at_theta", F.col("theta") + F.col("radius") * F.pow(F.lit(2.0), F.col("k")) * (2 * F.col("i") / (points - 1) - 1))
    meat = F.expr("q0 - 2 * at_theta * q1 + at_theta * at_theta * q2")
    accepted = F.when(F.abs(F.expr("zy - at_theta * zd")) / F.sqrt(F.when(meat > 0, meat)) <= critical, F.struct("i", "at_theta"))
    tried = grid.groupBy(*by, "n", "theta", "k").agg(F.min(accepted).alias("low"), F.max(accepted).alias("high"))
    inside = (F.col("low.i") > 0) & (F.col("high.i") < points - 1)
    tried = tried.withColumn("status", F.when(F.col("low").isNull(), "empty").when(inside, "inside").otherwise("edge"))
    # the first grid with the set inside, else the last one
    order = F.when(F.col("status") == "inside", F.col("k")).otherwise(2 * expansions - F.col("k"))
    return tried.groupBy(*by, "n", "theta").agg(F.min_by(F.struct(F.col("low.at_theta").alias("lo"), F.col("high.at_theta").alias("hi"), "status"), order).alias("best")).select(*by, "n", "theta", "best.*")


def indicator_groups(panel: DataFrame, threshold: float = 0.7, least: int = 24, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(series, group): series are in one group if a chain of |correlations| of at least ``threshold`` leads from one to the other.

    Correlations need ``least`` dates in common; a group is named after its first series. In every
    round each group joins the first one that it is linked with, and chains of such joins are
    followed at once by doubling, so that rounds grow with the logarithm of a group's length.
    """
    a, b = (panel.select(F.col(by).alias(n), at, F.col(x).alias(v)) for n, v in (("a", "x"), ("b", "y")))
    links = a.join(b, at).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.abs(corr("x", "y")).alias("r")).filter((F.col("n") >= least) & (F.col("r") >= threshold)).select("a", "b")
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(panel.select(by).distinct().withColumn("group", F.col(by)))
    while True:
        joins = cut(links.groupBy("a").agg(F.min("b").alias("to")).filter("to < a"))
        if joins.isEmpty():
            return labels
        while True:
            further = joins.select(F.col("a").alias("__at"), F.col("to").alias("__to"))
            joins = cut(joins.join(further, F.col("to") == F.col("__at"), "left").select("a", F.coalesce("__to", "to").alias("to"), F.col("__to").isNotNull().alias("moved")))
            if joins.filter("moved").isEmpty():
                break
        joins = joins.select(F.col("a").alias("__at"), F.col("to").alias("__to"))
        labels = cut(labels.join(joins, F.col("group") == F.col("__at"), "left").select(by, F.coalesce("__to", "group").alias("group")))
        for side in ("a", "b"):
            links = links.join(joins, F.col(side) == F.col("__at"), "left").withColumn(side, F.coalesce("__to", side)).select("a", "b")
        links = cut(links.filter("a <> b").distinct())


def limiting_series(panel: DataFrame, pairs: DataFrame, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(left_series, right_series, start, limiting, times): where the values of each pair begin together, which of the two begins last, and how often it does so in all pairs.

    pairs: (left_series, right_series); of two that begin on one day the left one counts. Pairs of a series without a value are left out.
    """
    first = panel.filter(F.col(x).isNotNull()).groupBy(by).agg(F.min(at).alias("__first"))
    rows = pairs.join(first.toDF("left_series", "__a"), "left_series").join(first.toDF("right_series", "__b"), "right_series")
    limiting = F.when(F.col("__a") >= F.col("__b"), F.col("left_series")).otherwise(F.col("right_series"))
    rows = rows.select("left_series", "right_series", F.greatest("__a", "__b").alias("start"), limiting.alias("limiting"))
    return rows.join(rows.groupBy("limiting").agg(F.count("*").alias("times")), "limiting").select(*rows.columns, "times")


def draw_features(draws: DataFrame, by: list[str], draw: str = "draw", at: str = "date", x: str = "value") -> DataFrame:
    """(*by, draw, mean, std, skew, autocorr1) of each draw's path; 0 where a feature is not defined."""
    w = Window.partitionBy(*by, draw).orderBy(at)
    rows = draws.filter(F.col(x).isNotNull()).withColumn("before", F.lag(x).over(w))
    n = F.count(x)
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    found = {"mean": F.avg(x), "std": F.stddev_pop(x), "skew": skew, "autocorr1": F.when(n >= 3, corr(x, "before"))}
    return rows.groupBy(*by, draw).agg(*[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(k) for k, c in found.items()])


def representative_draws(draws: DataFrame, by: list[str], n: int, clip: float = 0.05, draw: str = "draw", at: str = "date", x: str = "value") -> DataFrame:
    """(*by, draw, score, place): ``n`` draws of each group whose mean feature ranks are nearest to evenly spaced ones.

    Scores outside ``clip`` .. 1 - clip are left out, unless too few remain. A group has one row for each draw.
    """
    features = draw_features(draws, by, draw, at, x)
    names = ["mean", "std", "skew", "autocorr1"]
    whole = Window.partitionBy(*by)
    ranks = [(F.rank().over(whole.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2) / F.count("*").over(whole) for c in names]
    scored = features.select(*by, draw, (sum(ranks[1:], ranks[0]) / len(names)).alias("score"))
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", draw]).reset_index(drop=True)
        held = frame[frame["score"].between(clip, 1 - clip)]
        held = frame if len(held) < min(n, len(frame)) else held
        chosen, left = [], held.copy()
        for goal in np.linspace(held["score"].min(), held["score"].max(), min(n, len(held))):
            best = (left["score"] - goal).abs().idxmin()
            chosen.append(left.loc[best])
            left = left.drop(best)
        out = pd.DataFrame(chosen, columns=frame.columns)
        return out.assign(place=range(1, len(out) + 1))[[*by, draw, "score", "place"]]

    return scored.groupBy(*by).applyInPandas(pick, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, draw)) + ", score double, place int")


def write_panel(panel: DataFrame, path: str, digits: int | None = None, by: str = "series", x: str = "value", form: str = "parquet") -> None:
    """Write a long panel, a folder for each series, values rounded to ``digits``; in text forms a null is ``NA``."""
    rows = panel if digits is None else panel.withColumn(x, F.round(x, digits))
    writer = rows.write.mode("overwrite").partitionBy(by)
    (writer.option("header", "true").option("nullValue", "NA") if form == "csv" else writer).format(form).save(path)


def append_results(rows: DataFrame, path: str, batch: str) -> None:
    """Append rows to a results ledger under a batch name, from which the latest can be told."""
    rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(path)
