"""Rolling screens of driver-target pairs, and scores over their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import normal_p


def rolling_pairs(panel: DataFrame, targets: DataFrame, width: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(target, candidate, date, r, beta, z, p, i) of every whole window of ``width`` rows, from moment sums in one window pass.

    targets: (target). r is the correlation, beta the slope of the target on the candidate.
    """
    t = panel.join(targets, panel[by] == targets["target"]).select("target", at, F.col(x).alias("y"))
    c = panel.select(F.col(by).alias("candidate"), at, F.col(x).alias("x"))
    rows = t.join(c, at).filter("target <> candidate")
    w = Window.partitionBy("target", "candidate").orderBy(at).rowsBetween(-(width - 1), 0)
    y, v = F.col("y"), F.col("x")
    sums = {"n": F.count("*"), "sx": F.sum(v), "sy": F.sum(y), "sxx": F.sum(v * v), "syy": F.sum(y * y), "sxy": F.sum(v * y)}
    out = rows.withColumns({k: s.over(w) for k, s in sums.items()}).filter(F.col("n") == width)
    sxy, sxx, syy = F.expr("n * sxy - sx * sy"), F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    out = out.withColumns({"r": F.try_divide(sxy, F.sqrt(F.greatest(sxx * syy, F.lit(0.0)))), "beta": F.try_divide(sxy, sxx)})
    out = out.withColumn("z", F.col("r") * F.sqrt(F.try_divide(F.lit(float(width - 2)), 1 - F.col("r") * F.col("r"))))
    out = out.withColumns({"p": normal_p(F.col("z")), "i": F.row_number().over(Window.partitionBy("target", "candidate").orderBy(at)).cast("long")})
    return out.select("target", "candidate", at, "r", "beta", "z", "p", "i")


def directional_score(windows: DataFrame, keys: list[str], alpha: float = 0.1, prior: float = 12.0) -> DataFrame:
    """(*keys, n, share, strength, score, direction) of windows (r, p): a score of 0 .. 100 for the direction that has the larger one.

    A window with p below ``alpha`` has the evidence 1 - p / alpha for the direction of its r.
    ``share`` is the evidence per window, ``strength`` the mean |r| weighted by it, and their
    product is scaled by evidence / (evidence + prior).
    """
    weight = F.greatest(1 - F.col("p") / alpha, F.lit(0.0))
    sums = []
    for name, side in (("p", F.col("r") > 0), ("n", F.col("r") < 0)):
        held = F.when(side & (F.col("p") < alpha), weight).otherwise(0.0)
        sums += [F.sum(held).alias(f"e{name}"), F.sum(F.when(held > 0, held * F.least(F.abs("r"), F.lit(1.0))).otherwise(0.0)).alias(f"s{name}")]
    out = windows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    out = out.withColumns({f"v{k}": F.expr(f"100 * s{k} / n") * F.expr(f"e{k} / (e{k} + {prior})") for k in "pn"})
    up = F.col("vp") >= F.col("vn")
    strength = F.when(up, F.try_divide("sp", "ep")).otherwise(F.try_divide("sn", "en"))
    found = {"share": F.when(up, F.col("ep")).otherwise(F.col("en")) / F.col("n"), "strength": F.coalesce(strength, F.lit(0.0)), "score": F.greatest("vp", "vn"), "direction": F.when(up, "positive").otherwise("negative")}
    return out.withColumns(found).select(*keys, "n", *found)


def independence(alpha: float = 0.1, prior: float = 12.0) -> Column:
    """How little a group's windows (r, p) are related, 0 .. 100: the median of 1 - |r| times the share with p above ``alpha``, scaled by n / (n + prior)."""
    apart = F.percentile(1 - F.least(F.abs("r"), F.lit(1.0)), F.lit(0.5))
    return 100 * apart * F.avg((F.col("p") > alpha).cast("int")) * F.count("*") / (F.count("*") + prior)


def bootstrap_scores(windows: DataFrame, keys: list[str], draws: int = 200, at: str = "i", lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """(*keys, draws, q<lo>, q<hi>): quantiles of the scores of windows drawn anew in blocks of about the square root of their number.

    ``at`` numbers a group's windows from 1. Where a block begins follows from the draw and the block,
    the same in every run. Groups no longer than one block are left out.
    """
    sized = windows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).withColumn("__k", F.expr("cast(greatest(1, floor(sqrt(__n) + 0.5)) as bigint)")).filter("__n > __k")
    drawn = sized.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
    drawn = drawn.select(*keys, "draw", F.expr(f"((draw * 1103515245L + (({at} - 1) div __k) * 12345L) % 2147483648L) % (__n - __k + 1) + ({at} - 1) % __k + 1").alias(at))
    scores = directional_score(drawn.join(windows, [*keys, at]), [*keys, "draw"])
    return scores.groupBy(*keys).agg(F.count("*").alias("draws"), *[F.percentile("score", F.lit(q)).alias(f"q{round(100 * q):02d}") for q in (lo, hi)])


def ranked(scores: DataFrame, keys: list[str], name: str, score: Column) -> DataFrame:
    """Adds ``place`` by falling score, then by name, within keys."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), name)))


#: Critical values of the residual test of two series with a constant, at 5 and 10 % (fixed values).
COINTEGRATED, WEAK = -3.34, -3.04


def rolling_cointegration(panel: DataFrame, pairs: DataFrame, width: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(driver, target, date, n, beta, speed, t, regime): a two-step residual test in every whole window of ``width`` rows.

    pairs: (driver, target). beta is the target's slope on the driver in the window; speed and t
    come from the change of what is left, regressed on what was left one row before. Both steps
    are quadratic forms of one pass of window sums. t is null where nothing is left to explain.
    """
    lagged = panel.withColumn("before", F.lag(x).over(Window.partitionBy(by).orderBy(at))).filter(F.col(x).isNotNull() & F.col("before").isNotNull())
    target = lagged.select(F.col(by).alias("target"), at, F.col(x).alias("y"), F.col("before").alias("y1"))
    driver = lagged.select(F.col(by).alias("driver"), at, F.col(x).alias("x"), F.col("before").alias("x1"))
    key, names = ["driver", "target"], ["y", "x", "y1", "x1"]
    rows = pairs.join(target, "target").join(driver, ["driver", at])
    means = rows.groupBy(*key).agg(F.avg("y").alias("__y"), F.avg("x").alias("__x"))
    rows = rows.join(means, key).withColumns({"y": F.expr("y - __y"), "y1": F.expr("y1 - __y"), "x": F.expr("x - __x"), "x1": F.expr("x1 - __x"), "one": F.lit(1.0)})
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(1 - width, 0)
    terms = ["one", *names]
    sums = {f"{a}_{b}": F.sum(F.col(a) * F.col(b)).over(w) for i, a in enumerate(terms) for b in terms[i:]}
    held = rows.withColumns({"n": F.count("*").over(w), **sums}).filter(F.col("n") == width).select(*key, at, "n", *sums)
    held = held.withColumn("beta", F.try_divide(F.expr("n * y_x - one_y * one_x"), F.expr("n * x_x - one_x * one_x"))).withColumn("a", F.expr("(one_y - beta * one_x) / n"))

    def product(u: dict[str, str], v: dict[str, str]) -> Column:
        """The window's sum of the product of two linear combinations of the terms."""
        return F.expr(" + ".join(f"({u[a]}) * ({v[b]}) * {a if terms.index(a) <= terms.index(b) else b}_{b if terms.index(a) <= terms.index(b) else a}" for a in u for b in v))

    before, change = {"y1": "1", "one": "-a", "x1": "-beta"}, {"y": "1", "y1": "-1", "x": "-beta", "x1": "beta"}
    held = held.withColumns({"ee": product(before, before), "ed": product(before, change), "dd": product(change, change)})
    held = held.withColumn("speed", F.try_divide("ed", F.when(F.expr("ee > 1e-10 * y_y"), F.col("ee"))))
    spread = F.expr("(dd - speed * ed) / (n - 1)") / F.col("ee")
    held = held.withColumn("t", F.col("speed") / F.sqrt(F.when(spread > 0, spread)))
    t = F.round("t", 6)
    return held.select(*key, at, "n", "beta", "speed", "t", F.when(t <= COINTEGRATED, "cointegrated").when(t <= WEAK, "weak").otherwise("none").alias("regime"))
