"""Regressions over groups from aggregated moments, with Bartlett (HAC) errors; one shuffle for each group key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import normal_p


def gram(df: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """n, means, and centred cross-products of xs and y in each group; columns are centred before they are multiplied."""
    names = [*xs, y]
    held = df.filter(" and ".join(f"{c} is not null" for c in names))
    means = held.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in names])
    rows = held.join(means, by)
    d = {c: F.col(c) - F.col(f"mean_{c}") for c in names}
    products = [F.sum(d[a] * d[b]).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.first(f"mean_{c}").alias(f"mean_{c}") for c in names], *products)


def two_slopes(a: str, b: str, y: str) -> tuple[Column, Column]:
    """Slopes of y on a and b, from columns that ``gram`` made for xs = [a, b]."""
    s = lambda u, v: F.col(f"s_{u}_{v}")
    det = s(a, a) * s(b, b) - s(a, b) * s(a, b)
    held = F.when(F.abs(det) > 1e-12 * s(a, a) * s(b, b), det)
    return (s(b, b) * s(a, y) - s(a, b) * s(b, y)) / held, (s(a, a) * s(b, y) - s(a, b) * s(a, y)) / held


def hac_slope(df: DataFrame, by: list[str], at: str, y: str, x: str, lags: int) -> DataFrame:
    """Slope of y on x in each group, its Bartlett HAC error, z and normal p.

    With centred x and residual u, the error is sqrt(sum s^2 + 2 sum_k (1 - k / (L + 1)) sum s_t s_{t-k}) / Sxx, s = (x - mean x) u.
    """
    held = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = held.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_slope(y, x).alias("beta"), F.regr_sxx(y, x).alias("sxx"))
    rows = held.join(fit, by)
    score = (F.col(x) - F.col("mx")) * (F.col(y) - F.col("my") - F.col("beta") * (F.col(x) - F.col("mx")))
    rows = rows.select(*by, at, "n", "beta", "sxx", score.alias("s"))
    w = Window.partitionBy(*by).orderBy(at)
    meat = F.col("s") * F.col("s")
    for k in range(1, lags + 1):
        meat = meat + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col("s") * F.lag("s", k).over(w), F.lit(0.0))
    summed = rows.withColumn("meat", meat).groupBy(*by).agg(F.first("n").alias("n"), F.first("beta").alias("beta"), F.first("sxx").alias("sxx"), F.sum("meat").alias("meat"))
    out = summed.withColumn("se", F.when(F.col("sxx") > 0, F.sqrt(F.greatest(F.col("meat"), F.lit(0.0))) / F.col("sxx")))
    out = out.withColumn("z", F.try_divide("beta", "se"))
    return out.withColumn("p", normal_p(F.col("z"))).drop("sxx", "meat")


def local_projection(panel: DataFrame, pairs: DataFrame, horizons: int, lags: int, state: str | None = None, past: int = 1, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """Response of outcomes' changes to a one-deviation shock at horizons 0 .. H, with HAC errors.

    pairs: (treatment, outcome). The shock is the treatment's change; both the outcome ahead and
    the shock are cleared of the last ``past`` shocks and the last ``past`` changes of the
    outcome before the slope is taken. With a ``state`` column on the panel, each state is a
    group of its own.
    """
    from macrotide.operators.controls import partial_out

    w = Window.partitionBy(by).orderBy(at)
    moves = panel.withColumn("move", F.col(x) - F.lag(x).over(w))
    before = [f"{c}{k}" for c in ("shock", "before") for k in range(1, past + 1)]
    held = moves.select(F.col(by).alias("treatment"), at, F.col("move").alias("shock"), *[F.lag("move", k).over(w).alias(f"shock{k}") for k in range(1, past + 1)], *([state] if state else []))
    ahead = moves
    for h in range(horizons + 1):
        ahead = ahead.withColumn(f"y{h}", F.lead(x, h).over(w) - F.lag(x).over(w))
    own = [f"before{k}" for k in range(1, past + 1)]
    ahead = ahead.withColumns({c: F.lag("move", k).over(w) for k, c in enumerate(own, 1)})  # before rows are multiplied
    outcomes = ahead.select(F.col(by).alias("outcome"), at, *own, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in range(horizons + 1)])).alias("ahead"))
    outcomes = outcomes.select("*", "ahead.horizon", "ahead.y").drop("ahead")
    design = pairs.join(held, "treatment").join(outcomes, ["outcome", at]).dropna(subset=["y", "shock", *before])
    key = ["treatment", "outcome", "horizon", *([state] if state else [])]
    cleared = partial_out(design, key, ["y", "shock"], before)
    fit = hac_slope(cleared, key, at, "r_y", "r_shock", lags)
    scale = design.groupBy(*key).agg(F.stddev_samp("shock").alias("shock_sd"))
    return fit.join(scale, key).withColumns({"effect": F.col("beta") * F.col("shock_sd"), "effect_se": F.col("se") * F.col("shock_sd")})
