"""Bounds, monotone order and benchmarks that a high-frequency path is held to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import clip


def shaped(path: DataFrame, lower: float | None, upper: float | None, monotonic: str, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """``x`` held to bounds and made ``increasing`` or ``decreasing`` along each series by running maxima or minima (``none``: as it is)."""
    held = clip(F.col(x), lower, upper)
    if monotonic == "none":
        return path.withColumn(x, held)
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn(x, {"increasing": F.max, "decreasing": F.min}[monotonic](held).over(w))


def level_to_sum(values: np.ndarray, target: float, lower: float | None, upper: float | None) -> tuple[np.ndarray, bool]:
    """Values held to bounds, then moved by one common step as far as the bounds let each go, so that they sum to ``target``; and whether they can."""
    low, high = (-np.inf if lower is None else lower), (np.inf if upper is None else upper)
    x = np.clip(values, low, high)
    n = len(x)
    possible = n * low - 1e-9 <= target <= n * high + 1e-9
    goal = min(max(target, n * low), n * high)
    up = goal >= x.sum()
    # On the way up, the values nearest to the upper bound stop first; the way down is its mirror image.
    y, stop, want = (x, high, goal) if up else (-x, -low, -goal)
    order = np.argsort(-y)
    left, free = want, n
    step = (want - y.sum()) / n
    for i in order:
        if y[i] + step <= stop:
            break
        left, free = left - stop, free - 1
        if not free:
            break
        rest = y[order[n - free :]].sum()
        step = (left - rest) / free
    y = np.minimum(y + step, stop)
    return (y if up else -y), possible


def benchmarked(path: DataFrame, low: DataFrame, lower: float | None, upper: float | None, conversion: str = "sum", by: str = "series", block: str = "block", at: str = "date", x: str = "value") -> DataFrame:
    """``path`` with each block's values moved to the block's ``target``: their sum, mean, first or last value; adds ``feasible``.

    low: (series, block, target). A block has the few values of one low-frequency period.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            moved, possible = [], []
            for values, target in zip(frame["values"], frame["target"]):
                v = np.array(values, float)
                if conversion in ("sum", "mean"):
                    v, can = level_to_sum(v, target * (len(v) if conversion == "mean" else 1), lower, upper)
                else:
                    low, high = (-np.inf if lower is None else lower), (np.inf if upper is None else upper)
                    can = bool(low <= target <= high)
                    v[-1 if conversion == "last" else 0] = target
                    v = np.clip(v, low, high)
                moved.append(v.tolist())
                possible.append(bool(can))
            yield pd.DataFrame({by: frame[by], block: frame[block], "dates": frame["dates"], "moved": moved, "feasible": possible})

    kinds = {f.name: f.dataType.simpleString() for f in path.schema}
    rows = path.filter(F.col(x).isNotNull()).groupBy(by, block).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("d"), F.col(x).cast("double").alias("v")))).alias("r"))
    rows = rows.join(low.select(by, block, "target"), [by, block]).select(by, block, F.col("r.d").alias("dates"), F.col("r.v").alias("values"), F.col("target").cast("double").alias("target"))
    done = rows.mapInPandas(run, f"`{by}` {kinds[by]}, `{block}` {kinds[block]}, dates array<{kinds[at]}>, moved array<double>, feasible boolean")
    return done.select(by, block, "feasible", F.explode(F.arrays_zip("dates", "moved")).alias("z")).select(by, block, F.col("z.dates").alias(at), F.col("z.moved").alias(x), "feasible")


def constraint_enforce(path: DataFrame, low: DataFrame, lower: float | None = None, upper: float | None = None, monotonic: str = "none", conversion: str = "sum", priority: str = "benchmark", by: str = "series", block: str = "block", at: str = "date", x: str = "value") -> DataFrame:
    """(series, block, date, value, feasible): the path shaped and then benchmarked, or, with the priority ``shape``, shaped once more."""
    out = benchmarked(shaped(path, lower, upper, monotonic, by, at, x), low, lower, upper, conversion, by, block, at, x)
    return shaped(out, lower, upper, monotonic, by, at, x) if priority == "shape" else out


def constraint_report(enforced: DataFrame, low: DataFrame, lower: float | None = None, upper: float | None = None, monotonic: str = "none", conversion: str = "sum", by: str = "series", block: str = "block", at: str = "date", x: str = "value") -> DataFrame:
    """(series, out_of_bounds, out_of_order, benchmark_error, infeasible) of an enforced path."""
    move = F.col(x) - F.lag(x).over(Window.partitionBy(by).orderBy(at))
    wrong = {"none": F.lit(False), "increasing": move < -1e-10, "decreasing": move > 1e-10}[monotonic]
    outside = (F.col(x) < (-np.inf if lower is None else lower) - 1e-10) | (F.col(x) > (np.inf if upper is None else upper) + 1e-10)
    rows = enforced.withColumns({"wrong": F.coalesce(wrong, F.lit(False)).cast("int"), "outside": outside.cast("int")})
    got = {"sum": F.sum(x), "mean": F.avg(x), "first": F.min_by(x, at), "last": F.max_by(x, at)}[conversion]
    blocks = rows.groupBy(by, block).agg(got.alias("got"), F.sum("wrong").alias("wrong"), F.sum("outside").alias("outside"), F.max((~F.col("feasible")).cast("int")).alias("cannot")).join(low, [by, block])
    return blocks.groupBy(by).agg(F.sum("outside").alias("out_of_bounds"), F.sum("wrong").alias("out_of_order"), F.sum(F.abs(F.col("got") - F.col("target"))).alias("benchmark_error"), F.sum("cannot").cast("long").alias("infeasible"))
