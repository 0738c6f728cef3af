"""Event designs over long panels: selection, panels around events, and mean paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from macrotide.functions.columns import normal_p


def thinned(events: DataFrame, gap: int, by: str = "series", i: str = "i") -> DataFrame:
    """(series, i): events in order, each kept if it is ``gap`` or more after the last kept one."""

    def step(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(x))).otherwise(kept)

    listed = events.groupBy(by).agg(F.array_sort(F.collect_list(F.col(i).cast("int"))).alias("all"))
    return listed.select(by, F.explode(F.aggregate("all", F.slice("all", 1, 1), step)).alias(i))


def numbered(panel: DataFrame, by: str = "series", at: str = "date") -> DataFrame:
    return panel.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(at)))


def select_events(panel: DataFrame, quantile: float, gap: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(series, i, date): rows whose change reaches the series' quantile of changes, thinned to a least gap."""
    rows = numbered(panel, by, at).withColumn("move", F.col(x) - F.lag(x).over(Window.partitionBy(by).orderBy(at)))
    cut = rows.groupBy(by).agg(F.percentile("move", F.lit(quantile)).alias("cut"))
    large = rows.join(cut, by).filter("move >= cut")
    return thinned(large, gap, by).join(rows.select(by, "i", at), [by, "i"])


def event_panel(panel: DataFrame, events: DataFrame, first: int, last: int, baseline: int, by: str = "series", at: str = "date", x: str = "value") -> DataFrame:
    """(series, event, event_time, change): values around each event less the value at the baseline."""
    rows = numbered(panel, by, at).select(by, "i", x)
    times = events.select(by, F.col("i").alias("event"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("event_time")).withColumn("i", F.col("event") + F.col("event_time"))
    base = rows.select(by, (F.col("i") - baseline).alias("event"), F.col(x).alias("base"))
    return times.join(rows, [by, "i"]).join(base, [by, "event"]).select(by, "event", "event_time", (F.col(x) - F.col("base")).alias("change"))


def event_path(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean change, error, 95 % interval and normal p by event time (within ``by``)."""
    out = rows.groupBy(*by, "event_time").agg(F.count("*").alias("n"), F.avg("change").alias("effect"), (F.stddev_samp("change") / F.sqrt(F.count("*"))).alias("se"))
    return out.withColumns({"lo": F.col("effect") - 1.96 * F.col("se"), "hi": F.col("effect") + 1.96 * F.col("se"), "p": normal_p(F.try_divide("effect", "se"))})


def design_diagnostics(rows: DataFrame, placebo: DataFrame, events: DataFrame, looser: DataFrame, last: int, baseline: int = -1, alpha: float = 0.05, least_events: int = 8, least_overlap: float = 0.6, least_stability: float = 0.6, by: str = "series", i: str = "i") -> DataFrame:
    """One row for each series with events: whether its event design holds.

    rows and placebo: event panels of the true and the placebo events; events and looser: the
    events and those of a looser threshold. support: at least ``least_events``. pretrend_p: the
    least p before the baseline. placebo_p: p of the placebo events at time 0. overlap: share of
    the times 0 .. ``last`` that have rows. stability: share of effects from time 0 on that have
    the sign of their median and at least half its size. jaccard: events that both thresholds
    share. A figure that is missing does not pass.
    """
    path = event_path(rows, (by,))
    post = F.col("event_time") >= 0
    median = path.filter(post).groupBy(by).agg(F.percentile("effect", F.lit(0.5)).alias("__m"))
    stable = (F.signum("effect") == F.signum("__m")) & (F.abs("effect") >= 0.5 * F.abs("__m"))
    figures = path.join(median, by, "left").groupBy(by).agg(F.min(F.when(F.col("event_time") < baseline, F.col("p"))).alias("pretrend_p"), (F.count_if(post) / (last + 1)).alias("overlap"), F.avg(F.when(post, stable.cast("int"))).alias("stability"))
    placebo_p = event_path(placebo.filter("event_time = 0"), (by,)).select(by, F.col("p").alias("placebo_p"))
    both = events.select(by, i).withColumn("__a", F.lit(1)).join(looser.select(by, i).withColumn("__b", F.lit(1)), [by, i], "full")
    overlap = both.groupBy(by).agg(F.count("__a").alias("n_events"), F.count("__b").alias("n_looser"), (F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()) / F.count("*")).alias("jaccard")).filter("n_events > 0")
    out = overlap.join(figures, by, "left").join(placebo_p, by, "left")
    passes = {"support": F.col("n_events") >= least_events, "pretrend": F.col("pretrend_p") >= alpha, "placebo": F.col("placebo_p") >= alpha, "depth": F.col("overlap") >= least_overlap, "stable": F.col("stability") >= least_stability}
    return out.withColumn("failed", F.concat_ws(";", *[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in passes.items()]))
