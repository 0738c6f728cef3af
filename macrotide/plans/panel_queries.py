"""Queries of cleaning, window and frequency operators over the order panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import clip, corr, rounded, safe_ln, yeo_johnson, yeo_johnson_inverse
from macrotide.functions.shipping import shared_path
from macrotide.operators import calendar, cleaning, evaluation, selection
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_D, PANEL_GAPS, PANEL_M, PANEL_NATION, panel_d, panel_gaps, panel_m, panel_nation

M, G, D, N = f"with {PANEL_M}", f"with {PANEL_GAPS}", f"with {PANEL_D}", f"with {PANEL_NATION}"
W = "(partition by series order by date)"


@query("winsorize", f"{G}, b as (select series, quantile_cont(value, 0.05) lo, quantile_cont(value, 0.9) hi from panel_gaps group by series) select series, date, round(case when value < lo then lo when value > hi then hi else value end, 6) as winsorized from panel_gaps join b using (series)")
def _(spark, d):
    return cleaning.winsorize(panel_gaps(spark, d), 0.05, 0.9).select("series", "date", *rounded("winsorized"))


@query("zscore_clip", f"{G}, b as (select series, avg(value) m, stddev_pop(value) s from panel_gaps group by series) select series, date, round(case when value < m - 1.5 * s then m - 1.5 * s when value > m + 1.5 * s then m + 1.5 * s else value end, 6) as clipped from panel_gaps join b using (series)")
def _(spark, d):
    return cleaning.zscore_clip(panel_gaps(spark, d), 1.5).select("series", "date", *rounded("clipped"))


def _hampel_sql(back: int, ahead: int, least: int) -> str:
    w = f"(partition by series order by date rows between {back} preceding and {ahead} following)"
    return f"""{G}, a as (select *, case when count(value) over {w} >= {least} then quantile_cont(value, 0.5) over {w} end as med from panel_gaps),
b as (select *, abs(value - med) as dev from a), c as (select *, case when count(dev) over {w} >= {least} then 1.4826 * quantile_cont(dev, 0.5) over {w} end as scale from b)
select series, date, round(case when scale > 0 and dev > 3.0 * scale then med else value end, 6) as filtered from c"""


@query("hampel", _hampel_sql(2, 2, 2))
def _(spark, d):
    return cleaning.hampel(panel_gaps(spark, d), 5, 3.0).select("series", "date", *rounded("filtered"))


@query("hampel_even", _hampel_sql(2, 1, 2))
def _(spark, d):
    return cleaning.hampel(panel_gaps(spark, d), 4, 3.0).select("series", "date", *rounded("filtered"))


@query("bounds_clip_smooth", f"{G}, b as (select series, date, case when value < 1 then 1 when value > 100 then 100 else value end as value from panel_gaps) select series, date, round(value, 6) as clipped, round(avg(value) over (partition by series order by date rows between 2 preceding and current row), 6) as smoothed from b")
def _(spark, d):
    held = panel_gaps(spark, d).withColumn("value", clip(F.col("value"), 1.0, 100.0))
    return cleaning.smooth(held, 3).select("series", "date", F.round("value", 6).alias("clipped"), *rounded("smoothed"))


@query("fill_ffill_bfill", f"""{G} select series, date, round(last_value(value ignore nulls) over (partition by series order by date rows between unbounded preceding and current row), 6) as forward,
round(first_value(value ignore nulls) over (partition by series order by date rows between current row and unbounded following), 6) as backward,
round(coalesce(last_value(value ignore nulls) over (partition by series order by date rows between unbounded preceding and current row), first_value(value ignore nulls) over (partition by series order by date rows between current row and unbounded following)), 6) as "both" from panel_gaps""")
def _(spark, d):
    return cleaning.fill(panel_gaps(spark, d)).select("series", "date", *rounded("forward", "backward", "both"))


@query("fill_time_linear", f"""{G}, n as (select *,
 last_value(case when value is not null then date end ignore nulls) over (partition by series order by date rows between unbounded preceding and current row) as d0,
 last_value(value ignore nulls) over (partition by series order by date rows between unbounded preceding and current row) as v0,
 first_value(case when value is not null then date end ignore nulls) over (partition by series order by date rows between current row and unbounded following) as d1,
 first_value(value ignore nulls) over (partition by series order by date rows between current row and unbounded following) as v1 from panel_gaps)
select series, date, round(coalesce(value, v0 + (v1 - v0) * (date - d0)::double / nullif(d1 - d0, 0), v0, v1), 6) as filled from n""")
def _(spark, d):
    return cleaning.fill_time(panel_gaps(spark, d)).select("series", "date", *rounded("filled"))


@query("lag_lead_changes", f"{M} select series, date, round(lag(value, 3) over {W}, 6) as lagged, round(lead(value, 3) over {W}, 6) as ahead, round(value - lag(value, 3) over {W}, 6) as difference, round(value / nullif(lag(value, 3) over {W}, 0) - 1, 6) as growth from panel_m")
def _(spark, d):
    return cleaning.changes(panel_m(spark, d), 3).select("series", "date", *rounded("lagged", "ahead", "difference", "growth"))


@query("lead_sum_outcome", f"{M} select series, date, round(lead(value, 4) over {W}, 6) as at_horizon, round(case when count(value) over (partition by series order by date rows between 1 following and 3 following) = 3 then sum(value) over (partition by series order by date rows between 1 following and 3 following) end, 6) as cumulative, round(lag(value, 2) over {W}, 6) as placebo from panel_m")
def _(spark, d):
    return cleaning.lead_outcome(panel_m(spark, d), 4, 3, 2).select("series", "date", *rounded("at_horizon", "cumulative", "placebo"))


@query("lagged_controls", f"{M}, s as (select *, (month(date) - 1) % 3 + 1 as slot from panel_m) select series, slot, date, round(lag(value) over (partition by series, slot order by date), 6) as lagged from s")
def _(spark, d):
    rows = panel_m(spark, d).withColumn("slot", (F.month("date") - 1) % 3 + 1)
    return rows.select("series", F.col("slot").cast("long").alias("slot"), "date", F.round(F.lag("value").over(Window.partitionBy("series", "slot").orderBy("date")), 6).alias("lagged"))


@query("standardize", f"{M}, b as (select series, avg(value) m, stddev_samp(value) s from panel_m group by series) select series, date, round((value - m) / nullif(s, 0), 6) as standardized from panel_m join b using (series)")
def _(spark, d):
    return cleaning.standardize(panel_m(spark, d)).select("series", "date", *rounded("standardized"))


@query("scale_exog_independent", f"{G}, b as (select series, avg(value) m, stddev_pop(value) s from panel_gaps group by series) select series, date, round(case when s > 1e-12 then (value - m) / s end, 6) as standardized from panel_gaps join b using (series)")
def _(spark, d):
    return cleaning.standardize(panel_gaps(spark, d), sample=False, floor=1e-12).select("series", "date", *rounded("standardized"))


@query("binarize_quantile", f"{M}, b as (select series, quantile_cont(value, 0.75) q from panel_m group by series) select series, date, case when value >= q then 1 else 0 end as flag from panel_m join b using (series)")
def _(spark, d):
    panel = panel_m(spark, d)
    cut = panel.groupBy("series").agg(F.percentile("value", F.lit(0.75)).alias("q"))
    return panel.join(cut, "series").select("series", "date", (F.col("value") >= F.col("q")).cast("int").alias("flag"))


@query("stationary_basic", f"""{M}, p as (select series, min(value) > 0 as pos from panel_m group by series)
select series, date, round(value - lag(value) over {W}, 6) as difference, round(ln(greatest(value, 1e-8)) - lag(ln(greatest(value, 1e-8))) over {W}, 6) as log_difference,
round(case when pos then ln(greatest(value, 1e-8)) - lag(ln(greatest(value, 1e-8))) over {W} else value - lag(value) over {W} end, 6) as auto from panel_m join p using (series)""")
def _(spark, d):
    return cleaning.stationary(panel_m(spark, d)).select("series", "date", *rounded("difference", "log_difference", "auto"))


@query("roundtrip_check", f"{M}, t as (select *, ln(value) - lag(ln(value)) over {W} as ld, first_value(value) over {W} as v0 from panel_m where value > 0), r as (select *, v0 * exp(sum(coalesce(ld, 0)) over {W}) as restored from t) select series, count(*) as n, case when max(abs(restored - value)) < 1e-6 then 'pass' else 'fail' end as status from r group by series")
def _(spark, d):
    moved = cleaning.stationary(panel_m(spark, d).filter("value > 0"))
    back = cleaning.invert_stationary(moved)
    return back.groupBy("series").agg(F.count("*").alias("n"), F.when(F.max(F.abs(F.col("restored") - F.col("value"))) < 1e-6, "pass").otherwise("fail").alias("status"))


@query("yeo_johnson", f"{M} select series, date, round((pow(value + 1, 0.5) - 1) / 0.5, 6) as transformed, round(value, 6) as restored, round(ln(value + 1), 6) as log_case, round(-ln(1 + value), 6) as mirrored from panel_m where value >= 0")
def _(spark, d):
    rows = panel_m(spark, d).filter("value >= 0").withColumn("y", yeo_johnson(F.col("value"), 0.5))
    return rows.select("series", "date", F.round("y", 6).alias("transformed"), F.round(yeo_johnson_inverse(F.col("y"), 0.5), 6).alias("restored"), F.round(yeo_johnson(F.col("value"), 0.0), 6).alias("log_case"), F.round(yeo_johnson(-F.col("value"), 2.0), 6).alias("mirrored"))


@query("ema", f"""with recursive {PANEL_GAPS}, r as (select *, row_number() over {W} as i from panel_gaps),
e(series, i, date, value, ema) as (select series, i, date, value, value from r where i = 1 union all
 select r.series, r.i, r.date, r.value, case when r.value is null then e.ema when e.ema is null then r.value else 2.0 / 5 * r.value + (1 - 2.0 / 5) * e.ema end from e join r on r.series = e.series and r.i = e.i + 1)
select series, date, round(value, 6) as value, round(ema, 6) as ema from e""")
def _(spark, d):
    return cleaning.ema(panel_gaps(spark, d), 4).select("series", "date", *rounded("value", "ema"))


@query("persistence_diagnostics", f"""{G}, h as (select series, date, value, lag(value) over {W} as b, (date - lag(date) over {W}) / 30.4375 as gap from panel_gaps where value is not null),
s as (select series, quantile_cont(gap, 0.5) mg, case when count(b) >= 10 then corr(b, value) end as ac, var_pop(value - b) / nullif(var_pop(value), 0) as dr, quantile_cont(value - b, 0.75) - quantile_cont(value - b, 0.25) as iqr from h group by series)
select series, round(mg, 6) as median_gap, round(ac, 6) as autocorrelation, round(dr, 6) as difference_ratio, round(iqr, 6) as difference_iqr, round(os, 6) as observed_share from s join (select series, count(value)::double / count(*) as os from panel_gaps group by series) using (series)""")
def _(spark, d):
    return cleaning.persistence(panel_gaps(spark, d)).select("series", *rounded("median_gap", "autocorrelation", "difference_ratio", "difference_iqr", "observed_share"))


@query("pick_diff_order", f"""{M}, h as (select series, value, lag(value) over {W} as b from panel_m), s as (select series, corr(b, value) as ac, var_pop(value - b) / nullif(var_pop(value), 0) as dr from h group by series)
select series, case when ac is null then 0 when ac >= 0.95 or dr < 0.2 then 1 when ac >= 0.8 and dr < 0.5 then 1 else 0 end as diff_order from s""")
def _(spark, d):
    rows = cleaning.persistence(panel_m(spark, d))
    ac, dr = F.col("autocorrelation"), F.col("difference_ratio")
    order = F.when(ac.isNull(), 0).when((ac >= 0.95) | (dr < 0.2), 1).when((ac >= 0.8) & (dr < 0.5), 1).otherwise(0)
    return rows.select("series", order.alias("diff_order"))


def _resample_sql(period: str) -> str:
    return f"{D} select series, {period} as period, round(sum(value), 5) as total, round(avg(value), 6) as mean, round(arg_min(value, date), 6) as \"first\", round(arg_max(value, date), 6) as \"last\" from panel_d where value is not null group by series, 2"


for _freq, _period in (("W", "date_trunc('week', date)::date + 6"), ("M", "last_day(date)"), ("Q", "last_day((date_trunc('quarter', date) + interval 2 month)::date)"), ("Y", "make_date(year(date), 12, 31)")):

    @query(f"resample_{_freq.lower()}", _resample_sql(_period))
    def _(spark, d, freq=_freq):
        return calendar.resample(panel_d(spark, d), freq).select("series", "period", F.round("total", 5).alias("total"), *rounded("mean", "first", "last"))


QEND = "last_day((date_trunc('quarter', date) + interval 2 month)::date)"


@query("stack_umidas", f"{M} select series, {QEND} as quarter_end, " + ", ".join(f"round(max(case when (month(date) - 1) % 3 + 1 = {k} then value end), 6) as m{k}" for k in (1, 2, 3)) + " from panel_m group by series, 2")
def _(spark, d):
    return calendar.stack_months(panel_m(spark, d)).select("series", "quarter_end", *rounded("m1", "m2", "m3"))


@query("selective_stack", f"""{G}, h as (select * from panel_gaps where value is not null), k as (select series, count(*) / (datediff('quarter', min(date), max(date)) + 1) >= 2.5 as dense from h group by series),
s as (select series, case when dense then (month(date) - 1) % 3 + 1 else 0 end::integer as slot, {QEND} as quarter_end, value from h join k using (series))
select series, slot, quarter_end, round(avg(value), 6) as value from s group by all""")
def _(spark, d):
    out = calendar.selective_stack(panel_gaps(spark, d), 2.5)
    return out.select("series", F.col("slot").cast("int").alias("slot"), "quarter_end", *rounded("value"))


LOW = f"low as (select series, {QEND} as date, sum(value) as value from panel_m group by series, 2)"


@query("low_to_monthly", f"""{M}, {LOW}, g as (select series, last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month))::date) as date from (select series, min(date) lo, max(date) hi from low group by series))
select series, date, round(value, 6) as value, round(last_value(value ignore nulls) over (partition by series order by date rows between unbounded preceding and current row), 6) as carried from g left join low using (series, date)""")
def _(spark, d):
    low = panel_m(spark, d).groupBy("series", calendar.quarter_end(F.col("date")).alias("date")).agg(F.sum("value").alias("value"))
    return calendar.low_to_monthly(low).select("series", "date", *rounded("value", "carried"))


@query("quarterly_sparse", f"""{M}, {LOW}, g as (select series, last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month))::date) as date from (select series, min(date) lo, max(date) hi from panel_m group by series))
select series, date, round(value, 6) as quarterly from g left join low using (series, date)""")
def _(spark, d):
    return calendar.quarterly_sparse(panel_m(spark, d)).select("series", "date", *rounded("quarterly"))


@query("coarse_freq_infer", f"""{M}, u as (select 'm:' || series as series, date from panel_m union all select 'q:' || series, date from (select series, {QEND} as date from panel_m group by all) union all select 'd:' || o_orderpriority, o_orderdate::date from orders group by all),
g as (select series, date - lag(date) over (partition by series order by date) as gap from u), s as (select series, quantile_cont(gap::double, 0.5) as median_gap from g group by series)
select series, median_gap, case when median_gap between 0.5 and 2 then 'd' when median_gap between 5 and 9 then 'w' when median_gap between 26 and 32 then 'm' when median_gap between 80 and 100 then 'q' else 'unknown' end as freq from s""")
def _(spark, d):
    monthly = panel_m(spark, d)
    quarterly = monthly.select("series", calendar.quarter_end(F.col("date")).alias("date")).distinct()
    tagged = [p.select(F.concat(F.lit(t), "series").alias("series"), "date") for t, p in (("m:", monthly), ("q:", quarterly), ("d:", panel_d(spark, d)))]
    return calendar.frequency(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]))


@query("saar_adjust", f"""{M} select series, date, round(case when series = '1-URGENT' then value / 12 when series = '2-HIGH' then value / 4 else value end, 6) as adjusted from panel_m""")
def _(spark, d):
    panel = panel_m(spark, d)
    meta = panel.select("series").distinct().withColumn("freq", F.when(F.col("series") == "1-URGENT", "m").when(F.col("series") == "2-HIGH", "q"))
    factor = F.when(F.col("freq") == "q", 4.0).when(F.col("freq") == "m", 12.0).otherwise(1.0)
    return panel.join(meta, "series").select("series", "date", F.round(F.col("value") / factor, 6).alias("adjusted"))


@query("date_window_drop_window", f"{M} select series, date, value from panel_m where date between date '1996-01-01' and date '2000-12-31' and not date between date '1998-01-01' and date '1998-12-31'")
def _(spark, d):
    inside = F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    episode = F.col("date").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return panel_m(spark, d).filter(inside & ~episode).select("series", "date", "value")


@query("derive_expression", f"""with {PANEL_GAPS}, w as (select date, max(case when series = '1-URGENT' then value end) as a, max(case when series = '2-HIGH' then value end) as b from panel_gaps group by date)
select date, round(a + b * 2 - 3, 6) as lin, round(a / nullif(b, 0), 6) as ratio, round(case when a > 0 then ln(a) end, 6) as log_a, round(a - lag(a) over (order by date), 6) as diff_a, round(avg(b) over (order by date rows between 2 preceding and current row), 6) as ma_b, round(pow(a, 2), 6) as sq, round(coalesce(a, 0), 6) as filled from w""")
def _(spark, d):
    wide = panel_gaps(spark, d).groupBy("date").pivot("series", ["1-URGENT", "2-HIGH"]).agg(F.max("value")).select("date", F.col("1-URGENT").alias("a"), F.col("2-HIGH").alias("b"))
    w = Window.orderBy("date")  # one aligned wide panel: a row for each date
    a, b = F.col("a"), F.col("b")
    return wide.select("date", F.round(a + b * 2 - 3, 6).alias("lin"), F.round(F.try_divide(a, b), 6).alias("ratio"), F.round(safe_ln(a), 6).alias("log_a"), F.round(a - F.lag(a).over(w), 6).alias("diff_a"), F.round(F.avg(b).over(w.rowsBetween(-2, 0)), 6).alias("ma_b"), F.round(F.pow(a, F.lit(2.0)), 6).alias("sq"), F.round(F.coalesce(a, F.lit(0.0)), 6).alias("filled"))


@query("derived_series_ops", f"""with {PANEL_GAPS}, w as (select date, max(case when series = '1-URGENT' then value end) as a, max(case when series = '2-HIGH' then value end) as b, max(case when series = '3-MEDIUM' then value end) as c from panel_gaps group by date)
select date, round(a - b, 6) as difference, round(a + b + c, 6) as total, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0), 6) as mean, round(a * b, 6) as product, round(a / nullif(c, 0), 6) as ratio from w""")
def _(spark, d):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    wide = panel_gaps(spark, d).groupBy("date").pivot("series", names).agg(F.max("value")).toDF("date", "a", "b", "c")
    parts = [F.col(x) for x in "abc"]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0))
    held = sum((x.isNotNull().cast("int") for x in parts), F.lit(0))
    a, b, c = parts
    return wide.select("date", F.round(a - b, 6).alias("difference"), F.round(a + b + c, 6).alias("total"), F.round(F.try_divide(total, held), 6).alias("mean"), F.round(a * b, 6).alias("product"), F.round(F.try_divide(a, c), 6).alias("ratio"))


CUTOFFS = "select unnest(generate_series(date '1995-03-31', date '2001-06-30', interval 3 month))"
QUARTERS = "q as (select distinct last_day((date_trunc('quarter', o_orderdate::date) + interval 2 month)::date) as quarter_end, date_trunc('quarter', o_orderdate::date)::date as cutoff from orders)"


def _cutoffs(spark, d):
    day = F.to_date("o_orderdate")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(calendar.quarter_end(day).alias("quarter_end"), calendar.quarter_start(day).alias("cutoff")).distinct()


@query("asof_lag_grid", f"""{D}, {QUARTERS}, l as (select 'd' as freq, unnest(range(1, 11)) as lag union all select 'w', unnest(range(1, 5)) union all select 'm', unnest(range(1, 4)) union all select 'q', unnest(range(1, 5))),
t as (select s.series, q.quarter_end, l.freq, l.lag::integer as lag, least(q.cutoff, case l.freq when 'd' then q.cutoff - l.lag::integer when 'w' then q.cutoff - 7 * l.lag::integer
 when 'm' then last_day((q.cutoff - to_months(l.lag::integer))::date) else last_day((date_trunc('quarter', q.cutoff) - to_months(3 * l.lag::integer) + interval 2 month)::date) end) as wanted from (select distinct series from panel_d) s, q, l)
select t.series, quarter_end, freq, lag, round(p.value, 6) as value, p.date as as_of from t asof left join panel_d p on t.series = p.series and t.wanted >= p.date""")
def _(spark, d):
    grid = calendar.lag_grid(panel_d(spark, d), _cutoffs(spark, d), {"d": 10, "w": 4, "m": 3, "q": 4})
    return grid.select("series", "quarter_end", "freq", "lag", *rounded("value"), "as_of")


@query("qend_values", f"""{D}, {QUARTERS}, t as (select series, quarter_end from (select distinct series from panel_d), q) select t.series, quarter_end, round(p.value, 6) as value, p.date as as_of from t asof left join panel_d p on t.series = p.series and t.quarter_end >= p.date""")
def _(spark, d):
    panel = panel_d(spark, d)
    targets = _cutoffs(spark, d).select("quarter_end", F.lit(0).alias("k")).join(panel.select("series").distinct().withColumn("k", F.lit(0)), "k").select("series", "quarter_end")
    return calendar.as_of(targets, panel, "quarter_end").select("series", "quarter_end", *rounded("value"), "as_of")


@query("event_cutoffs", f"""with {QUARTERS}, e as (select last_day((date_trunc('quarter', o_orderdate::date) + interval 2 month)::date) as quarter_end, min(o_orderdate::date) as event from orders where o_totalprice > 350000 and month(o_orderdate) % 3 <> 1 group by 1)
select q.quarter_end, coalesce(e.event - 5, q.cutoff) as cutoff_date, (e.event is null)::integer as missed from q left join e using (quarter_end)""")
def _(spark, d):
    day = F.to_date("o_orderdate")
    orders = spark.read.parquet(f"{d}/orders.parquet").filter((F.col("o_totalprice") > 350000) & (F.month(day) % 3 != 1))
    events = orders.groupBy(calendar.quarter_end(day).alias("quarter_end")).agg(F.min(day).alias("event"))
    return _cutoffs(spark, d).join(events, "quarter_end", "left").select("quarter_end", F.coalesce(F.date_sub("event", 5), F.col("cutoff")).alias("cutoff_date"), F.col("event").isNull().cast("int").alias("missed"))


@query("align_inner", f"""with {PANEL_GAPS}, a as (select * from panel_gaps where value is not null), l as (select series, date, value - lag(value) over {W} as tf from panel_m)
select a.series, a.date, round(a.value, 6) as level, round(l.tf, 6) as transformed, (month(a.date) = 12)::integer as dummy from a join l on a.series = l.series and a.date = l.date where l.tf is not null""")
def _(spark, d):
    levels = panel_gaps(spark, d).filter("value is not null").withColumnRenamed("value", "level")
    moved = cleaning.changes(panel_m(spark, d)).filter("difference is not null").select("series", "date", F.col("difference").alias("transformed"))
    dummy = panel_m(spark, d).select("date", (F.month("date") == 12).cast("int").alias("dummy")).distinct()
    return levels.join(moved, ["series", "date"]).join(dummy, "date").select("series", "date", *rounded("level", "transformed"), "dummy")


@query("missingness_filter", f"""{G}, l as (select series, date, k, lag(value, k) over (partition by series, k order by date) as v from panel_gaps, (select unnest([1, 6, 12]) as k)), m as (select series, k, avg((v is null)::int) as share from l group by all)
select series, k::integer as lag, count(*) as n, count(v) as present from l join m using (series, k) where share <= 0.25 group by all""")
def _(spark, d):
    panel = panel_gaps(spark, d)
    w = Window.partitionBy("series").orderBy("date")
    wide = panel.select("series", "date", *[F.lag("value", k).over(w).alias(f"v{k}") for k in (1, 6, 12)])
    lags = wide.select("series", "date", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"v{k}").alias("v")) for k in (1, 6, 12)])).alias("x")).select("series", "date", "x.lag", "x.v")
    kept = lags.groupBy("series", "lag").agg(F.avg(F.col("v").isNull().cast("int")).alias("share")).filter("share <= 0.25")
    return lags.join(kept, ["series", "lag"], "left_semi").groupBy("series", "lag").agg(F.count("*").alias("n"), F.count("v").alias("present"))


@query("blocked_folds", f"{M} select series, date, ntile(5) over {W} as fold from panel_m")
def _(spark, d):
    return panel_m(spark, d).select("series", "date", F.ntile(5).over(Window.partitionBy("series").orderBy("date")).alias("fold"))


@query("edge_fill_target_range", f"""{G}, g as (select series, last_day(unnest(generate_series(date '1994-10-01', date '2001-12-01', interval 1 month))::date) as date from (select distinct series from panel_gaps)),
j as (select g.series, g.date, p.value from g left join panel_gaps p using (series, date)), f as (select series, arg_min(value, date) as v0, arg_max(value, date) as v1, min(date) as d0, max(date) as d1 from panel_gaps where value is not null group by series)
select series, date, round(case when date < d0 then v0 when date > d1 then v1 else value end, 6) as value from j join f using (series)""")
def _(spark, d):
    panel = panel_gaps(spark, d)
    held = panel.filter("value is not null").groupBy("series").agg(F.min_by("value", "date").alias("v0"), F.max_by("value", "date").alias("v1"), F.min("date").alias("d0"), F.max("date").alias("d1"))
    months = F.sequence(F.lit("1994-10-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))
    grid = held.select("*", F.explode(months).alias("start")).withColumn("date", F.last_day("start")).join(panel, ["series", "date"], "left")
    filled = F.when(F.col("date") < F.col("d0"), F.col("v0")).when(F.col("date") > F.col("d1"), F.col("v1")).otherwise(F.col("value"))
    return grid.select("series", "date", F.round(filled, 6).alias("value"))


@query("pro_rata_benchmark", f"""{M}, low as (select series, {QEND} as quarter_end, sum(value) * 1.1 as total from panel_m group by all), s as (select series, date, {QEND} as quarter_end, value * (1 + (month(date) % 3) / 10.0) as value from panel_m)
select series, date, round(value * total / sum(value) over (partition by series, quarter_end), 6) as scaled from s join low using (series, quarter_end)""")
def _(spark, d):
    panel = panel_m(spark, d)
    low = panel.groupBy("series", calendar.quarter_end(F.col("date")).alias("quarter_end")).agg((F.sum("value") * 1.1).alias("total"))
    seed = panel.withColumn("value", F.col("value") * (1 + (F.month("date") % 3) / 10.0))
    return calendar.pro_rata(low, seed).select("series", "date", *rounded("scaled"))


@query("rolling_pair_windows", f"""{N}, p as (select a.series as left_series, b.series as right_series, a.date, a.value as x, b.value as y from panel_nation a join panel_nation b on a.date = b.date and a.series < b.series),
w as (select *, count(*) over r as n, sum(x) over r as sx, sum(y) over r as sy, sum(x * x) over r as sxx, sum(y * y) over r as syy, sum(x * y) over r as sxy from p window r as (partition by left_series, right_series order by date rows between 23 preceding and current row))
select left_series, right_series, date, round((24 * sxy - sx * sy) / sqrt(nullif((24 * sxx - sx * sx) * (24 * syy - sy * sy), 0)), 5) as correlation from w where n = 24""")
def _(spark, d):
    panel = panel_nation(spark, d)
    a, b = panel.toDF("left_series", "date", "x"), panel.toDF("right_series", "date", "y")
    pairs = a.join(b, "date").filter("left_series < right_series")
    r = Window.partitionBy("left_series", "right_series").orderBy("date").rowsBetween(-23, 0)
    sums = {"n": F.count("*"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "syy": F.sum(F.col("y") * F.col("y")), "sxy": F.sum(F.col("x") * F.col("y"))}
    rows = pairs.withColumns({k: v.over(r) for k, v in sums.items()}).filter("n = 24")
    spread = F.expr("(24 * sxx - sx * sx) * (24 * syy - sy * sy)")
    return rows.select("left_series", "right_series", "date", F.round(F.expr("24 * sxy - sx * sy") / F.sqrt(F.when(spread != 0, spread)), 5).alias("correlation"))


@query("draw_quantiles", f"""{M}, r as (select *, row_number() over {W} - 1 as i from panel_m), n as (select series, count(*) as n from r group by series), b as (select r.series, r.date, r.i, d.draw, (((d.draw * 1103515245 + r.i * 12345) % 2147483648) % n.n) as j from r join n using (series), (select unnest(range(1, 21)) as draw) d)
select b.series, b.date, round(quantile_cont(r.value, 0.05), 6) as q05, round(quantile_cont(r.value, 0.5), 6) as q50, round(quantile_cont(r.value, 0.95), 6) as q95 from b join r on r.series = b.series and r.i = b.j group by all""")
def _(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    rows = panel_m(spark, d).withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy("series"))})
    draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long")))).withColumn("j", F.expr("((draw * 1103515245L + i * 12345L) % 2147483648L) % n"))
    from_rows = rows.select("series", F.col("i").alias("j"), F.col("value").alias("drawn"))
    q = F.percentile("drawn", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = draws.join(from_rows, ["series", "j"]).groupBy("series", "date").agg(q.alias("q"))
    return out.select("series", "date", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query("block_bootstrap", f"""{M}, r as (select *, row_number() over {W} - 1 as i from panel_m), n as (select series, count(*) as n from r group by series), b as (select r.series, r.date, d.draw, (((d.draw * 1103515245 + (r.i // 6) * 12345) % 2147483648) % (n.n - 5)) + r.i % 6 as j from r join n using (series), (select unnest(range(1, 6)) as draw) d where n.n >= 6)
select b.series, b.date, b.draw, round(r.value, 6) as value from b join r on r.series = b.series and r.i = b.j""")
def _(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    rows = panel_m(spark, d).withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy("series"))})
    draws = rows.filter("n >= 6").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).withColumn("j", F.expr("((draw * 1103515245L + (i div 6) * 12345L) % 2147483648L) % (n - 5) + i % 6"))
    from_rows = rows.select("series", F.col("i").alias("j"), F.col("value").alias("drawn"))
    return draws.join(from_rows, ["series", "j"]).select("series", "date", "draw", F.round("drawn", 6).alias("value"))


@query("evaluate_candidates", f"""{M}, c as (select series, date, value as truth, k.name, case k.name when 'naive' then lag(value) over (partition by series, k.name order by date) else avg(value) over (partition by series, k.name order by date rows between 3 preceding and 1 preceding) end as guess from panel_m, (select unnest(['naive', 'mean3']) as name) k),
e as (select series, name as candidate, avg(abs(guess - truth)) as mae, sqrt(avg((guess - truth) * (guess - truth))) as rmse, avg(case when abs(truth) > 1e-8 then abs((guess - truth) / truth) end) as mape, case when var_pop(truth) * count(*) > 1e-12 then 1 - sum((guess - truth) * (guess - truth)) / (var_pop(truth) * count(*)) end as r2 from c where guess is not null group by all)
select series, candidate, round(mae, 6) as mae, round(rmse, 6) as rmse, round(mape, 6) as mape, round(r2, 5) as r2, row_number() over (partition by series order by round(rmse, 9), candidate) as place, row_number() over (partition by series order by round(rmse, 9), candidate) = 1 as recommended from e""")
def _(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    wide = panel_m(spark, d).withColumns({"naive": F.lag("value").over(w), "mean3": F.avg("value").over(w.rowsBetween(-3, -1))})
    rows = wide.select("series", F.col("value").alias("truth"), F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), F.col(k).alias("guess")) for k in ("naive", "mean3")])).alias("c")).select("series", "truth", "c.*").filter("guess is not null")
    return evaluation.evaluate_candidates(rows, ["series"]).select("series", "candidate", *rounded("mae", "rmse", "mape"), F.round("r2", 5).alias("r2"), "place", "recommended")


@query("corr_matrix", f"""{N} select a.series as left_series, b.series as right_series, count(*) as n, round(corr(a.value, b.value), 6) as correlation from panel_nation a join panel_nation b on a.date = b.date and a.series < b.series group by all having count(*) >= 24""")
def _(spark, d):
    panel = panel_nation(spark, d)
    a, b = panel.toDF("left_series", "date", "x"), panel.toDF("right_series", "date", "y")
    return a.join(b, "date").filter("left_series < right_series").groupBy("left_series", "right_series").agg(F.count("*").alias("n"), F.round(corr("x", "y"), 6).alias("correlation")).filter("n >= 24")


@query("select_controls", f"""{N}, {PANEL_M}, s as (select m.series as treatment, n.series, var_samp(n.value) as v, abs(corr(n.value, m.value)) as c from panel_nation n join panel_m m using (date) group by all),
r as (select *, row_number() over (partition by treatment order by round(v, 9) desc, series) as rv, row_number() over (partition by treatment order by round(c, 9) desc, series) as rc from s),
h as (select *, row_number() over (partition by treatment, rc <= 4 order by round(v, 9) desc, series) + 4 as rest from r),
u as (select 'variance' as mode, treatment, series, v, c, rv as place from h union all select 'corr_t', treatment, series, v, c, rc from h union all select 'corr_t_then_variance', treatment, series, v, c, case when rc <= 4 then rc else rest end from h)
select mode, treatment, series, round(v, 6) as variance, round(c, 6) as abs_corr, place from u where place <= 8""")
def _(spark, d):
    panel, targets = panel_nation(spark, d), panel_m(spark, d).select(F.col("series").alias("treatment"), "date", F.col("value").alias("t"))
    modes = [selection.select_controls(panel, targets, 8, mode).withColumn("mode", F.lit(mode)) for mode in ("variance", "corr_t", "corr_t_then_variance")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2]).select("mode", "treatment", "series", *rounded("variance", "abs_corr"), "place")


@query("limiting_series", f"""{G}, f as (select series, min(date) as first_date from panel_gaps where value is not null and value > 1 group by series), p as (select a.series as left_series, b.series as right_series, greatest(a.first_date, b.first_date) as start, case when a.first_date >= b.first_date then a.series else b.series end as limiting from f a join f b on a.series < b.series)
select left_series, right_series, start, limiting, count(*) over (partition by limiting) as times from p""")
def _(spark, d):
    panel = panel_gaps(spark, d).filter("value > 1")
    names = panel.select("series").distinct()
    pairs = names.toDF("left_series").crossJoin(names.toDF("right_series")).filter("left_series < right_series")  # names only
    return selection.limiting_series(panel, pairs)


@query("write_panel", f"{G} select series, date, round(value, 3) as value from panel_gaps")
def _(spark, d):
    """The panel with gaps as it reads back from comma-separated files, a folder for each series."""
    path = shared_path(spark, "panel")
    selection.write_panel(panel_gaps(spark, d), path, digits=3, form="csv")
    return spark.read.option("header", "true").option("nullValue", "NA").schema("date date, value double, series string").csv(path).select("series", "date", "value")
