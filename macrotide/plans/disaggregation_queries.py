"""Queries of indicator-based disaggregation and the choice between methods and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from macrotide.functions.columns import corr, rounded
from macrotide.operators import calendar, disaggregation
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_M, PANEL_NATION, panel_m, panel_nation

QEND = "last_day((date_trunc('quarter', date) + interval 2 month)::date)"
QUARTERS = f"""with {PANEL_NATION}, {PANEL_M}, i as (select {QEND} as block, sum(value) as indicator from panel_m group by 1),
t as (select series, {QEND} as block, sum(value) as total from panel_nation group by all), q as (select series, block, total, indicator from t join i using (block))"""
W, PAST = "(partition by series order by block)", "(partition by series order by block rows between unbounded preceding and 1 preceding)"


def _indicator(spark, d):
    """(block, date, indicator): order value of each month, with its quarter's end."""
    months = panel_m(spark, d).groupBy("date").agg(F.sum("value").alias("indicator"))
    return months.select(calendar.quarter_end(F.col("date")).alias("block"), "date", "indicator")


def _totals(spark, d):
    return panel_nation(spark, d).groupBy("series", calendar.quarter_end(F.col("date")).alias("block")).agg(F.sum("value").alias("total"))


def _quarters(spark, d):
    return _totals(spark, d).join(_indicator(spark, d).groupBy("block").agg(F.sum("indicator").alias("indicator")), "block")


def _low_high(spark, d):
    """The nations' totals of quarters that have all their months, and the indicator for each nation."""
    months = _indicator(spark, d)
    whole = months.groupBy("block").agg(F.count("*").alias("n")).filter("n = 3").select("block")
    low = _totals(spark, d).join(whole, "block", "left_semi")
    return low, low.select("series", "block").join(months, "block")


@query("denton_proportional_panel")
def _(spark, d):
    low, high = _low_high(spark, d)
    return disaggregation.denton_proportional(low, high, 3).select("series", "block", "date", *rounded("path", digits=5), "reason")


def _gls(method):
    def run(spark, d):
        low, high = _low_high(spark, d)
        return disaggregation.gls_disagg(low, high, 3, method).select("series", "block", "date", *rounded("path", digits=4), "reason", *rounded("rho"))

    return run


for name in ("chow_lin", "litterman", "fernandez"):
    query(f"gls_disagg_{name}")(_gls(name))


@query("disagg_method_select", f"""{QUARTERS}, d as (select series, count(*) as n, corr(total, indicator) as corr, avg((indicator > 0)::int) as ratio_share, stddev_samp(total / indicator) / avg(total / indicator) as ratio_cv from q group by series),
h as (select *, row_number() over {W} as i, count(*) over (partition by series) as n, lag(total) over {W} as t1, lag(indicator) over {W} as z1, total - lag(total) over {W} as dt, indicator - lag(indicator) over {W} as dz,
  avg(total) over {PAST} as mt, avg(indicator) over {PAST} as mi, var_pop(indicator) over {PAST} as v, covar_pop(total, indicator) over {PAST} as c from q),
k as (select *, sum(dt * dz) over {PAST} / sum(dz * dz) over {PAST} as step from h), m as (select unnest(['denton', 'denton_proportional', 'chow_lin', 'fernandez', 'litterman']) as method),
g as (select series, total, method, case method when 'denton' then t1 when 'denton_proportional' then t1 * indicator / z1 when 'chow_lin' then mt + c / v * (indicator - mi) else t1 + step * dz end as guess from k, m where i > n - 4 and i > 3),
s as (select series, method, sqrt(avg((total - guess) * (total - guess))) as rmse from g group by all),
x as (select s.*, case when method = 'denton' then 'pass' when n < 8 then 'few_rows' when corr < case method when 'chow_lin' then 0.22 else 0.18 end then 'corr' when ratio_share < case method when 'chow_lin' then 0.5 else 0.45 end then 'ratio_share' when ratio_cv > case method when 'chow_lin' then 8 else 10 end then 'ratio_cv' else 'pass' end as gate from s join d using (series)),
b as (select series, min(rmse) filter (method = 'denton') as base_score from x where gate = 'pass' group by series),
o as (select *, row_number() over (partition by series order by round(rmse, 9), method) as r from x where gate = 'pass' and method <> 'denton'),
z as (select b.series, o.method, o.rmse, base_score, 1 - o.rmse / base_score as gain from b left join o on o.series = b.series and r = 1)
select series, case when gain >= 0.02 then method else 'denton' end as method, round(case when gain >= 0.02 then rmse else base_score end, 5) as score, round(base_score, 5) as base_score, round(gain, 5) as gain, case when method is null then 'base_only' when gain >= 0.02 then 'selected' else 'base_kept' end as outcome from z""")
def _(spark, d):
    quarters = _quarters(spark, d)
    ratio = F.col("total") / F.col("indicator")
    measures = quarters.groupBy("series").agg(F.count("*").alias("n"), corr("total", "indicator").alias("corr"), F.avg((F.col("indicator") > 0).cast("int")).alias("ratio_share"), F.try_divide(F.stddev_samp(ratio), F.avg(ratio)).alias("ratio_cv"))
    gated = disaggregation.method_gates(disaggregation.holdout_scores(quarters).join(measures, "series"))
    return disaggregation.select_method(gated).select("series", "method", *rounded("score", "base_score", "gain", digits=5), "outcome")


@query("method_panel_choose", f"""{QUARTERS}, v as (select var_samp(x) as variance from (select sum(value) as x from panel_m group by date)),
f as (select series, count(*) as n, corr(total, indicator) as corr, regr_slope(total, indicator) as b, regr_intercept(total, indicator) as a from q group by series), e as (select q.*, n, corr, total - a - b * indicator as e from q join f using (series)),
l as (select *, e * lag(e, 1) over {W} as p1, e * lag(e, 2) over {W} as p2, e * lag(e, 3) over {W} as p3, e * lag(e, 4) over {W} as p4 from e),
s as (select series, any_value(n) as n, any_value(corr) as corr, any_value(n) * (any_value(n) + 2) * (pow(sum(p1) / sum(e * e), 2) / (any_value(n) - 1) + pow(sum(p2) / sum(e * e), 2) / (any_value(n) - 2) + pow(sum(p3) / sum(e * e), 2) / (any_value(n) - 3) + pow(sum(p4) / sum(e * e), 2) / (any_value(n) - 4)) as q from l group by series),
r as (select *, corr * corr as r2, exp(-q / 2) * (1 + q / 2) as p, case when variance < 1e-8 then 'flat_indicator' when n < 8 then 'few_rows' when abs(corr) < 0.3 then 'corr' when corr * corr < 0.1 then 'r2' when exp(-q / 2) * (1 + q / 2) < 0.05 then 'residuals' end as reason from s, v)
select series, n, 1.0::double as coverage, round(corr, 5) as corr, round(r2, 5) as r2, round(q, 4) as q, round(p, 5) as p, reason, case when reason is null then 'primary' else 'secondary' end as path from r""")
def _(spark, d):
    quarters = _quarters(spark, d)
    variance = _indicator(spark, d).agg(F.var_samp("indicator").alias("variance"))
    spread = quarters.select("series").distinct().crossJoin(variance)  # one row
    out = disaggregation.choose_path(quarters, spread)
    return out.select("series", "n", "coverage", *rounded("corr", "r2", digits=5), F.round("q", 4).alias("q"), F.round("p", 5).alias("p"), "reason", "path")
