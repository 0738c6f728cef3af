"""Queries of designs, gates, mixed-frequency panels and estimator steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr, normal_p, rounded
from macrotide.operators import calendar, controls, evaluation, events, inference, wide
from macrotide.operators import recipes as recipe_operators
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_GAPS, PANEL_M, PANEL_NATION, RESULTS, normal_p_sql, panel_gaps, panel_m, panel_nation, results

QEND = "last_day((date_trunc('quarter', date) + interval 2 month)::date)"
R, N, M, G = f"with {RESULTS}", f"with {PANEL_NATION}", f"with {PANEL_M}", f"with {PANEL_GAPS}"
W = "(partition by series order by date)"
@query("tmle_target_step", f"""{N}, b as (select series, value as y, case when value >= avg(value) over (partition by series) then 1 else 0 end as q1, (month(date) % 2) as a, 0.3 + 0.4 * (quarter(date) / 4.0) as g from panel_nation),
e as (select unnest([0.01, 0.35, 0.45]) as eps), c as (select series, eps, y, a, least(greatest(g, eps), 1 - eps) as g, 1.0 * q1 as q from b, e),
h as (select *, a / g - (1 - a) / (1 - g) as hh from c), s as (select series, eps, sum(hh * (y - q)) / nullif(sum(hh * hh), 0) as step from h group by all)
select h.series, h.eps, count(*) as n, round(any_value(step), 6) as step, round(avg(step * (1 / g + 1 / (1 - g))), 6) as ate, round(pow(sum(abs(hh)), 2) / sum(hh * hh), 4) as ess from h join s on h.series = s.series and h.eps = s.eps group by h.series, h.eps""")
def _(spark, d):
    panel = panel_nation(spark, d)
    mean = panel.groupBy("series").agg(F.avg("value").alias("mean"))
    base = panel.join(mean, "series").select("series", F.col("value").alias("y"), (F.month("date") % 2).alias("a"), (0.3 + 0.4 * (F.quarter("date") / 4.0)).alias("g0"), (F.col("value") >= F.col("mean")).cast("double").alias("q"))
    rows = base.withColumn("eps", F.explode(F.array(*[F.lit(e) for e in (0.01, 0.35, 0.45)]))).withColumn("g", F.least(F.greatest("g0", "eps"), 1 - F.col("eps")))
    rows = rows.withColumn("h", F.col("a") / F.col("g") - (1 - F.col("a")) / (1 - F.col("g")))
    step = rows.groupBy("series", "eps").agg(F.try_divide(F.sum(F.expr("h * (y - q)")), F.sum(F.expr("h * h"))).alias("step"))
    return rows.join(step, ["series", "eps"]).groupBy("series", "eps").agg(F.count("*").alias("n"), F.round(F.first("step"), 6).alias("step"), F.round(F.avg(F.expr("step * (1 / g + 1 / (1 - g))")), 6).alias("ate"), F.round(F.pow(F.sum(F.abs("h")), F.lit(2)) / F.sum(F.expr("h * h")), 4).alias("ess"))


EPISODES = "select 'e97' as episode, date '1997-01-01' as lo, date '1997-12-31' as hi union all select 'e00', date '2000-01-01', date '2000-12-31'"


@query("episode_leaveout", f"""{N}, t as (select date, value as x from panel_nation where series = 'NATION_0'), r as (select p.series, p.date, value as y, x from panel_nation p join t using (date) where p.series <> 'NATION_0'), ep as ({EPISODES}),
f as (select series, regr_slope(y, x) as b, sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) as se from r group by series),
o as (select series, episode, count(*) as n, regr_slope(y, x) as b, sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) as se from r, ep where not date between lo and hi group by all)
select o.series, episode, n, round(o.b, 5) as beta, (sign(o.b) <> sign(f.b))::int as flip, (abs(f.b / f.se) > 1.645 and abs(o.b / o.se) <= 1.645)::int as loss from o join f using (series)""")
def _(spark, d):
    panel = panel_nation(spark, d)
    x = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("x"))
    rows = panel.filter("series <> 'NATION_0'").withColumnRenamed("value", "y").join(x, "date")
    episodes = rows.sparkSession.sql(EPISODES)
    se = F.sqrt((F.regr_syy("y", "x") - F.pow(F.regr_sxy("y", "x"), F.lit(2)) / F.regr_sxx("y", "x")) / (F.count("*") - 2) / F.regr_sxx("y", "x"))
    whole = rows.groupBy("series").agg(F.regr_slope("y", "x").alias("b0"), se.alias("se0"))
    out = rows.crossJoin(F.broadcast(episodes)).filter("not date between lo and hi").groupBy("series", "episode").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), se.alias("se")).join(whole, "series")
    return out.select("series", "episode", "n", F.round("b", 5).alias("beta"), (F.signum("b") != F.signum("b0")).cast("int").alias("flip"), ((F.abs(F.col("b0") / F.col("se0")) > 1.645) & (F.abs(F.col("b") / F.col("se")) <= 1.645)).cast("int").alias("loss"))


@query("recession_compare", f"""{N}, t as (select date, value as x, case when quarter(date) <= 2 then 1 else 0 end as s from panel_nation where series = 'NATION_0'), r as (select p.series, value as y, x, s from panel_nation p join t using (date) where p.series <> 'NATION_0'),
sp as (select series, regr_slope(y, x) filter (s = 1) as down, regr_slope(y, x) filter (s = 0) as up, regr_slope(y, x) as pooled from r group by series having count(*) filter (s = 1) >= 6 and count(*) filter (s = 0) >= 6) select series, round(down, 5) as down, round(up, 5) as up, round(down - up, 5) as gap, (sign(down) = sign(up))::int as same_direction, round(abs(down - up) - abs(pooled), 5) as gap_over_pooled from sp""")
def _(spark, d):
    panel = panel_nation(spark, d)
    t = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("x"), (F.quarter("date") <= 2).cast("int").alias("s"))
    rows = panel.filter("series <> 'NATION_0'").withColumnRenamed("value", "y").join(t, "date")
    slope = {k: F.regr_slope(F.when(F.col("s") == v, F.col("y")), F.when(F.col("s") == v, F.col("x"))) for k, v in (("down", 1), ("up", 0))}
    sp = rows.groupBy("series").agg(*[v.alias(k) for k, v in slope.items()], F.regr_slope("y", "x").alias("pooled"), F.count_if(F.col("s") == 1).alias("n1"), F.count_if(F.col("s") == 0).alias("n0")).filter("n1 >= 6 and n0 >= 6")
    return sp.select("series", *rounded("down", "up", digits=5), F.round(F.col("down") - F.col("up"), 5).alias("gap"), (F.signum("down") == F.signum("up")).cast("int").alias("same_direction"), F.round(F.abs(F.col("down") - F.col("up")) - F.abs("pooled"), 5).alias("gap_over_pooled"))


@query("factor_attach", f"{N}, f as (select {QEND} as quarter_end, arg_min(value, date) as factor from panel_nation where series = 'NATION_3' group by 1), q as (select series, {QEND} as quarter_end, sum(value) as outcome from panel_nation where series <> 'NATION_3' group by all) select series, quarter_end, round(outcome, 6) as outcome, round(factor, 6) as factor from q left join f using (quarter_end)")
def _(spark, d):
    panel = panel_nation(spark, d)
    q = calendar.quarter_end(F.col("date")).alias("quarter_end")
    factor = panel.filter("series = 'NATION_3'").groupBy(q).agg(F.min_by("value", "date").alias("factor"))
    return panel.filter("series <> 'NATION_3'").groupBy("series", q).agg(F.sum("value").alias("outcome")).join(factor, "quarter_end", "left").select("series", "quarter_end", *rounded("outcome", "factor"))


@query("mix_panel", f"{M}, q as (select {QEND} as date, sum(value) as quarterly from panel_m where series = '1-URGENT' group by 1), s as (select date, value as monthly from panel_m where series = '2-HIGH') select s.date, round(monthly, 6) as monthly, round(quarterly, 6) as sparse, round(last_value(quarterly ignore nulls) over (order by s.date rows between unbounded preceding and current row), 6) as dense from s left join q using (date)")
def _(spark, d):
    panel = panel_m(spark, d)
    low = panel.filter("series = '1-URGENT'").groupBy(calendar.quarter_end(F.col("date")).alias("date")).agg(F.sum("value").alias("sparse"))
    rows = panel.filter("series = '2-HIGH'").select("date", F.col("value").alias("monthly")).join(low, "date", "left")
    dense = F.last("sparse", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row for each month
    return rows.withColumn("dense", dense).select("date", *rounded("monthly", "sparse", "dense"))


@query("table_export", f"{G}, w as (select date, max(case when series = '1-URGENT' then value end) as a, max(case when series = '2-HIGH' then value end) as b from panel_gaps group by date), f as (select date, last_value(a ignore nulls) over (order by date rows between unbounded preceding and current row) as a, last_value(b ignore nulls) over (order by date rows between unbounded preceding and current row) as b from w) select date, round(a, 6) as a, round(b, 6) as b, round(ln(a) - lag(ln(a)) over (order by date), 6) as a_growth from f")
def _(spark, d):
    wide = panel_gaps(spark, d).groupBy("date").pivot("series", ["1-URGENT", "2-HIGH"]).agg(F.max("value")).toDF("date", "a", "b")
    w = Window.orderBy("date")  # one row for each month
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in "ab"})
    return filled.select("date", *rounded("a", "b"), F.round(F.ln("a") - F.lag(F.ln("a")).over(w), 6).alias("a_growth"))


@query("recipe_replay", f"""with {PANEL_NATION}, r as (select series, date, value, case when substr(series, 8)::int % 3 = 0 then 0.5 when substr(series, 8)::int % 3 = 1 then 0.0 end as lam, substr(series, 8)::int % 3 as d, substr(series, 8)::int % 2 as s, case when substr(series, 8)::int < 10 then 12 when substr(series, 8)::int < 20 then 6 else 1 end as period, substr(series, 8)::int % 4 as kind from panel_nation),
m as (select series, month(date) as month, avg(value) - any_value(mean) as part, avg(value) / any_value(mean) as factor from (select *, avg(value) over (partition by series) as mean from r) group by all),
a as (select r.series, date, d, s, greatest(period, 2) as p, case kind when 1 then value - part when 2 then value / factor else value end as x, lam from r join m on r.series = m.series and month(r.date) = m.month),
t as (select *, case when lam is null then x when x >= 0 then case when lam = 0 then ln(1 + x) else (sqrt(1 + x) - 1) / 0.5 end else -(pow(1 - x, 2 - lam) - 1) / (2 - lam) end as y from a),
o as (select *, case d when 0 then y when 1 then y - lag(y) over w else y - 2 * lag(y) over w + lag(y, 2) over w end as z from t window w as (partition by series order by date))
select series, date, round(case when s = 0 then z when p = 12 then z - lag(z, 12) over w when p = 6 then z - lag(z, 6) over w else z - lag(z, 2) over w end, 6) as replayed from o window w as (partition by series order by date)""")
def _(spark, d):
    """Recipes of three lambdas, orders and periods, and seasonal parts by month, taken off, divided by or left."""
    panel = panel_nation(spark, d)
    k = F.substring("series", 8, 9).cast("int")
    recipes = panel.select("series").distinct().select("series", F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 0.0).alias("lam"), (k % 3).alias("diff_order"), (k % 2).alias("seasonal_diff_order"), F.when(k < 10, 12).when(k < 20, 6).otherwise(1).alias("period"), F.when(k % 4 == 1, "additive").when(k % 4 == 2, "multiplicative").alias("adjustment"))
    month = Window.partitionBy("series", F.month("date"))
    mean = F.avg("value").over(Window.partitionBy("series"))
    parts = panel.select("series", "date", F.avg("value").over(month).alias("own"), mean.alias("mean")).join(recipes, "series")
    seasonal = parts.select("series", "date", F.when(F.col("adjustment") == "multiplicative", F.col("own") / F.col("mean")).otherwise(F.col("own") - F.col("mean")).alias("part"))
    return recipe_operators.replay(panel, recipes, seasonal).select("series", "date", *rounded("replayed"))


@query("null_draw_compile", f"{R}, h as (select treatment || '/' || outcome as hypothesis, treatment as family, max(abs(z)) as abs_t from results where estimator = 'lp' group by all), d as (select hypothesis, family, unnest(range(1, 6)) as draw from h union all select hypothesis, family, 1 from h) select distinct family, hypothesis, draw::integer as draw, round(3.5 * ('0x' || substr(md5(hypothesis || '|' || draw), 1, 8))::bigint::double / 4294967296.0, 6) as abs_t from d")
def _(spark, d):
    rows = results(spark, d).filter("estimator = 'lp'").select(F.concat_ws("/", "treatment", "outcome").alias("hypothesis"), F.col("treatment").alias("family")).distinct()
    draws = inference.null_draws(rows, 5, ["hypothesis"])
    return draws.unionByName(draws.filter("draw = 1")).dropDuplicates(["family", "hypothesis", "draw"]).select("family", "hypothesis", "draw", F.round("abs_t", 6).alias("abs_t"))


@query("pretrend_triage", f"{R}, c as (select treatment, outcome, max(abs(z)) as lead_t, avg((p < 0.1)::int) as fail_share, list_aggregate(list(horizon order by abs(z) desc, horizon)[1:3], 'string_agg', ',') as worst from results where estimator = 'lp' and horizon <= 4 group by all) select treatment, outcome, round(lead_t * (1 + fail_share), 6) as severity, worst from c")
def _(spark, d):
    rows = results(spark, d).filter("estimator = 'lp' and horizon <= 4")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("z")).alias("k"), "horizon"))), 1, 3)
    out = rows.groupBy("treatment", "outcome").agg((F.max(F.abs("z")) * (1 + F.avg((F.col("p") < 0.1).cast("int")))).alias("severity"), top.alias("top"))
    return out.select("treatment", "outcome", *rounded("severity"), F.array_join(F.transform("top", lambda x: x["horizon"].cast("string")), ",").alias("worst"))


@query("threshold_calibrate", f"{R}, s as (select estimator, treatment, count(*) as n, quantile_cont(abs(z), 0.9) as q from results group by all) select estimator, treatment, n, round(case when n < 20 then 1.96 else least(greatest(q, 1.0), 1.8) end, 6) as threshold from s")
def _(spark, d):
    s = results(spark, d).groupBy("estimator", "treatment").agg(F.count("*").alias("n"), F.percentile(F.abs("z"), F.lit(0.9)).alias("q"))
    return s.select("estimator", "treatment", "n", F.round(F.when(F.col("n") < 20, 1.96).otherwise(F.least(F.greatest("q", F.lit(1.0)), F.lit(1.8))), 6).alias("threshold"))


@query("question_grid", f"{R}, j as (select distinct treatment from results), o as (select distinct outcome from results), d as (select unnest(['event', 'did']) as design) select treatment, outcome, unnest([0, 1, 2, 4])::integer as horizon, design from j, o, d")
def _(spark, d):
    rows = results(spark, d)
    outcomes = rows.select("outcome").distinct()
    jobs = rows.select("treatment").distinct().crossJoin(outcomes)
    return jobs.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (0, 1, 2, 4)]))).withColumn("design", F.explode(F.array(F.lit("event"), F.lit("did"))))


@query("lp_drift_check", f"{R}, s as (select estimator, count(*) as n, avg((p < 0.1)::int) as share, quantile_cont(abs(estimate), 0.5) as median_effect from results group by estimator) select a.n - b.n as n_delta, round(a.share - b.share, 6) as share_delta, round(a.median_effect - b.median_effect, 6) as effect_delta, case when abs(a.share - b.share) > 0.1 then 'drift' else 'ok' end as status from s a, s b where a.estimator = 'lp' and b.estimator = 'dml'")
def _(spark, d):
    s = results(spark, d).groupBy("estimator").agg(F.count("*").alias("n"), F.avg((F.col("p") < 0.1).cast("int")).alias("share"), F.percentile(F.abs("estimate"), F.lit(0.5)).alias("e"))
    a, b = s.filter("estimator = 'lp'").toDF("x", "na", "sa", "ea"), s.filter("estimator = 'dml'").toDF("y", "nb", "sb", "eb")
    return a.crossJoin(b).select((F.col("na") - F.col("nb")).alias("n_delta"), F.round(F.col("sa") - F.col("sb"), 6).alias("share_delta"), F.round(F.col("ea") - F.col("eb"), 6).alias("effect_delta"), F.when(F.abs(F.col("sa") - F.col("sb")) > 0.1, "drift").otherwise("ok").alias("status"))


@query("interp_policy_scores", f"{G}, r as (select series, date, value, value - 2 * lag(value) over {W} + lag(value, 2) over {W} as d2 from panel_gaps), s as (select series, avg((value is null)::int) as failure_rate, quantile_cont(value, 0.5) as median_score, avg(abs(d2)) / nullif(avg(abs(value)), 0) as roughness from r group by series) select series, round(failure_rate, 6) as failure_rate, round(median_score, 6) as median_score, round(roughness, 6) as roughness, row_number() over (order by round(failure_rate, 8), round(roughness, 8), series) as place from s")
def _(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    rows = panel_gaps(spark, d).withColumn("d2", F.col("value") - 2 * F.lag("value").over(w) + F.lag("value", 2).over(w))
    s = rows.groupBy("series").agg(F.avg(F.col("value").isNull().cast("int")).alias("failure_rate"), F.percentile("value", F.lit(0.5)).alias("median_score"), F.try_divide(F.avg(F.abs("d2")), F.avg(F.abs("value"))).alias("roughness"))
    place = F.row_number().over(Window.orderBy(F.round("failure_rate", 8), F.round("roughness", 8), "series"))  # one row for each route
    return s.withColumn("place", place).select("series", *rounded("failure_rate", "median_score", "roughness"), "place")


@query("indicator_quality", f"""{M}, q as (select series, date_trunc('quarter', date)::date as block, sum(value) as v from panel_m group by all), r as (select y.series, z.series as indicator, y.block, y.v as y, z.v as z from q y join q z on y.block = z.block and y.series <> z.series),
o as (select *, row_number() over w as i, count(*) over g as n, y / z as ratio, z - lag(z) over w as dz, y - lag(y) over w as dy, quantile_cont(z, 0.5) over g as mid from r window w as (partition by series, indicator order by block), g as (partition by series, indicator)),
d as (select *, abs(z - mid) as off, greatest(2, n // 3) as tail from o), e as (select *, quantile_cont(off, 0.5) over (partition by series, indicator) as mad from d)
select series, indicator, count(*) as n, 1.0::double as coverage, 1 as rank, round(stddev_pop(z), 5) as strength, round(abs(corr(z, y)), 5) as corr, round(corr(dz, dy), 5) as growth_corr, 0.0::double as zero_share, round(avg((off / (1.4826 * mad) > 6)::int), 5) as outliers, round(max(off / (1.4826 * mad)), 4) as outlier_z, 1.0::double as ratio_share,
round(stddev_pop(ratio) / avg(ratio), 5) as ratio_cv, round(abs(quantile_cont(case when i > n - tail then ratio end, 0.5) - quantile_cont(case when i <= tail then ratio end, 0.5)) / quantile_cont(ratio, 0.5), 5) as ratio_drift, round(quantile_cont(ratio, 0.5), 5) as ratio_median from e group by series, indicator""")
def _(spark, d):
    """Every priority's quarters as an indicator of every other's."""
    q = panel_m(spark, d).groupBy("series", F.trunc("date", "quarter").alias("block")).agg(F.sum("value").alias("y"))
    rows = q.join(q.select(F.col("series").alias("indicator"), "block", F.col("y").alias("z")), "block").filter("series <> indicator")
    out = evaluation.indicator_quality(rows, ["series", "indicator"], "block", "y", ["z"])
    return out.select("series", "indicator", "n", "coverage", "rank", *rounded("strength", "corr", "growth_corr", digits=5), "zero_share", F.round("outliers", 5).alias("outliers"), F.round("outlier_z", 4).alias("outlier_z"), "ratio_share", *rounded("ratio_cv", "ratio_drift", "ratio_median", digits=5))


@query("lead_test", f"""{N}, t as (select date, value - lag(value) over w as s, lead(value) over w - value as s1, lead(value, 2) over w - lead(value) over w as s2 from panel_nation where series = 'NATION_0' window w as (order by date)),
p as (select series, date, value - lag(value) over {W} as y from panel_nation where series <> 'NATION_0'), r as (select series, y, s, s1, s2 from p join t using (date) where y is not null and s is not null and s1 is not null and s2 is not null),
a as (select series, count(*) as n, avg(y) as my, avg(s) as ms, avg(s1) as m1, avg(s2) as m2, regr_slope(y, s) as b0, regr_slope(s1, s) as b1, regr_slope(s2, s) as b2 from r group by series having count(*) > 12),
e as (select series, n, y - my - b0 * (s - ms) as ey, s1 - m1 - b1 * (s - ms) as e1, s2 - m2 - b2 * (s - ms) as f2 from r join a using (series)), c as (select series, sum(e1 * f2) / sum(e1 * e1) as g from e group by series),
z as (select series, any_value(n) as n, sum(ey * ey) as ssr, pow(sum(e1 * ey), 2) / sum(e1 * e1) + pow(sum((f2 - g * e1) * ey), 2) / sum(pow(f2 - g * e1, 2)) as gain from e join c using (series) group by series)
select series, n, round(gain / 2 / ((ssr - gain) / (n - 4)), 4) as f from z""")
def _(spark, d):
    panel = panel_nation(spark, d)
    w, one = Window.partitionBy("series").orderBy("date"), F.col("series") == "NATION_0"
    moves = panel.withColumn("move", F.col("value") - F.lag("value").over(w))
    shock = moves.filter(one).select("date", F.col("move").alias("s"), F.lead("move").over(w).alias("s1"), F.lead("move", 2).over(w).alias("s2"))
    rows = moves.filter(~one).select("series", "date", F.col("move").alias("y")).join(shock, "date")
    return controls.joint_test(rows, ["series"], "y", ["s"], ["s1", "s2"]).select("series", "n", F.round("f", 4).alias("f"))


@query("confirmatory_join", f"{R}, c as (select treatment, outcome, horizon, p, row_number() over (partition by treatment, outcome order by p, horizon) as r from results where estimator = 'lp'), k as (select treatment, outcome, min(p) as p_dml from results where estimator = 'dml' and horizon <= 3 group by all) select coalesce(c.treatment, k.treatment) as treatment, coalesce(c.outcome, k.outcome) as outcome, c.horizon as best_horizon, case when c.p < 0.05 and k.p_dml < 0.05 then 'A' when c.p < 0.05 or k.p_dml < 0.05 then 'B' else 'C' end as tier from (select * from c where r = 1) c full join k on c.treatment = k.treatment and c.outcome = k.outcome")
def _(spark, d):
    rows = results(spark, d)
    best = inference.latest(rows.filter("estimator = 'lp'"), ["treatment", "outcome"], [F.col("p"), F.col("horizon")]).select("treatment", "outcome", F.col("horizon").alias("best_horizon"), "p")
    contracts = rows.filter("estimator = 'dml' and horizon <= 3").groupBy("treatment", "outcome").agg(F.min("p").alias("p_dml"))
    a, b = F.col("p") < 0.05, F.col("p_dml") < 0.05
    tier = F.when(a & b, "A").when(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), "B").otherwise("C")
    return best.join(contracts, ["treatment", "outcome"], "full").select("treatment", "outcome", "best_horizon", tier.alias("tier"))


@query("factor_extract")
def _(spark, d):
    """Loadings of the nations' principal components: as many as explain 60 % of the variance, eight at most."""
    panel = panel_nation(spark, d)
    medians = panel.groupBy("series").agg(F.percentile("value", F.lit(0.5)).alias("middle"))
    grid = panel.select("series").distinct().crossJoin(panel.select("date").distinct()).join(panel, ["series", "date"], "left").join(medians, "series")
    filled = wide.wide_rows(grid.select("series", "date", F.coalesce("value", "middle", F.lit(0.0)).alias("value")))
    fits = wide.wide_components(filled, [], threshold=0.6, most=8)
    names = filled.agg(F.first("names").alias("names"))  # the same on every date
    loads = fits.select(F.posexplode(F.arrays_zip("loadings", "share")).alias("i", "c")).select((F.col("i") + 1).alias("factor"), F.col("c.share").alias("share"), F.posexplode("c.loadings").alias("j", "loading"))
    return loads.crossJoin(F.broadcast(names)).select(F.get("names", F.col("j")).alias("series"), "factor", *rounded("loading"), F.round("share", 6).alias("variance_share"))


def _events_sql(cut: float, name: str) -> str:
    """CTEs that end in <name>(series, i): the events of one threshold, at least four rows apart."""
    return f"""q{name} as (select series, quantile_cont(move, {cut}) as cut from c where move is not null group by series), x{name} as (select c.series, i, row_number() over (partition by c.series order by i) as k from c join q{name} using (series) where move >= cut),
g{name}(series, k, i, last) as (select series, k, i, i from x{name} where k = 1 union all select x.series, x.k, x.i, case when x.i - g.last >= 4 then x.i else g.last end from g{name} g join x{name} x on x.series = g.series and x.k = g.k + 1), {name} as (select distinct series, last as i from g{name})"""


def _path_sql(events: str, times: str) -> str:
    """Mean changes of (series, event_time) and their p."""
    return f"""(select *, {normal_p_sql('(effect / nullif(se, 0))')} as p from (select e.series, h.h as event_time, count(*) as n, avg(c.value - b.value) as effect, stddev_samp(c.value - b.value) / sqrt(count(*)) as se
from {events} e, (select unnest({times}) as h) h join c on c.series = e.series and c.i = e.i + h.h join c b on b.series = e.series and b.i = e.i - 1 group by all))"""


@query("id_diagnostics", f"""with recursive {PANEL_NATION}, c as (select series, date, row_number() over {W} as i, value, value - lag(value) over {W} as move from panel_nation), {_events_sql(0.8, 'ev')}, {_events_sql(0.7, 'lo')},
xpl as (select series, i - 6 as i, row_number() over (partition by series order by i) as k from ev where i > 6), gpl(series, k, i, last) as (select series, k, i, i from xpl where k = 1 union all select x.series, x.k, x.i, case when x.i - g.last >= 4 then x.i else g.last end from gpl g join xpl x on x.series = g.series and x.k = g.k + 1), pl as (select distinct series, last as i from gpl),
path as {_path_sql('ev', 'range(-3, 5)')}, pp as {_path_sql('pl', 'range(0, 1)')}, m as (select series, quantile_cont(effect, 0.5) as m from path where event_time >= 0 group by series),
f as (select series, min(p) filter (event_time < -1) as pretrend_p, count(*) filter (event_time >= 0) / 5 as overlap, avg((sign(effect) = sign(m) and abs(effect) >= 0.5 * abs(m))::int) filter (event_time >= 0) as stability from path left join m using (series) group by series),
j as (select coalesce(ev.series, lo.series) as series, count(ev.i) as n_events, count(lo.i) as n_looser, count_if(ev.i is not null and lo.i is not null) / count(*) as jaccard from ev full join lo on ev.series = lo.series and ev.i = lo.i group by 1 having count(ev.i) > 0),
z as (select j.*, pretrend_p, overlap, stability, pp.p as placebo_p from j left join f using (series) left join pp using (series))
select series, n_events, n_looser, round(jaccard, 6) as jaccard, round(pretrend_p, 5) as pretrend_p, round(placebo_p, 5) as placebo_p, round(overlap, 6) as overlap, round(stability, 6) as stability,
concat_ws(';', case when n_events < 8 then 'support' end, case when not coalesce(pretrend_p >= 0.05, false) then 'pretrend' end, case when not coalesce(placebo_p >= 0.05, false) then 'placebo' end, case when not coalesce(overlap >= 0.6, false) then 'depth' end, case when not coalesce(stability >= 0.6, false) then 'stable' end) as failed from z""")
def _(spark, d):
    panel = panel_nation(spark, d)
    found, looser = (events.select_events(panel, q, 4) for q in (0.8, 0.7))
    placebo = events.thinned(found.select("series", (F.col("i") - 6).alias("i")).filter("i > 0"), 4)
    rows, shifted = (events.event_panel(panel, e, -3, 4, -1) for e in (found, placebo))
    out = events.design_diagnostics(rows, shifted, found, looser, 4)
    return out.select("series", "n_events", "n_looser", *rounded("jaccard"), *rounded("pretrend_p", "placebo_p", digits=5), *rounded("overlap", "stability"), "failed")


@query("exog_sensitivity", f"{N}, b as (select date, max(case when series = 'NATION_0' then value end) as x, max(case when series = 'NATION_1' then value end) as y from panel_nation where series in ('NATION_0', 'NATION_1') group by date), c as (select series as control, count(*) as n, corr(x, y) as xy, corr(x, value) as xc, corr(y, value) as yc from panel_nation join b using (date) where series not in ('NATION_0', 'NATION_1') group by series), z as (select *, (xy - xc * yc) / sqrt(nullif((1 - xc * xc) * (1 - yc * yc), 0)) as r from c where n >= 50 and isfinite(xy) and isfinite(xc) and isfinite(yc)) select control, n, round(xy, 5) as plain, round(r, 5) as controlled, round({normal_p_sql('(r * sqrt((n - 3) / (1 - r * r)))')}, 5) as p from z")
def _(spark, d):
    panel = panel_nation(spark, d)
    base = panel.filter("series in ('NATION_0', 'NATION_1')").groupBy("date").agg(F.max(F.when(F.col("series") == "NATION_0", F.col("value"))).alias("x"), F.max(F.when(F.col("series") == "NATION_1", F.col("value"))).alias("y"))
    c = panel.filter("series not in ('NATION_0', 'NATION_1')").join(base, "date").groupBy(F.col("series").alias("control")).agg(F.count("*").alias("n"), corr("x", "y").alias("xy"), corr("x", "value").alias("xc"), corr("y", "value").alias("yc")).filter("n >= 50 and xy is not null and xc is not null and yc is not null")
    c = c.withColumn("r", F.expr("(xy - xc * yc) / sqrt(nullif((1 - xc * xc) * (1 - yc * yc), 0))"))
    return c.select("control", "n", F.round("xy", 5).alias("plain"), F.round("r", 5).alias("controlled"), F.round(normal_p(F.col("r") * F.sqrt((F.col("n") - 3) / (1 - F.col("r") * F.col("r")))), 5).alias("p"))
