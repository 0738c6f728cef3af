"""Queries of disaggregation profiles by route."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import rounded
from macrotide.operators import policy
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_NATION, panel_nation

HOLDOUT, TAIL = 2, 6

RUNS = f"""with {PANEL_NATION}, ro as (select unnest([{{'route': 'Q->M', 'per': 3}}, {{'route': 'Y->M', 'per': 12}}], recursive := true)),
hm as (select route, per, series, date, value, case route when 'Q->M' then date_trunc('quarter', date) else date_trunc('year', date) end::date as block, (month(date) - 1) % per as slot from panel_nation, ro),
hl as (select route, per, series, block, sum(value) as low from hm group by all having count(*) = per),
hi as (select *, row_number() over (partition by route, series order by block desc) - 1 as back, count(*) over (partition by route, series) as n from hl),
vi as (select route, per, series, block, low, v as vintage from hi, (select unnest([0, {HOLDOUT}]) as v) where back >= v and n > v),
ms as (select vi.*, hm.date, hm.slot, hm.value, hm.value / low as share from vi join hm using (route, series, block)),
sh as (select *, avg(share) over (partition by route, series, vintage, slot) as own, first_value(share) over (partition by route, series, vintage, slot order by block desc) as latest from ms),
pa as (select *, unnest(['flat', 'history', 'latest']) as profile from sh), pt as (select *, case profile when 'flat' then low / per when 'history' then low * own else low * latest end as path from pa),
be as (select route, series, profile, avg(abs(made - low)) as benchmark_mae from (select route, series, profile, block, sum(path) as made, any_value(low) as low from pt where vintage = 0 group by all) group by all),
rg as (select route, series, profile, avg(abs(d)) / avg(abs(path)) as roughness_score from (select *, path - 2 * lag(path) over w + lag(path, 2) over w as d from pt where vintage = 0 window w as (partition by route, series, profile order by date)) group by all),
rv as (select route, series, profile, avg(off) as revision_risk_mae from (select a.route, a.series, a.profile, abs(a.path - b.path) as off, row_number() over (partition by a.route, a.series, a.profile order by a.date desc) as r from pt a join pt b using (route, series, profile, date) where a.vintage = {HOLDOUT} and b.vintage = 0) where r <= {TAIL} group by all),
sc as (select route, series, profile, sqrt(avg(pow(path - value, 2))) as score from pt where vintage = 0 group by all),
rn as (select s.route, s.profile, s.series as task, case when substr(s.series, 8)::int % 7 = 3 and s.profile = 'latest' then 'error' else 'ok' end as status, s.profile as selected_method, s.score as selected_score, 1 - s.score / f.score as improvement, benchmark_mae, roughness_score, revision_risk_mae
  from sc s join sc f on f.route = s.route and f.series = s.series and f.profile = 'flat' join be on be.route = s.route and be.series = s.series and be.profile = s.profile join rg on rg.route = s.route and rg.series = s.series and rg.profile = s.profile left join rv on rv.route = s.route and rv.series = s.series and rv.profile = s.profile),
su as (select route, profile, count(*) as n_rows, count(*) filter (status = 'ok') as n_evaluated, avg((status = 'error')::int) as failure_rate, quantile_cont(selected_score, 0.5) filter (status = 'ok') as median_selected_score, quantile_cont(benchmark_mae, 0.5) filter (status = 'ok') as median_benchmark_mae, quantile_cont(roughness_score, 0.5) filter (status = 'ok') as median_roughness,
  quantile_cont(revision_risk_mae, 0.5) filter (status = 'ok') as median_revision_risk_mae, quantile_cont(improvement, 0.5) filter (status = 'ok') as median_improvement, avg((selected_method <> 'flat')::int) filter (status = 'ok') as other_share from rn group by all)"""


def _summary(spark, d):
    """Three profiles of two routes for every nation: even shares of a low-frequency value, mean shares of its history, shares of the last one; each on the whole and on a shorter history."""
    panel = panel_nation(spark, d)
    routes = [("Q->M", 3, F.trunc("date", "quarter")), ("Y->M", 12, F.trunc("date", "year"))]
    months = reduce(lambda a, b: a.unionByName(b), [panel.select(F.lit(r).alias("route"), F.lit(per).alias("per"), "series", "date", "value", block.alias("block"), ((F.month("date") - 1) % per).alias("slot")) for r, per, block in routes])
    low = months.groupBy("route", "per", "series", "block").agg(F.sum("value").alias("low"), F.count("*").alias("held")).filter("held = per").drop("held", "per")
    dated = policy.vintages(low, ["route", "series"], "block", [0, HOLDOUT])
    rows = dated.join(months, ["route", "series", "block"]).withColumn("share", F.col("value") / F.col("low"))
    slot = Window.partitionBy("route", "series", "vintage", "slot")
    rows = rows.withColumns({"own": F.avg("share").over(slot), "latest": F.first("share").over(slot.orderBy(F.desc("block")))})
    profiles = [F.struct(F.lit(p).alias("profile"), v.alias("path")) for p, v in (("flat", F.col("low") / F.col("per")), ("history", F.col("low") * F.col("own")), ("latest", F.col("low") * F.col("latest")))]
    paths = rows.select("route", "series", "vintage", "block", "date", "value", F.explode(F.array(*profiles)).alias("p")).select("*", "p.*").drop("p")
    key, now = ["route", "series", "profile"], paths.filter("vintage = 0")
    scores = now.groupBy(*key).agg(F.sqrt(F.avg((F.col("path") - F.col("value")) * (F.col("path") - F.col("value")))).alias("score"))
    flat = scores.filter("profile = 'flat'").select("route", "series", F.col("score").alias("flat_score"))
    runs = scores.join(flat, ["route", "series"]).join(policy.benchmark_errors(now, low, key, "block", "date", "path", "low"), key).join(policy.roughness(now, key, "date", "path"), key)
    runs = runs.join(policy.revision_risk(paths, key, "date", "path", TAIL).drop("vintage"), key, "left")
    failed = (F.substring("series", 8, 9).cast("int") % 7 == 3) & (F.col("profile") == "latest")
    runs = runs.select("route", "profile", F.col("series").alias("task"), F.when(failed, "error").otherwise("ok").alias("status"), F.col("profile").alias("selected_method"), F.when(~failed, F.col("score")).alias("selected_score"), (1 - F.col("score") / F.col("flat_score")).alias("improvement"), "benchmark_mae", "roughness_score", "revision_risk_mae")
    return policy.profile_summary(runs, base="flat")


@query("interp_policy_routes", f"""{RUNS} select route, profile, n_rows, n_evaluated, round(failure_rate, 6) as failure_rate, round(median_selected_score, 6) as median_selected_score, round(median_benchmark_mae, 9) as median_benchmark_mae, round(median_roughness, 6) as median_roughness, round(median_revision_risk_mae, 6) as median_revision_risk_mae, round(median_improvement, 6) as median_improvement, round(other_share, 6) as other_share,
row_number() over (partition by route order by round(failure_rate, 12), n_evaluated desc, round(median_selected_score, 12), profile) as place from su""")
def _(spark, d):
    out = policy.rank_profiles(_summary(spark, d))
    return out.select("route", "profile", "n_rows", "n_evaluated", *rounded("failure_rate", "median_selected_score"), F.round("median_benchmark_mae", 9).alias("median_benchmark_mae"), *rounded("median_roughness", "median_revision_risk_mae", "median_improvement", "other_share"), "place")
