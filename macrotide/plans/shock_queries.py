"""Queries of shocks, components, instruments from loadings, control domains and cointegration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import rounded
from macrotide.operators import factors, screening, shocks, wide
from macrotide.plans.control_queries import _shocked
from macrotide.plans.regression_queries import _hac_sql, _pairs
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_M, PANEL_NATION, RESULTS, panel_m, panel_nation, results

N, M = f"with {PANEL_NATION}", f"with {PANEL_M}"
W = "(partition by series order by date)"
PRIORITIES = {"p1": "1-URGENT", "p2": "2-HIGH", "p3": "3-MEDIUM", "p4": "4-NOT SPECIFIED", "p5": "5-LOW"}


def _wide(spark, d):
    """(date, p1 .. p5): monthly order value of each priority."""
    cells = [F.max(F.when(F.col("series") == s, F.col("value"))).alias(c) for c, s in PRIORITIES.items()]
    return panel_m(spark, d).groupBy("date").agg(*cells)


def _design(spark, d):
    """(series, date, d, p1 .. p5, fold): each nation's monthly change, and the priorities' values of the month before."""
    w = Window.partitionBy("series").orderBy("date")
    wide = _wide(spark, d).withColumn("date", F.last_day(F.add_months("date", 1)))
    moves = panel_nation(spark, d).withColumns({"d": F.col("value") - F.lag("value").over(w), "fold": F.ntile(5).over(w)})
    return shocks.median_filled(moves.join(wide, "date", "left").select("series", "date", "d", "fold", *PRIORITIES), ["series"], list(PRIORITIES))


ATTEMPTS = [
    {"l1_ratio": 0.5, "rounds": 500},
    {"l1_ratio": 0.9, "rounds": 500},
    {"l1_ratio": 0.1, "rounds": 500},
    {"l1_ratio": 0.5, "rounds": 2000, "most": 2},
]


@query("shock_residual")
def _(spark, d):
    rows, xs = _design(spark, d), list(PRIORITIES)
    fits = shocks.shock_fits(rows, ["series"], "d", xs, "fold", ATTEMPTS[:1])
    return shocks.shock_residual(rows, ["series"], "d", fits, xs).select("series", "date", *rounded("d", "shock"))


@query("shock_attempt_grid")
def _(spark, d):
    fits = shocks.shock_fits(_design(spark, d), ["series"], "d", list(PRIORITIES), "fold", ATTEMPTS)
    return shocks.best_attempt(fits, ["series"]).select("series", "attempt", "n", "model", *rounded("penalty", "r2", "resid_var"), "converged", "passed")


@query("shock_top_predictors")
def _(spark, d):
    fits = shocks.shock_fits(_design(spark, d), ["series"], "d", list(PRIORITIES), "fold", ATTEMPTS[:1])
    return shocks.top_predictors(fits, ["series"], list(PRIORITIES)).select("series", "predictor", *rounded("coefficient"), "place")


def _domain_sql(name: str, x: str) -> str:
    return f"""(with f as (select series, avg(d) as md, avg({x}) as mx, regr_slope(d, {x}) as b from h group by series),
x as (select h.series, date, y, d - md - coalesce(b, 0) * ({x} - mx) as x from h join f using (series)), {_hac_sql('x', 'series', 'date', 3)}
select '{name}' as domain, *, beta / nullif(se, 0) as z from hac)"""


@query("domain_sensitivity", f"""{N}, t as (select date, value as d from panel_nation where series = 'NATION_0'),
r as (select series, date, value as y, d, lag(value) over {W} as c, month(date)::double as m from panel_nation join t using (date) where series <> 'NATION_0'), h as (select * from r where c is not null),
base as (with x as (select series, date, y, d as x from h), {_hac_sql('x', 'series', 'date', 3)} select 'none' as domain, *, beta / nullif(se, 0) as z from hac),
a as (select * from base union all select * from {_domain_sql('own', 'c')} union all select * from {_domain_sql('season', 'm')}),
p as (select *, row_number() over (partition by domain order by round(abs(z), 8) desc nulls last, series) as place from a), b as (select series, place as base_place from p where domain = 'none')
select domain, series, n, round(beta, 6) as beta, round(se, 6) as se, place, base_place, place - base_place as shift from p left join b using (series)""")
def _(spark, d):
    rows = _shocked(spark, d).filter("c is not null").withColumn("m", F.month("date").cast("double"))
    out = shocks.domain_sensitivity(rows, ["series"], "date", "y", "d", {"none": [], "own": ["c"], "season": ["m"]})
    return out.select("domain", "series", "n", *rounded("beta", "se"), *[F.col(c).cast("long").alias(c) for c in ("place", "base_place", "shift")])


@query("block_factor", f"""{N}, t as (select date, value as common from panel_nation where series = 'NATION_0'), r as (select series, date, value as own, common from panel_nation join t using (date) where series <> 'NATION_0'),
s as (select series, count(*) as n, avg(own) as mo, avg(common) as mc, stddev_pop(own) as so, stddev_pop(common) as sc, corr(own, common) as r from r group by series having count(*) > 2)
select series, date, round(((own - mo) / so + sign(r) * (common - mc) / sc) / sqrt(2), 5) as factor, round((1 + abs(r)) / 2, 5) as share from r join s using (series)""")
def _(spark, d):
    panel = panel_nation(spark, d)
    common = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("common"))
    rows = panel.filter("series <> 'NATION_0'").withColumnRenamed("value", "own").join(common, "date")
    fits = factors.components(rows, ["series"], ["own", "common"], most=1, anchor="own").filter("n > 2")
    scored = factors.component_scores(rows, ["series"], ["own", "common"], fits, most=1)
    return scored.join(fits.select("series", "share"), "series").select("series", "date", F.round("f1", 5).alias("factor"), F.round(F.col("share")[0], 5).alias("share"))


@query("exog_pca")
def _(spark, d):
    """Scores of the months on the components of the nations' values, as many as explain 60 % of the variance, five at most."""
    rows = wide.wide_rows(panel_nation(spark, d), whole=False)
    fits = wide.wide_components(rows.filter(~F.exists("w", lambda v: v.isNull())), [], threshold=0.6, most=5)
    return wide.wide_scores(rows, fits, []).select("date", *rounded(*[f"f{k}" for k in range(1, 6)], digits=5))


@query("bridge_nowcast")
def _(spark, d):
    low = panel_nation(spark, d).groupBy("series", F.date_sub(F.add_months(F.trunc("date", "quarter"), 3), 1).alias("quarter_end")).agg(F.sum("value").alias("total"))
    return factors.bridge_nowcast(_wide(spark, d), list(PRIORITIES), low).select("series", "date", "quarter_end", *rounded("bridged", "nowcast", digits=5))


@query("iv_candidates_from_loadings", f"""with {RESULTS}, {PANEL_NATION}, {PANEL_M}, irf as (select treatment, outcome as factor, horizon, estimate as beta, se, p from results where estimator = 'lp'),
l as (select m.series as factor, n.series as feature, corr(n.value, m.value) as loading from panel_nation n join panel_m m using (date) group by all),
s as (select *, abs(loading) / sum(abs(loading)) over (partition by feature) as factor_share, row_number() over (partition by factor order by round(abs(loading), 9) desc, feature) as r from l),
o as (select n.series as feature, abs(corr(n.value, y.value)) as outcome_corr from panel_nation n join panel_nation y using (date) where y.series = 'NATION_0' group by n.series having count(*) >= 20),
c as (select i.*, s.feature as candidate, round(loading, 9) as loading, factor_share, outcome_corr, abs(beta) / greatest(abs(se), 1e-8) * abs(round(loading, 9)) as score from irf i join s using (factor) join o using (feature) where p <= 0.3 and r <= 3 and feature <> 'NATION_0' and factor_share >= 0.1 and outcome_corr <= 0.9),
f as (select *, row_number() over (partition by treatment, candidate order by p, round(score, 8) desc, round(abs(loading), 8) desc, factor, horizon) as k from c),
q as (select *, row_number() over (partition by treatment order by p, round(score, 8) desc, round(abs(loading), 8) desc, factor, horizon, candidate) as place from f where k = 1)
select treatment, candidate, factor, horizon, round(p, 6) as p, round(loading, 6) as loading, case when loading >= 0 then 'positive' else 'negative' end as direction, round(factor_share, 6) as factor_share, round(outcome_corr, 6) as outcome_corr, round(score, 5) as score, place from q where place <= 5""")
def _(spark, d):
    nations = panel_nation(spark, d)
    irf = results(spark, d).filter("estimator = 'lp'").select("treatment", F.col("outcome").alias("factor"), "horizon", F.col("estimate").alias("beta"), "se", "p")
    loadings = nations.toDF("feature", "date", "x").join(panel_m(spark, d).select(F.col("series").alias("factor"), "date", "value"), "date").groupBy("factor", "feature").agg(F.round(F.corr("x", "value"), 9).alias("loading"))
    outcome = nations.filter("series = 'NATION_0'").select(F.col("series").alias("outcome"), "date", F.col("value").alias("y"))
    found = factors.candidates_from_loadings(irf, loadings, p_max=0.3, least_share=0.1, outcome_corr=factors.most_outcome_corr(nations, outcome), most_corr=0.9, blocked=["NATION_0"])
    return found.select("treatment", "candidate", "factor", "horizon", *rounded("p", "loading"), "direction", *rounded("factor_share", "outcome_corr"), F.round("score", 5).alias("score"), "place")


@query("rolling_cointegration", f"""{M}, l as (select series, date, value, lag(value) over {W} as before from panel_m),
p as (select a.series as driver, b.series as target, a.date, a.value as x, a.before as x1, b.value as y, b.before as y1, row_number() over (partition by a.series, b.series order by a.date) as i from l a join l b on a.date = b.date and a.series <> b.series where a.before is not null and b.before is not null),
w as (select e.driver, e.target, e.date, count(*) as n, regr_slope(m.y, m.x) as beta, regr_intercept(m.y, m.x) as a from p e join p m on e.driver = m.driver and e.target = m.target and m.i between e.i - 23 and e.i group by all having count(*) = 24),
r as (select w.*, m.y1 - a - beta * m.x1 as e1, m.y - m.y1 - beta * (m.x - m.x1) as de from w join p e using (driver, target, date) join p m on e.driver = m.driver and e.target = m.target and m.i between e.i - 23 and e.i),
t as (select driver, target, date, n, any_value(beta) as beta, sum(de * e1) / sum(e1 * e1) as speed, sum(e1 * e1) as ee, sum(de * de) as dd, sum(de * e1) as ed from r group by driver, target, date, n),
z as (select *, speed / sqrt((dd - speed * ed) / (n - 1) / ee) as t from t)
select driver, target, date, n, round(beta, 5) as beta, round(speed, 5) as speed, round(t, 4) as t, case when round(t, 6) <= -3.34 then 'cointegrated' when round(t, 6) <= -3.04 then 'weak' else 'none' end as regime from z""")
def _(spark, d):
    panel = panel_m(spark, d)
    out = screening.rolling_cointegration(panel, _pairs(panel).toDF("driver", "target"), 24)
    return out.select("driver", "target", "date", "n", *rounded("beta", "speed", digits=5), F.round("t", 4).alias("t"), "regime")
