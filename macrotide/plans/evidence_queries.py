"""Queries of driver responses in rolling windows, windows of two kinds, and the scores over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import rounded
from macrotide.functions.shipping import cut
from macrotide.operators import evidence
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_NATION, normal_p_sql, panel_nation

WIDTH, ALPHA = 24, 0.1


def _moves(panel):
    return panel.withColumn("value", F.col("value") - F.lag("value").over(Window.partitionBy("series").orderBy("date"))).filter("value is not null")


def _pairs(panel):
    """Every ordered pair of different series."""
    names = panel.select(F.col("series").alias("driver")).distinct()
    return names.crossJoin(names.withColumnRenamed("driver", "target")).filter("driver <> target")


def _slope_sql(target: str, driver: str) -> str:
    """Slope on the driver's lag, its variance and the residual's sum of squares, from centred moments of y, x, a (y before), b (x before)."""
    own = "a" if target == "y" else "b"
    det = "nullif(aa * bb - ab * ab, 0)"
    first, second = ("aa", "bb") if own == "b" else ("bb", "aa")
    other = "b" if own == "a" else "a"
    slope = f"((({'aa' if other == 'b' else 'bb'}) * {target}{other} - ab * {target}{own}) / {det})"
    own_slope = f"((({'bb' if other == 'b' else 'aa'}) * {target}{own} - ab * {target}{other}) / {det})"
    rss = f"({target}{target} - {own_slope} * {target}{own} - {slope} * {target}{other})"
    return f"{slope} as {driver}_coef, {rss} as {target}_left, {rss} / {WIDTH - 4} * {'aa' if other == 'b' else 'bb'} / {det} as {driver}_var"


M1 = WIDTH - 1
RESPONSES = f"""with {PANEL_NATION}, moves as (select series, date, value - lag(value) over (partition by series order by date) as v from panel_nation),
pr as (select b.series as driver, a.series as target, a.date, a.v as y, b.v as x, row_number() over (partition by b.series, a.series order by a.date) as i from moves a join moves b on a.date = b.date and a.series <> b.series where a.v is not null and b.v is not null),
lg as (select *, lag(y) over k as a, lag(x) over k as b from pr window k as (partition by driver, target order by date)),
wm as (select driver, target, date, i, var_pop(y) over f * {M1} as yy, var_pop(x) over f * {M1} as xx, var_pop(a) over f * {M1} as aa, var_pop(b) over f * {M1} as bb, covar_pop(a, b) over f * {M1} as ab,
  covar_pop(y, a) over f * {M1} as ya, covar_pop(y, b) over f * {M1} as yb, covar_pop(x, a) over f * {M1} as xa, covar_pop(x, b) over f * {M1} as xb, covar_pop(x, y) over f * {M1} as xy, stddev_samp(y) over g as sy, stddev_samp(x) over g as sx
  from lg window f as (partition by driver, target order by date rows between {WIDTH - 2} preceding and current row), g as (partition by driver, target order by date rows between {WIDTH - 1} preceding and current row)),
fit as (select *, {_slope_sql('y', 'd2t')}, {_slope_sql('x', 't2d')}, xy - (ya * (bb * xa - ab * xb) + yb * (aa * xb - ab * xa)) / nullif(aa * bb - ab * ab, 0) as cross_left from wm where i >= {WIDTH}),
resp as (select *, cross_left / sqrt(y_left * x_left) as r, {normal_p_sql('d2t_coef / sqrt(d2t_var)')} as d2t_p, {normal_p_sql('t2d_coef / sqrt(t2d_var)')} as t2d_p from fit)"""

SPEARMAN = """rk as (select e.driver, e.target, e.date, rank() over (partition by e.driver, e.target, e.date order by m.x) + (count(*) over (partition by e.driver, e.target, e.date, m.x) - 1) / 2 as rx,
  rank() over (partition by e.driver, e.target, e.date order by m.y) + (count(*) over (partition by e.driver, e.target, e.date, m.y) - 1) / 2 as ry
  from pr e join pr m on e.driver = m.driver and e.target = m.target and m.i between e.i - 23 and e.i where e.i >= 24),
sp as (select driver, target, date, corr(rx, ry) as spearman from rk group by all)"""


@query("driver_response", f"""{RESPONSES}, {SPEARMAN} select driver, target, date, 1 as lags, round(spearman, 5) as spearman, round(r, 5) as residual_corr, round(d2t_coef, 5) as driver_to_target_coef, round(sqrt(d2t_var), 5) as driver_to_target_se,
round(d2t_p, 5) as driver_to_target_p, round(d2t_coef * sx / sy, 5) as driver_to_target_std, round(sqrt(d2t_var) * sx / sy, 5) as driver_to_target_std_se, round(t2d_coef, 5) as target_to_driver_coef, round(sqrt(t2d_var), 5) as target_to_driver_se,
round(t2d_p, 5) as target_to_driver_p, round(t2d_coef * sy / sx, 5) as target_to_driver_std, round(sqrt(t2d_var) * sy / sx, 5) as target_to_driver_std_se from resp join sp using (driver, target, date)""")
def _(spark, d):
    panel = cut(panel_nation(spark, d))
    out = evidence.driver_response(_moves(panel), _pairs(panel), WIDTH, max_lags=1, choose=False)
    return out.select("driver", "target", "date", "lags", *rounded(*[c for c, t in out.dtypes if t == "double"], digits=5))


TIED = """lv as (select series, date, value, lag(value) over (partition by series order by date) as before from panel_nation),
cp as (select a.series as driver, b.series as target, a.date, a.value as x, a.before as x1, b.value as y, b.before as y1, row_number() over (partition by a.series, b.series order by a.date) as i from lv a join lv b on a.date = b.date and a.series <> b.series where a.before is not null and b.before is not null),
cw as (select e.driver, e.target, e.date, regr_slope(m.y, m.x) as beta, regr_intercept(m.y, m.x) as a from cp e join cp m on e.driver = m.driver and e.target = m.target and m.i between e.i - 23 and e.i group by all having count(*) = 24),
cr as (select cw.*, m.y1 - a - beta * m.x1 as e1, m.y - m.y1 - beta * (m.x - m.x1) as de from cw join cp e using (driver, target, date) join cp m on e.driver = m.driver and e.target = m.target and m.i between e.i - 23 and e.i),
ct as (select driver, target, date, any_value(beta) as beta, sum(de * e1) / sum(e1 * e1) as alpha, sum(e1 * e1) as ee, sum(de * de) as dd, sum(de * e1) as ed from cr group by driver, target, date),
cz as (select *, alpha / sqrt((dd - alpha * ed) / 23 / ee) as t from ct), tied as (select * from cz where round(t, 6) <= -3.34)"""
MODELS = f"""{RESPONSES}, {TIED},
models as (select driver, target, date, 'VECM' as model, null::double as r, {normal_p_sql('t')} as p, t, beta, alpha from tied
  union all select driver, target, date, 'VAR', r, d2t_p, r * sqrt(({WIDTH - 3}) / (1 - r * r)), null, null from resp anti join tied using (driver, target, date))"""


def _models(spark, d):
    panel = cut(panel_nation(spark, d))  # written once: pairs, levels and moves all read it
    return cut(evidence.model_windows(panel, _moves(panel), _pairs(panel), WIDTH, max_lags=1, choose=False))  # scores read the windows more than once


@query("model_windows", f"{MODELS} select driver, target, date, model, round(r, 5) as r, round(p, 5) as p, round(t, 4) as t, round(beta, 5) as beta, round(alpha, 5) as alpha from models")
def _(spark, d):
    return _models(spark, d).select("driver", "target", "date", "model", *rounded("r", "p", digits=5), F.round("t", 4).alias("t"), *rounded("beta", "alpha", digits=5))


def _side(model: str, sign: int) -> str:
    value, more = ("r", "") if model == "VAR" else ("beta", " and alpha < 0")
    return f"model = '{model}' and p <= {ALPHA} and {value} * {sign} > 0{more}"


@query("directional_score_v2", f"""{MODELS}, sc as (select driver, target, coalesce(nullif(quantile_cont(case when model = 'VECM' then abs(beta) end, 0.5), 0), 1) as scale from models group by all),
ev as (select *, greatest(1 - p / {ALPHA}, 0) as w, case when model = 'VAR' then least(abs(r), 1) else tanh(abs(beta) / greatest(scale, 0.001)) end as effect from models join sc using (driver, target)),
sd as (select driver, target, direction, count(*) as n, any_value(greatest(scale, 0.001)) as beta_scale, count(*) filter (model = 'VAR') as nv, count(*) filter (model = 'VECM') as nc,
  coalesce(sum(w) filter (model = 'VAR' and hit), 0) as wv, coalesce(sum(w * effect) filter (model = 'VAR' and hit), 0) as ev, coalesce(sum(w) filter (model = 'VECM' and hit), 0) as wc, coalesce(sum(w * effect) filter (model = 'VECM' and hit), 0) as ec
  from (select *, 'positive' as direction, coalesce(({_side('VAR', 1)}) or ({_side('VECM', 1)}), false) as hit from ev union all select *, 'negative', coalesce(({_side('VAR', -1)}) or ({_side('VECM', -1)}), false) from ev) group by all)
select driver, target, direction, n, round(coalesce(wv / nullif(nv, 0), 0), 5) as var_coverage, round(coalesce(ev / nullif(wv, 0), 0), 5) as var_strength, round(coalesce(wc / nullif(nc, 0), 0), 5) as vecm_coverage, round(coalesce(ec / nullif(wc, 0), 0), 5) as vecm_strength, round(beta_scale, 5) as beta_scale,
round(100 * (0.7 * coalesce(ev / nullif(nv, 0), 0) + 0.3 * coalesce(ec / nullif(nc, 0), 0)) * (wv + wc) / (wv + wc + 12), 5) as score from sd""")
def _(spark, d):
    out = evidence.directional_scores(_models(spark, d), ["driver", "target"], alpha=ALPHA)
    return out.select("driver", "target", "direction", "n", *rounded("var_coverage", "var_strength", "vecm_coverage", "vecm_strength", "beta_scale", "score", digits=5))


def _legacy_sql(sign: int) -> str:
    parts = [f"{w} * count(*) filter ({_side(m, sign)}) / count(*) * coalesce(quantile_cont(case when {_side(m, sign)} then abs({v}) end, 0.5), 0)" for m, v, w in (("VAR", "r", 0.7), ("VECM", "beta", 0.3))]
    return f"100 * ({' + '.join(parts)})"


@query("directional_score_v1_least_correlated", f"""{MODELS} select driver, target, count(*) as n, round({_legacy_sql(1)}, 5) as positive, round({_legacy_sql(-1)}, 5) as negative,
round(coalesce(100 * quantile_cont(case when model = 'VAR' then 1 - least(abs(r), 1) end, 0.5) * avg((p > {ALPHA})::int) filter (model = 'VAR') * (1 - count(*) filter (model = 'VECM') / count(*)) * count(*) filter (model = 'VAR') / (count(*) filter (model = 'VAR') + 12), 0), 5) as independence,
round(coalesce(100 / (0.000001 + avg(abs(t)) filter (model = 'VAR')) / (1 + count(*) filter (model = 'VECM') / 10), 0), 5) as legacy_independence from models group by driver, target""")
def _(spark, d):
    windows, keys = _models(spark, d), ["driver", "target"]
    scores = evidence.legacy_directional_scores(windows, keys, alpha=ALPHA)
    sides = scores.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("direction") == s, F.round("score", 5))).alias(s) for s in ("positive", "negative")])
    quiet = evidence.independence_scores(windows, keys, alpha=ALPHA)
    return sides.join(quiet.select(*keys, F.round("score", 5).alias("independence"), F.round("legacy", 5).alias("legacy_independence")), keys)


def _scored_sql(source: str, keys: str, name: str) -> str:
    """CTEs that end in <name>(keys, direction, n, score) from windows of both kinds."""
    hits = [f"coalesce(({_side('VAR', s)}) or ({_side('VECM', s)}), false)" for s in (1, -1)]
    return f"""{name}_c as (select {keys}, coalesce(nullif(quantile_cont(case when model = 'VECM' then abs(beta) end, 0.5), 0), 1) as scale from {source} group by {keys}),
{name}_e as (select *, greatest(1 - p / {ALPHA}, 0) as w, case when model = 'VAR' then least(abs(r), 1) else tanh(abs(beta) / greatest(scale, 0.001)) end as effect from {source} join {name}_c using ({keys})),
{name}_s as (select {keys}, direction, count(*) as n, count(*) filter (model = 'VAR') as nv, count(*) filter (model = 'VECM') as nc, coalesce(sum(w) filter (hit), 0) as we, coalesce(sum(w * effect) filter (model = 'VAR' and hit), 0) as ev, coalesce(sum(w * effect) filter (model = 'VECM' and hit), 0) as ec
  from (select *, 'positive' as direction, {hits[0]} as hit from {name}_e union all select *, 'negative', {hits[1]} from {name}_e) group by {keys}, direction),
{name} as (select *, 100 * (0.7 * coalesce(ev / nullif(nv, 0), 0) + 0.3 * coalesce(ec / nullif(nc, 0), 0)) * we / (we + 12) as score from {name}_s)"""


BREAKS = ["1998-07-01", "2000-01-01"]


@query("regime_scores", f"""{MODELS}, rg as (select *, case when date >= date '{BREAKS[1]}' then 'late' when date >= date '{BREAKS[0]}' then 'middle' else 'early' end as regime from models), {_scored_sql('rg', 'driver, target, regime', 'rs')}, {_scored_sql('models', 'driver, target', 'ws')},
tt as (select driver, target, count(*) as total from models group by all), ps as (select rs.*, n / total as share from rs join tt using (driver, target) where n >= 6),
cb as (select driver, target, direction, count(*) as k, sum(score * share) / greatest(1, sum(share)) as combined, arg_max(regime, round(share, 9) * 1000 - case regime when 'early' then 0 when 'late' then 1 else 2 end * 1e-6) as dominant, max(share) as dominant_share from ps group by all having count(*) > 1)
select driver, target, direction, round(coalesce(combined, score), 5) as score, coalesce(k, 0) as regimes, dominant, round(dominant_share, 5) as dominant_share from ws left join cb using (driver, target, direction)""")
def _(spark, d):
    out = evidence.regime_scores(_models(spark, d), ["driver", "target"], BREAKS, ["early", "middle", "late"], min_windows=6, alpha=ALPHA)
    return out.select("driver", "target", "direction", F.round("score", 5).alias("score"), F.col("regimes").cast("long").alias("regimes"), "dominant", F.round("dominant_share", 5).alias("dominant_share"))


FLIPS = f"(select driver, target, date, model, r * s as r, p, t, beta * s as beta, alpha, draw from (select *, case when ('0x' || substr(md5('placebo|' || driver || '|' || target || '|' || date || '|' || draw), 1, 4))::bigint % 2 = 0 then 1 else -1 end as s from models, (select unnest(range(1, 11)) as draw)))"


@query("placebo_flip_scores", f"""{MODELS}, fl as (select driver, target, date, model, -r as r, p, t, -beta as beta, alpha from models), {_scored_sql('models', 'driver, target', 'bs')}, {_scored_sql('fl', 'driver, target', 'fs')},
bo as (select target, driver, direction, b.score, f.score as placebo from bs b join fs f using (driver, target, direction)),
rk as (select *, row_number() over (partition by target, direction order by round(score, 9) desc, driver) as ra, row_number() over (partition by target, direction order by round(placebo, 9) desc, driver) as rb from bo)
select target, direction, count(*) as candidates, max(driver) filter (ra = 1) as top, max(driver) filter (rb = 1) as placebo_top, max(driver) filter (ra = 1) = max(driver) filter (rb = 1) as top_match, round(max(score) filter (ra = 1), 5) as top_score, round(max(placebo) filter (rb = 1), 5) as placebo_top_score, round(covar_pop(score, placebo) / nullif(stddev_pop(score) * stddev_pop(placebo), 0), 5) as score_corr from rk group by all""")
def _(spark, d):
    out = evidence.placebo_flip(_models(spark, d), "target", "driver", alpha=ALPHA)
    return out.select("target", "direction", "candidates", "top", "placebo_top", "top_match", *rounded("top_score", "placebo_top_score", "score_corr", digits=5))


@query("sign_randomization", f"""{MODELS}, dr as {FLIPS}, {_scored_sql('models', 'driver, target', 'bs')}, {_scored_sql('dr', 'driver, target, draw', 'ds')}
select driver, target, direction, round(any_value(b.score), 5) as score, count(*) as draws, round((1 + count(*) filter (d.score >= b.score - 1e-9)) / (1 + count(*)), 5) as empirical_p from ds d join bs b using (driver, target, direction) group by all""")
def _(spark, d):
    return evidence.sign_randomization(_models(spark, d), ["driver", "target"], draws=10, alpha=ALPHA).select("driver", "target", "direction", F.round("score", 5).alias("score"), "draws", F.round("empirical_p", 5).alias("empirical_p"))
