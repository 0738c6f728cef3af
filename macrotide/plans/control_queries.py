"""Queries with several controls, cross-fitting, rolling causality, weak instruments, groups and picks of series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import rounded
from macrotide.operators import constraints, controls, effects, selection, wide
from macrotide.plans.regression_queries import _hac_sql, _pairs
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_GAPS, PANEL_M, PANEL_NATION, panel_gaps, panel_m, panel_nation

N, M, G = f"with {PANEL_NATION}", f"with {PANEL_M}", f"with {PANEL_GAPS}"
W = "(partition by series order by date)"


@query("factor_panel_filter", f"""{G}, l as (select unnest([1, 2]) as lag), s0 as (select series, date, value, lag(value, 1) over {W} as v1, lag(value, 2) over {W} as v2 from panel_gaps),
s as (select series, case when length(series) % 2 = 0 then 'q' else 'm' end as freq, lag, date, case when lag = 1 then v1 else v2 end as value from s0, l),
k as (select series from s where lag = 1 and freq in ('m', 'q') and series not like '%LOW%' group by series having avg((value is null)::int) <= 0.35 and stddev_samp(value) > 1e-10)
select series, freq, date, round(value, 6) as value from s where lag = 1 and series in (select series from k)""")
def _(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(w).alias("value")) for k in (1, 2)])
    freq = F.when(F.length("series") % 2 == 0, "q").otherwise("m")
    stacked = panel_gaps(spark, d).withColumn("x", lags).select("series", freq.alias("freq"), "date", F.explode("x").alias("x")).select("series", "freq", "date", "x.*")
    return selection.factor_panel_filter(stacked, ["m", "q"], excluded="LOW").select("series", "freq", "date", *rounded("value"))


@query("snapshot_id", f"{M} select strftime(min(date), '%Y%m%d') || '_' || strftime(max(date), '%Y%m%d') || '_n' || count(*) as snapshot_id from panel_m")
def _(spark, d):
    return selection.snapshot_id(panel_m(spark, d), "date")


SHOCKED = f"""{N}, t as (select date, value as d from panel_nation where series = 'NATION_0'),
r as (select series, date, value as y, d, lag(value) over {W} as c, (month(date) % 3)::int as fold from panel_nation join t using (date) where series <> 'NATION_0'), h as (select * from r where c is not null)"""


def _shocked(spark, d):
    """(series, date, y, d, c, fold): each nation's value, that of the first one, and the own value of the month before."""
    panel = panel_nation(spark, d)
    shock = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("d"))
    w = Window.partitionBy("series").orderBy("date")
    rows = panel.filter("series <> 'NATION_0'").join(shock, "date").withColumn("c", F.lag("value").over(w))
    return rows.select("series", "date", F.col("value").alias("y"), "d", "c", (F.month("date") % 3).cast("int").alias("fold"))


@query("oster_delta", f"""{SHOCKED}, m as (select series, var_pop(d) as dd, var_pop(c) as cc, var_pop(y) as yy, covar_pop(d, c) as dc, covar_pop(d, y) as dy, covar_pop(c, y) as cy from h group by series),
b as (select series, dy / dd as b0, dy * dy / dd / yy as r0, (cc * dy - dc * cy) / (dd * cc - dc * dc) as b1, (dd * cy - dc * dy) / (dd * cc - dc * dc) as g1, dy, cy, yy from m),
f as (select *, (b1 * dy + g1 * cy) / yy as r1 from b)
select series, round(b0, 6) as beta0, round(b1, 6) as beta1, round(r0, 6) as r0, round(r1, 6) as r1, round(case when r0 < r1 and r1 < 1 then (b0 - b1) / b1 * (1 - r1) / (r1 - r0) end, 4) as delta, round(abs(b1) / abs(b0), 5) as stability_ratio from f""")
def _(spark, d):
    rows = _shocked(spark, d).dropna()
    m = rows.groupBy("series").agg(*[F.covar_pop(a, b).alias(a + b) for a, b in ("dd", "cc", "yy", "dc", "dy", "cy")])
    det = F.expr("dd * cc - dc * dc")
    m = m.withColumns({"b0": F.expr("dy / dd"), "r0": F.expr("dy * dy / dd / yy"), "b1": F.expr("cc * dy - dc * cy") / det, "g1": F.expr("dd * cy - dc * dy") / det})
    m = m.withColumn("r1", F.expr("(b1 * dy + g1 * cy) / yy"))
    b0, b1, r0, r1 = (F.col(c) for c in ("b0", "b1", "r0", "r1"))
    return m.select("series", *[F.round(c, 6).alias(n) for c, n in ((b0, "beta0"), (b1, "beta1"), (r0, "r0"), (r1, "r1"))], F.round(selection.oster_delta(b0, b1, r0, r1), 4).alias("delta"), F.round(selection.stability_ratio(b0, b1), 5).alias("stability_ratio"))


LAGGED = f"{M}, r as (select series, date, value as y, lag(value) over {W} as a, lag(value, 2) over {W} as b from panel_m), h as (select * from r where b is not null)"
SLOPES = "s as (select series, count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb, (var_pop(b) * covar_pop(a, y) - covar_pop(a, b) * covar_pop(b, y)) / (var_pop(a) * var_pop(b) - pow(covar_pop(a, b), 2)) as ba, (var_pop(a) * covar_pop(b, y) - covar_pop(a, b) * covar_pop(a, y)) / (var_pop(a) * var_pop(b) - pow(covar_pop(a, b), 2)) as bb from h group by series)"


def _lagged(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    return panel_m(spark, d).select("series", "date", F.col("value").alias("y"), F.lag("value").over(w).alias("a"), F.lag("value", 2).over(w).alias("b"))


@query("partial_out", f"{LAGGED}, {SLOPES} select series, date, round(y - my - ba * (a - ma) - bb * (b - mb), 5) as residual from h join s using (series)")
def _(spark, d):
    return controls.partial_out(_lagged(spark, d), ["series"], ["y"], ["a", "b"]).select("series", "date", F.round("r_y", 5).alias("residual"))


@query("lp_design_guards", f"{LAGGED}, {SLOPES} select series, n, 2 as used, null::varchar as reason, round(ba, 5) as slope_a, 0.0::double as slope_again, round(bb, 5) as slope_b from s where n >= 10 union all select series, n, 0, 'few_rows', 0.0::double, 0.0::double, 0.0::double from s where n < 10")
def _(spark, d):
    rows = _lagged(spark, d).withColumns({"again": 3 * F.col("a"), "flat": F.lit(1.0)})
    fits = controls.design_guards(rows, ["series"], ["y"], ["a", "again", "b", "flat"])
    return fits.select("series", "n", "used", "reason", *[F.round(F.col("b_y")[i], 5).alias(n) for i, n in ((1, "slope_a"), (2, "slope_again"), (3, "slope_b"))])


@query("dml_plr", f"""{SHOCKED}, o as (select a.series, a.fold, regr_slope(b.y, b.c) as sy, regr_intercept(b.y, b.c) as iy, regr_slope(b.d, b.c) as sd, regr_intercept(b.d, b.c) as id from (select distinct series, fold from h) a join h b on a.series = b.series and a.fold <> b.fold group by all),
x as (select series, date, y - iy - sy * c as y, d - id - sd * c as x from h join o using (series, fold)), {_hac_sql('x', 'series', 'date', 3)} select series, n, round(beta, 6) as beta, round(se, 6) as se from hac""")
def _(spark, d):
    return controls.partially_linear(_shocked(spark, d), ["series"], "date", "y", "d", ["c"], "fold").select("series", "n", *rounded("beta", "se"))


@query("tmle_ate")
def _(spark, d):
    """The effect of months in which the first nation is above its mean, on each other nation."""
    rows = _shocked(spark, d).dropna()
    mean = rows.groupBy("series").agg(F.avg("d").alias("mean"))
    rows = rows.join(mean, "series").withColumn("a", (F.col("d") > F.col("mean")).cast("double"))
    out = effects.tmle_ate(rows, ["series"], "date", "y", "a", ["c"], "fold")
    return out.select("series", "eps", "n", *rounded("estimate", "se", "lo", "hi", "p", "ess", digits=5))


@query("r_learner_effects")
def _(spark, d):
    rows, _ = effects.r_learner(_shocked(spark, d).withColumn("month", F.month("date").cast("double")), "y", "d", ["c", "month"], "fold", [0, 1, 2])
    return effects.segment_effects(rows, ["series"], "y", "d").select("series", "n", *rounded("mean_effect", "ate", digits=5))


def _ridge_sql(d: str, extra: str = "") -> str:
    return f"""(with h as (select series, date, y, {d} as d, c from r), g as (select * from h where d is not null and c is not null),
s as (select series, avg(y) as my, avg(d) as md, avg(c) as mc, regr_slope(y, c) / 1.1 as sy, regr_slope(d, c) / 1.1 as sd from g group by series),
x as (select g.series, date, y - my - sy * (c - mc) as y, d - md - sd * (c - mc) as x from g join s using (series)), {_hac_sql('x', 'series', 'date', 3)} select * from hac)"""


@query("ridge_sanity", f"{SHOCKED} select a.series, a.n, round(a.beta, 6) as beta, round(a.se, 6) as se, round(b.beta / nullif(b.se, 0), 4) as lead_z from {_ridge_sql('d')} a left join {_ridge_sql(f'lead(d) over {W}')} b using (series)")
def _(spark, d):
    return controls.ridge_sanity(_shocked(spark, d), ["series"], "date", "y", "d", ["c"]).select("series", "n", *rounded("beta", "se"), F.round("lead_z", 4).alias("lead_z"))


@query("rolling_granger", f"""{M}, l as (select series, date, value, lag(value) over {W} as l1 from panel_m), p as (select a.series as effect, b.series as cause, a.date, a.value as y, a.l1 as a, b.l1 as b from l a join l b on a.date = b.date and a.series <> b.series where a.l1 is not null and b.l1 is not null),
w as (select cause, effect, date, count(*) over k as n, var_pop(y) over k as yy, var_pop(a) over k as aa, var_pop(b) over k as bb, covar_pop(a, b) over k as ab, covar_pop(a, y) over k as ay, covar_pop(b, y) over k as cy from p window k as (partition by cause, effect order by date rows between 23 preceding and current row)),
q as (select *, yy - ay * ay / aa as left_y, bb - ab * ab / aa as left_b, cy - ab * ay / aa as left_by from w where n = 24)
select cause, effect, date, n, round((left_by * left_by / left_b) / ((left_y - left_by * left_by / left_b) / 21), 4) as f, round(left_by / sqrt(left_b * left_y), 5) as r from q""")
def _(spark, d):
    panel = panel_m(spark, d)
    pairs = _pairs(panel).toDF("cause", "effect")
    return controls.rolling_granger(panel, pairs, 24).select("cause", "effect", "date", "n", F.round("f", 4).alias("f"), F.round("r", 5).alias("r"))


@query("indicator_groups", f"""with recursive {PANEL_NATION}, e as (select a.series as a, b.series as b from panel_nation a join panel_nation b on a.date = b.date and a.series <> b.series group by all having count(*) >= 24 and abs(corr(a.value, b.value)) >= 0.25),
walk as (select distinct series as a, series as b from panel_nation union select walk.a, e.b from walk join e on walk.b = e.a)
select a as series, min(b) as "group" from walk group by a""")
def _(spark, d):
    return selection.indicator_groups(panel_nation(spark, d), threshold=0.25)


@query("representative_draws")
def _(spark, d):
    draws = panel_nation(spark, d).withColumnRenamed("series", "draw").withColumn("half", (F.length("draw") % 2).cast("int"))
    return selection.representative_draws(draws, ["half"], 5).select("half", "draw", *rounded("score"), F.col("place").cast("long").alias("place"))


INSTRUMENTED = f"""{N}, zs as (select date, value as z from panel_nation where series = 'NATION_5'), t as (select date, value as d from panel_nation where series = 'NATION_0'),
r0 as (select p.series, date, p.value as y, d, z from panel_nation p join t using (date) join zs using (date) where p.series not in ('NATION_0', 'NATION_5')),
c0 as (select series, count(*) as n, avg(y) as my, avg(d) as md, avg(z) as mz from r0 group by series), r as (select r0.series, date, n, y - my as y, d - md as d, z - mz as z from r0 join c0 using (series)),
m as (select series, any_value(n) as n, sum(z * z) as zz, sum(z * y) as zy, sum(z * d) as zd from r group by series), s as (select r.series, r.date, m.n, zz, zy, zd, z * (y - zy / zz * z) as u, z * (d - zd / zz * z) as v from r join m using (series) where zz > 0 and zd <> 0),
l as (select *, coalesce(lag(u) over w, 0) as u1, coalesce(lag(v) over w, 0) as v1, coalesce(lag(u, 2) over w, 0) as u2, coalesce(lag(v, 2) over w, 0) as v2 from s window w as (partition by series order by date)),
q as (select series, any_value(n) as n, any_value(zy) as zy, any_value(zd) as zd, any_value(zy / zd) as theta, sum(u * u + 4.0 / 3 * u * u1 + 2.0 / 3 * u * u2) as q0, sum(u * v + 2.0 / 3 * (u * v1 + v * u1) + 1.0 / 3 * (u * v2 + v * u2)) as q1, sum(v * v + 4.0 / 3 * v * v1 + 2.0 / 3 * v * v2) as q2 from l group by series),
e as (select *, sqrt(greatest(q0 - 2 * theta * q1 + theta * theta * q2, 0)) / abs(zd) as error from q), g as (select *, case when error > 0 then least(greatest(6 * error, 0.5), 20) else 1 end as radius from e),
grid as (select g.*, k, i, theta + radius * pow(2.0, k) * (2 * i / 30.0 - 1) as th from g, (select unnest(range(3)) as k), (select unnest(range(31)) as i)),
ok as (select *, abs(zy - th * zd) / sqrt(case when q0 - 2 * th * q1 + th * th * q2 > 0 then q0 - 2 * th * q1 + th * th * q2 end) <= 1.959963985 as fits from grid),
tried as (select series, n, theta, k, min(i) filter (fits) as low, max(i) filter (fits) as high, min(th) filter (fits) as lo, max(th) filter (fits) as hi from ok group by all),
named as (select *, case when low is null then 'empty' when low > 0 and high < 30 then 'inside' else 'edge' end as status from tried),
best as (select *, row_number() over (partition by series order by case when status = 'inside' then k else 6 - k end) as place from named)
select series, n, round(theta, 5) as theta, round(lo, 5) as lo, round(hi, 5) as hi, status from best where place = 1"""


@query("ar_grid_ci", INSTRUMENTED)
def _(spark, d):
    panel = panel_nation(spark, d)
    z, t = (panel.filter(F.col("series") == s).select("date", F.col("value").alias(c)) for s, c in (("NATION_5", "z"), ("NATION_0", "d")))
    rows = panel.filter("series not in ('NATION_0', 'NATION_5')").withColumnRenamed("value", "y").join(t, "date").join(z, "date")
    return selection.anderson_rubin_set(rows, ["series"], "date", "y", "d", "z").select("series", "n", *[F.round(c, 5).alias(c) for c in ("theta", "lo", "hi")], "status")


QUARTERS = f"{M}, p as (select series, date, date_trunc('quarter', date)::date as block, value from panel_m), t as (select series, block, sum(value) * 1.02 as target from p group by all), u as (select *, max(value) over {W} as top from p)"


@query("constraint_enforce", f"{QUARTERS} select series, block, date, round(top + (target - sum(top) over (partition by series, block)) / count(*) over (partition by series, block), 6) as value from u join t using (series, block)")
def _(spark, d):
    path = panel_m(spark, d).withColumn("block", F.trunc("date", "quarter"))
    low = path.groupBy("series", "block").agg((F.sum("value") * 1.02).alias("target"))
    return constraints.constraint_enforce(path, low, monotonic="increasing").select("series", "block", "date", *rounded("value"))


@query("wide_gram", f"""{N}, k as (select a.series as a, b.series as b, quarter(a.date) as quarter, a.value as x, b.value as y from panel_nation a join panel_nation b on a.date = b.date and a.series <= b.series
  where a.date in (select date from panel_nation group by date having count(*) = (select count(distinct series) from panel_nation)))
select quarter, a, b, count(*) as n, round(count(*) * covar_pop(x, y), 5) as s from k group by all""")
def _(spark, d):
    """Centred products of all nations' months in each quarter of the year."""
    rows = wide.wide_rows(panel_nation(spark, d)).withColumn("quarter", F.quarter("date"))
    sums = wide.wide_gram(rows, ["quarter"])
    size = sums.filter("i = 0 and j = 0").select("quarter", F.col("s").cast("long").alias("n"))
    named = sums.filter("i > 0").join(F.broadcast(rows.agg(F.first("names").alias("names")))).join(size, "quarter")
    return named.select("quarter", F.get("names", F.col("i") - 1).alias("a"), F.get("names", F.col("j") - 1).alias("b"), "n", *rounded("s", digits=5)).withColumn("quarter", F.col("quarter").cast("long"))


@query("dml_plr_nested")
def _(spark, d):
    """The effect of the first nation's change on every other's next one, given last month's values of all nations: six controls, chosen in each fold's training rows."""
    panel = panel_nation(spark, d)
    w = Window.partitionBy("series").orderBy("date")
    moves = panel.withColumns({"d": F.col("value") - F.lag("value").over(w), "y": F.lead("value").over(w) - F.col("value")})
    first = panel.agg(F.min("series").alias("treatment"))
    treated = moves.join(F.broadcast(first), F.col("series") == F.col("treatment")).select("date", "d")
    controls_ = wide.wide_rows(panel.withColumn("value", F.lag("value").over(w))).select("date", "w")
    rows = moves.drop("d").join(treated, "date").join(controls_, "date").join(F.broadcast(first), F.col("series") != F.col("treatment")).filter("y is not null and d is not null")
    folded = wide.fold_in_order(rows, ["series"], "date", 5)
    return wide.nested_partially_linear(folded, ["series"], "date", "y", "d", "w", "fold", most=6, mode="corr_t_then_variance").select("series", "n", *rounded("beta", "se", "p", "lo", "hi"))
