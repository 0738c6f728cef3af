"""Queries of regressions, projections and event designs over the order panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr, rounded
from macrotide.operators import attribution, events, regression
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_M, PANEL_NATION, normal_p_sql, panel_m, panel_nation

W = "(partition by series order by date)"
LAGS, HORIZONS = 2, 4


def _hac_sql(rows: str, key: str, at: str, lags: int) -> str:
    """CTEs fit, scored and hac from rows(key, at, y, x)."""
    meat = "s * s" + "".join(f" + {2 * (1 - k / (lags + 1))!r} * coalesce(s * lag(s, {k}) over (partition by {key} order by {at}), 0)" for k in range(1, lags + 1))
    on = ", ".join(x.strip() for x in key.split(","))
    return f"""fit as (select {key}, count(*) as n, avg(x) as mx, avg(y) as my, regr_slope(y, x) as beta, regr_sxx(y, x) as sxx from {rows} where x is not null and y is not null group by {key}),
scored as (select {key}, {at}, n, beta, sxx, (x - mx) * (y - my - beta * (x - mx)) as s from {rows} join fit using ({on}) where x is not null and y is not null),
meats as (select *, {meat} as meat from scored),
hac as (select {key}, any_value(n) as n, any_value(beta) as beta, case when any_value(sxx) > 0 then sqrt(greatest(sum(meat), 0)) / any_value(sxx) end as se from meats group by {key})"""


def _projection_sql(panel: str, source: str, pairs: str, state: str = "") -> str:
    key = "treatment, outcome, horizon" + (", state" if state else "")
    extra = ", state" if state else ""
    leads = " union all ".join(f"select series as outcome, date, {h} as horizon, lead(value, {h}) over {W} - lag(value) over {W} as y, before from moved" for h in range(HORIZONS + 1))
    det = "(var_pop(before) * var_pop(past) - pow(covar_pop(before, past), 2))"
    slopes = ", ".join(f"({own} * covar_pop({a}, {v}) - covar_pop(before, past) * covar_pop({b}, {v})) / {det} as {n}" for v in ("y", "shock") for a, b, own, n in (("before", "past", "var_pop(past)", f"b_{v}"), ("past", "before", "var_pop(before)", f"g_{v}")))
    return f"""with {panel}, m0 as (select *, value - lag(value) over {W} as move{', ' + state + ' as state' if state else ''} from {source}),
moved as (select *, lag(move) over {W} as before from m0), ahead as ({leads}),
design as (select s.series as treatment, a.outcome, a.date, a.horizon, a.y, s.move as shock, s.before as past, a.before{', s.state' if state else ''} from ahead a join moved s on a.date = s.date join ({pairs}) p on p.treatment = s.series and p.outcome = a.outcome where a.y is not null and s.move is not null and s.before is not null and a.before is not null),
st as (select {key}, avg(before) as mb, avg(past) as mp, avg(y) as m_y, avg(shock) as m_s, {slopes}, stddev_samp(shock) as sd from design group by {key}),
cleared as (select {key}, date, y - m_y - b_y * (before - mb) - g_y * (past - mp) as y, shock - m_s - b_shock * (before - mb) - g_shock * (past - mp) as x from design join st using ({key})),
{_hac_sql('cleared', key, 'date', LAGS)}
select {key}, n, round(beta, 6) as beta, round(se, 6) as se, round(beta * sd, 6) as effect, round(se * sd, 6) as effect_se, round({normal_p_sql('(beta / nullif(se, 0))')}, 6) as p from hac join st using ({key})"""


ALL_PAIRS = "select a.series as treatment, b.series as outcome from (select distinct series from panel_m) a, (select distinct series from panel_m) b where a.series <> b.series"


def _columns():
    return ["n", *rounded("beta", "se", "effect", "effect_se", "p")]


def _pairs(panel):
    series = panel.select("series").distinct()
    return series.toDF("treatment").crossJoin(series.toDF("outcome")).filter("treatment <> outcome").select("treatment", "outcome")


@query("lp_irf", _projection_sql(PANEL_M, "panel_m", ALL_PAIRS))
def _(spark, d):
    panel = panel_m(spark, d)
    return regression.local_projection(panel, _pairs(panel), HORIZONS, LAGS).select("treatment", "outcome", "horizon", *_columns())


@query("lp_state_split", _projection_sql(PANEL_M, "panel_m", ALL_PAIRS, "case when quarter(date) <= 2 then 1 else 0 end"))
def _(spark, d):
    panel = panel_m(spark, d).withColumn("state", (F.quarter("date") <= 2).cast("int"))
    return regression.local_projection(panel, _pairs(panel), HORIZONS, LAGS, state="state").select("treatment", "outcome", "horizon", "state", *_columns())


@query("ols_hac", f"""with {PANEL_M}, r as (select series, date, value as y, lag(value) over {W} as x from panel_m), {_hac_sql('r', 'series', 'date', 3)}
select series, n, round(beta, 6) as beta, round(se, 6) as se, round(beta / nullif(se, 0), 5) as z from hac""")
def _(spark, d):
    rows = panel_m(spark, d).withColumn("x", F.lag("value").over(Window.partitionBy("series").orderBy("date")))
    return regression.hac_slope(rows, ["series"], "date", "value", "x", 3).select("series", "n", *rounded("beta", "se"), F.round("z", 5).alias("z"))


@query("gram_moments", f"""with {PANEL_M}, r as (select series, value as y, lag(value) over {W} as a, lag(value, 2) over {W} as b from panel_m), h as (select * from r where a is not null and b is not null),
m as (select series, avg(y) my, avg(a) ma, avg(b) mb from h group by series)
select series, count(*) as n, round(sum((a - ma) * (a - ma)), 5) as s_a_a, round(sum((a - ma) * (b - mb)), 5) as s_a_b, round(sum((a - ma) * (y - my)), 5) as s_a_y, round(sum((b - mb) * (b - mb)), 5) as s_b_b, round(sum((b - mb) * (y - my)), 5) as s_b_y, round(sum((y - my) * (y - my)), 5) as s_y_y,
round((sum((b - mb) * (b - mb)) * sum((a - ma) * (y - my)) - sum((a - ma) * (b - mb)) * sum((b - mb) * (y - my))) / (sum((a - ma) * (a - ma)) * sum((b - mb) * (b - mb)) - pow(sum((a - ma) * (b - mb)), 2)), 6) as slope_a from h join m using (series) group by series""")
def _(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    rows = panel_m(spark, d).withColumnRenamed("value", "y").withColumns({"a": F.lag("y").over(w), "b": F.lag("y", 2).over(w)})
    moments = regression.gram(rows, ["series"], "y", ["a", "b"])
    names = ["s_a_a", "s_a_b", "s_a_y", "s_b_b", "s_b_y", "s_y_y"]
    return moments.select("series", "n", *rounded(*names, digits=5), F.round(regression.two_slopes("a", "b", "y")[0], 6).alias("slope_a"))


@query("partial_corr", f"""with {PANEL_NATION}, b as (select date, max(case when series = 'NATION_0' then value end) as t, max(case when series = 'NATION_1' then value end) as y from panel_nation where series in ('NATION_0', 'NATION_1') group by date),
c as (select series, count(*) as n, corr(value, t) as wt, corr(value, y) as wy, corr(t, y) as ty from panel_nation join b using (date) where series not in ('NATION_0', 'NATION_1') group by series)
select series, round(wt, 6) as corr_wt, round((wy - wt * ty) / sqrt(nullif((1 - wt * wt) * (1 - ty * ty), 0)), 6) as partial_wy_t, round(abs(wt) * abs((wy - wt * ty) / sqrt(nullif((1 - wt * wt) * (1 - ty * ty), 0))), 6) as suspicion from c where n >= 24 and isfinite(wt) and isfinite(wy) and isfinite(ty)""")
def _(spark, d):
    panel = panel_nation(spark, d)
    base = panel.filter("series in ('NATION_0', 'NATION_1')").groupBy("date").agg(F.max(F.when(F.col("series") == "NATION_0", F.col("value"))).alias("t"), F.max(F.when(F.col("series") == "NATION_1", F.col("value"))).alias("y"))
    c = panel.filter("series not in ('NATION_0', 'NATION_1')").join(base, "date").groupBy("series").agg(F.count("*").alias("n"), corr("value", "t").alias("wt"), corr("value", "y").alias("wy"), corr("t", "y").alias("ty")).filter("n >= 24 and wt is not null and wy is not null and ty is not null")
    partial = F.expr("(wy - wt * ty) / sqrt(nullif((1 - wt * wt) * (1 - ty * ty), 0))")
    return c.select("series", F.round("wt", 6).alias("corr_wt"), F.round(partial, 6).alias("partial_wy_t"), F.round(F.abs("wt") * F.abs(partial), 6).alias("suspicion"))


@query("variance_attribution", f"""with {PANEL_NATION}, f as (select date, max(case when series = 'NATION_2' then value end) as a, max(case when series = 'NATION_3' then value end) as b from panel_nation group by date),
r as (select p.series as outcome, p.value as y, a, b from panel_nation p join f using (date) where p.series not in ('NATION_2', 'NATION_3') and a is not null and b is not null),
m as (select outcome, count(*) as n, regr_sxx(y, a) as aa, regr_sxx(y, b) as bb, regr_syy(y, a) as yy, regr_sxy(b, a) as ab, regr_sxy(y, a) as ay, regr_sxy(y, b) as b_y from r group by outcome having count(*) >= 24)
select outcome, 'full_factors' as model, 'all' as factor, n, round(((bb * ay - ab * b_y) * ay + (aa * b_y - ab * ay) * b_y) / (aa * bb - ab * ab) / yy, 6) as r2 from m union all select outcome, 'single_factor', 'a', n, round(ay * ay / aa / yy, 6) from m union all select outcome, 'single_factor', 'b', n, round(b_y * b_y / bb / yy, 6) from m""")
def _(spark, d):
    """What two nations explain of each other one, together and alone."""
    panel = panel_nation(spark, d)
    wide = panel.groupBy("date").agg(*[F.max(F.when(F.col("series") == s, F.col("value"))).alias(c) for c, s in (("a", "NATION_2"), ("b", "NATION_3"))])
    rows = panel.filter("series not in ('NATION_2', 'NATION_3')").select(F.col("series").alias("outcome"), "date", F.col("value").alias("y")).join(wide, "date")
    return attribution.variance_attribution(rows, ["outcome"], "y", ["a", "b"]).select("outcome", "model", "factor", "n", *rounded("r2"))


@query("endpoint_stability", f"""with {PANEL_NATION}, t as (select date, value as x from panel_nation where series = 'NATION_0'), r as (select p.series, year(p.date) as yr, value as y, x from panel_nation p join t using (date) where p.series <> 'NATION_0'),
m as (select series, yr, count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(x * y) sxy from r group by all),
c as (select series, yr, sum(n) over w as n, sum(sx) over w as sx, sum(sy) over w as sy, sum(sxx) over w as sxx, sum(sxy) over w as sxy from m window w as (partition by series order by yr)),
b as (select series, yr, (n * sxy - sx * sy) / (n * sxx - sx * sx) as beta from c where n >= 24), l as (select series, arg_max(beta, yr) as final from b group by series)
select series, count(*) as endpoints, min(case when sign(beta) = sign(final) then 1 else 0 end) as sign_stable, round(max(abs(beta - final)), 5) as max_drift, round(max(abs(beta - final)) / nullif(abs(any_value(final)), 0), 3) as relative_drift from b join l using (series) group by series""")
def _(spark, d):
    panel = panel_nation(spark, d)
    target = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("x"))
    rows = panel.filter("series <> 'NATION_0'").join(target, "date").withColumn("yr", F.year("date"))
    x, y = F.col("x"), F.col("value")
    by_year = rows.groupBy("series", "yr").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    w = Window.partitionBy("series").orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)
    beta = by_year.select("series", "yr", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]).filter("n >= 24").withColumn("beta", F.expr("(n * sxy - sx * sy) / (n * sxx - sx * sx)"))
    last = beta.groupBy("series").agg(F.max_by("beta", "yr").alias("final"))
    drift = F.max(F.abs(F.col("beta") - F.col("final")))
    return beta.join(last, "series").groupBy("series").agg(F.count("*").alias("endpoints"), F.min((F.signum("beta") == F.signum("final")).cast("int")).alias("sign_stable"), F.round(drift, 5).alias("max_drift"), F.round(F.try_divide(drift, F.abs(F.first("final"))), 3).alias("relative_drift"))


@query("identity_check", f"""with {PANEL_M}, w as (select date, sum(value) as a, sum(case when series < '3' then value else 0 end) as b, sum(case when series >= '3' then value * 1.001 else 0 end) as c from panel_m group by date)
select count(*) as n, round(corr(a, b + c), 6) as correlation, round(avg(abs(a - b - c)), 6) as mean_abs, round(max(abs(a - b - c)), 6) as max_abs, round(stddev_samp(a) / nullif(stddev_samp(b + c), 0), 6) as sd_ratio, case when corr(a, b + c) < 0.99 then 'warn' else 'ok' end as status from w""")
def _(spark, d):
    wide = panel_m(spark, d).groupBy("date").agg(F.sum("value").alias("a"), F.sum(F.when(F.col("series") < "3", F.col("value")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("series") >= "3", F.col("value") * 1.001).otherwise(0.0)).alias("c"))
    gap, parts = F.abs(F.col("a") - F.col("b") - F.col("c")), F.col("b") + F.col("c")
    return wide.agg(F.count("*").alias("n"), F.round(corr("a", parts), 6).alias("correlation"), F.round(F.avg(gap), 6).alias("mean_abs"), F.round(F.max(gap), 6).alias("max_abs"), F.round(F.try_divide(F.stddev_samp("a"), F.stddev_samp(parts)), 6).alias("sd_ratio"), F.when(corr("a", parts) < 0.99, "warn").otherwise("ok").alias("status"))


@query("lp_iv_2sls", f"""with {PANEL_NATION}, z as (select date, value as z from panel_nation where series = 'NATION_5'), t as (select date, value as t from panel_nation where series = 'NATION_0'),
r as (select p.series, value as y, t, z from panel_nation p join t using (date) join z using (date) where p.series not in ('NATION_0', 'NATION_5')),
s as (select series, count(*) n, regr_slope(t, z) pi, regr_r2(t, z) r2, regr_slope(y, z) rf from r group by series)
select series, n, round(pi, 6) as first_stage, round((n - 2) * r2 / nullif(1 - r2, 0), 4) as f, round(rf / nullif(pi, 0), 4) as theta, case when (n - 2) * r2 / nullif(1 - r2, 0) < 5 then 'hard' when (n - 2) * r2 / nullif(1 - r2, 0) < 10 then 'soft' else 'ok' end as weak from s where n >= 24""")
def _(spark, d):
    panel = panel_nation(spark, d)
    z, t = (panel.filter(F.col("series") == s).select("date", F.col("value").alias(c)) for s, c in (("NATION_5", "z"), ("NATION_0", "t")))
    rows = panel.filter("series not in ('NATION_0', 'NATION_5')").join(t, "date").join(z, "date")
    s = rows.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("t", "z").alias("pi"), F.regr_r2("t", "z").alias("r2"), F.regr_slope("value", "z").alias("rf")).filter("n >= 24")
    f = F.try_divide((F.col("n") - 2) * F.col("r2"), 1 - F.col("r2"))
    return s.select("series", "n", F.round("pi", 6).alias("first_stage"), F.round(f, 4).alias("f"), F.round(F.try_divide("rf", "pi"), 4).alias("theta"), F.when(f < 5, "hard").when(f < 10, "soft").otherwise("ok").alias("weak"))


@query("dml_iv", f"""with {PANEL_NATION}, i as (select date, ntile(5) over (order by date) as fold, max(case when series = 'NATION_0' then value end) as d, max(case when series = 'NATION_5' then value end) as z, max(case when series = 'NATION_6' then value end) as w from panel_nation group by date),
r as (select p.series, fold, value as y, d, z, w from panel_nation p join i using (date) where p.series not in ('NATION_0', 'NATION_5', 'NATION_6') and d is not null and z is not null and w is not null),
k as (select series, fold, count(*) n, sum(w) sw, sum(w * w) sww, sum(y) sy, sum(d) sd, sum(z) sz, sum(w * y) swy, sum(w * d) swd, sum(w * z) swz from r group by all),
t as (select series, sum(n) n, sum(sw) sw, sum(sww) sww, sum(sy) sy, sum(sd) sd, sum(sz) sz, sum(swy) swy, sum(swd) swd, sum(swz) swz from k group by series),
o as (select k.series, k.fold, nullif(t.n - k.n, 0) as n, t.sw - k.sw as sw, t.sww - k.sww as sww, t.sy - k.sy as sy, t.sd - k.sd as sd, t.sz - k.sz as sz, t.swy - k.swy as swy, t.swd - k.swd as swd, t.swz - k.swz as swz from k join t using (series)),
b as (select *, nullif(n * sww - sw * sw, 0) as det from o),
e as (select r.series, y - sy / n - (n * swy - sw * sy) / det * (w - sw / n) as y, d - sd / n - (n * swd - sw * sd) / det * (w - sw / n) as d, z - sz / n - (n * swz - sw * sz) / det * (w - sw / n) as z from r join b using (series, fold)),
th as (select series, count(*) as n, sum(z * y) / nullif(sum(z * d), 0) as theta, nullif(abs(sum(z * d)), 0) as den from e group by series)
select series, any_value(th.n) as n, round(any_value(theta), 3) as theta, round(sqrt(sum(pow(z * (y - theta * d), 2))) / any_value(den), 3) as se from e join th using (series) group by series""")
def _(spark, d):
    panel = panel_nation(spark, d)
    names = {"d": "NATION_0", "z": "NATION_5", "w": "NATION_6"}
    base = panel.filter(F.col("series").isin(*names.values())).groupBy("date").agg(*[F.max(F.when(F.col("series") == s, F.col("value"))).alias(c) for c, s in names.items()])
    dates = panel.select("date").distinct().withColumn("fold", F.ntile(5).over(Window.orderBy("date")))  # one row for each month
    rows = panel.filter(~F.col("series").isin(*names.values())).withColumnRenamed("value", "y").join(base.join(dates, "date"), "date").filter("d is not null and z is not null and w is not null")
    w = F.col("w")
    sums = {"n": F.count("*"), "sw": F.sum(w), "sww": F.sum(w * w), **{f"s{c}": F.sum(c) for c in "ydz"}, **{f"sw{c}": F.sum(w * F.col(c)) for c in "ydz"}}
    folds = rows.groupBy("series", "fold").agg(*[v.alias(k) for k, v in sums.items()])
    whole = Window.partitionBy("series")
    others = folds.select("series", "fold", *[(F.sum(k).over(whole) - F.col(k)).alias(k) for k in sums]).withColumn("n", F.expr("nullif(n, 0)")).withColumn("det", F.expr("nullif(n * sww - sw * sw, 0)"))
    clear = {f"r{c}": F.expr(f"{c} - s{c} / n - (n * sw{c} - sw * s{c}) / det * (w - sw / n)") for c in "ydz"}
    cleared = rows.join(others, ["series", "fold"]).select("series", *[v.alias(k) for k, v in clear.items()])
    theta = cleared.groupBy("series").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.expr("rz * ry")), F.sum(F.expr("rz * rd"))).alias("theta"), F.nullif(F.abs(F.sum(F.expr("rz * rd"))), F.lit(0.0)).alias("den"))
    return cleared.join(theta, "series").groupBy("series").agg(F.first("n").alias("n"), F.round(F.first("theta"), 3).alias("theta"), F.round(F.sqrt(F.sum(F.expr("pow(rz * (ry - theta * rd), 2)"))) / F.first("den"), 3).alias("se"))


EVENTS = f"""with recursive {PANEL_NATION}, c as (select series, date, row_number() over {W} as i, value, value - lag(value) over {W} as move from panel_nation),
q as (select series, quantile_cont(move, 0.8) as cut from c where move is not null group by series), x as (select c.series, i, row_number() over (partition by c.series order by i) as k from c join q using (series) where move >= cut),
g(series, k, i, last) as (select series, k, i, i from x where k = 1 union all select x.series, x.k, x.i, case when x.i - g.last >= 4 then x.i else g.last end from g join x on x.series = g.series and x.k = g.k + 1),
ev as (select distinct series, last as i from g)"""


@query("event_select", f"{EVENTS} select ev.series, ev.i::integer as i, c.date from ev join c on c.series = ev.series and c.i = ev.i")
def _(spark, d):
    return events.select_events(panel_nation(spark, d), 0.8, 4).select("series", "i", "date")


@query("event_panel", f"""{EVENTS}, h as (select unnest(range(-3, 5)) as h) select ev.series, ev.i::integer as event, h.h::integer as event_time, round(c.value - b.value, 6) as change from ev, h join c on c.series = ev.series and c.i = ev.i + h.h join c b on b.series = ev.series and b.i = ev.i - 1""")
def _(spark, d):
    panel = panel_nation(spark, d)
    return events.event_panel(panel, events.select_events(panel, 0.8, 4), -3, 4, -1).select("series", "event", "event_time", *rounded("change"))


@query("did_event_path", f"""{EVENTS}, h as (select unnest(range(-3, 5)) as h), p as (select ev.series, h.h::integer as event_time, c.value - b.value as change from ev, h join c on c.series = ev.series and c.i = ev.i + h.h join c b on b.series = ev.series and b.i = ev.i - 1),
s as (select event_time, count(*) as n, avg(change) as effect, stddev_samp(change) / sqrt(count(*)) as se from p group by event_time)
select event_time, n, round(effect, 6) as effect, round(se, 6) as se, round(effect - 1.96 * se, 6) as lo, round(effect + 1.96 * se, 6) as hi, round({normal_p_sql('(effect / nullif(se, 0))')}, 6) as p from s""")
def _(spark, d):
    panel = panel_nation(spark, d)
    rows = events.event_panel(panel, events.select_events(panel, 0.8, 4), -3, 4, -1)
    return events.event_path(rows).select("event_time", "n", *rounded("effect", "se", "lo", "hi", "p"))


@query("placebo_events", f"""{EVENTS}, pl as (select series, i - 6 as i, row_number() over (partition by series order by i) as k from ev where i > 6), pg(series, k, i, last) as (select series, k, i, i from pl where k = 1 union all select pl.series, pl.k, pl.i, case when pl.i - pg.last >= 4 then pl.i else pg.last end from pg join pl on pl.series = pg.series and pl.k = pg.k + 1)
select distinct series, last::integer as i from pg""".replace("with recursive", "with recursive", 1))
def _(spark, d):
    found = events.select_events(panel_nation(spark, d), 0.8, 4)
    return events.thinned(found.select("series", (F.col("i") - 6).alias("i")).filter("i > 0"), 4)
