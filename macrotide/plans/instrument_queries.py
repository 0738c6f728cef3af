"""Queries of instrument screens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import rounded
from macrotide.operators import instruments
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_M, PANEL_NATION, normal_p_sql, panel_m, panel_nation

SCREEN = f"""with {PANEL_M}, {PANEL_NATION}, tr as (select series as treatment, date, value - lag(value) over w as y from panel_m window w as (partition by series order by date)),
ty as (select *, lead(y) over w as y1, lead(y, 2) over w as y2 from tr window w as (partition by treatment order by date)),
cb as (select series as candidate, date, value as v, lag(value) over (partition by series order by date) as b from panel_nation),
ci as (select candidate, regr_slope(v, b) as sl, regr_intercept(v, b) as ic from cb group by candidate),
cf as (select candidate, date, 'diff' as transform, v - b as z from cb union all select candidate, date, 'logdiff', case when v > 0 and b > 0 then ln(v) - ln(b) end from cb union all select candidate, date, 'innov', v - ic - sl * v from cb join ci using (candidate)),
cl as (select candidate, transform, 0 as lag, date, z from cf union all select candidate, transform, 1, date, lag(z) over w from cf window w as (partition by candidate, transform order by date) union all select candidate, transform, 2, date, lag(z, 2) over w from cf window w as (partition by candidate, transform order by date)),
rw as (select treatment, candidate, transform, lag, date, y, y1, y2, z from cl join ty using (date) where z is not null),
fs as (select treatment, candidate, transform, lag, count(y) as "rows", var_pop(z) filter (y is not null) as spread, regr_r2(y, z) as r2, regr_r2(y1, z) as l1, regr_count(y1, z) as m1, regr_r2(y2, z) as l2, regr_count(y2, z) as m2 from rw group by all),
po as (select *, row_number() over w - 1 as i, count(*) over (partition by treatment, candidate, transform, lag) as n from rw where y is not null window w as (partition by treatment, candidate, transform, lag order by date)),
fo as (select *, case when i < n % 5 * (n // 5 + 1) then i // (n // 5 + 1) else n % 5 + (i - n % 5 * (n // 5 + 1)) // (n // 5) end as fold, avg(y) over (partition by treatment, candidate, transform, lag) as my from po),
fb as (select a.treatment, a.candidate, a.transform, a.lag, f.fold, count(*) filter (a.fold < f.fold) as nb, regr_slope(a.y, a.z) filter (a.fold < f.fold) as bb, regr_intercept(a.y, a.z) filter (a.fold < f.fold) as ab, regr_slope(a.y, a.z) filter (a.fold <> f.fold) as bp, regr_intercept(a.y, a.z) filter (a.fold <> f.fold) as ap from fo a, (select unnest(range(5)) as fold) f group by all),
cv as (select treatment, candidate, transform, lag, 1 - sum(pow(y - ab - bb * z, 2)) filter (nb >= 12) / sum(pow(y - my, 2)) filter (nb >= 12) as r2_cv, 1 - sum(pow(y - ap - bp * z, 2)) / sum(pow(y - my, 2)) as r2_cv_pooled from fo join fb using (treatment, candidate, transform, lag, fold) group by all),
st as (select f.* replace (case when able then f.r2 end as r2), case when able then least(1, greatest(-1, r2_cv)) end as r2_cv, case when able then least(1, greatest(-1, r2_cv_pooled)) end as r2_cv_pooled, case when able and "rows" > 2 then sqrt(f.r2 * ("rows" - 2) / (1 - f.r2)) end as t, greatest(case when m1 >= 3 and l1 < 1 then sqrt(l1 * (m1 - 2) / (1 - l1)) end, case when m2 >= 3 and l2 < 1 then sqrt(l2 * (m2 - 2) / (1 - l2)) end) as t_pre,
  coalesce((select max(sqrt(o.r2)) from fs o where o."rows" >= 3 and o.candidate = f.candidate and o.transform = f.transform and o.lag = f.lag and o.treatment <> f.treatment), 0) as rho from (select *, "rows" >= 24 and spread >= 1e-12 as able from fs) f left join cv using (treatment, candidate, transform, lag)),
ck as (select *, r2_cv_pooled - r2_cv as gap, {normal_p_sql('t')} <= 0.1 and t is not null as directed, r2_cv is not null and r2_cv >= 0 and r2_cv_pooled - r2_cv <= 0.25 as chained, coalesce(t_pre <= 2, true) as led, rho < 0.3 as specific, coalesce(t * t < 10, false) as weak from st),
sc as (select *, (0.4 * least(1, t / 10) + 0.25 * least(1, ln(1 + t * t) / ln(401)) + 0.2 * r2 + 0.15 * greatest(0, r2_cv)) * case when directed then 1 else 0.65 end * case when chained then 1 else 0.6 end * case when led then 1 else 0.85 end * case when specific then 1 else 0.85 end * case when weak then 0.55 else 1 end * case when able then 1 end as score from ck),
rk as (select *, row_number() over (partition by treatment order by round(score, 10) desc nulls last, candidate, transform, lag) as place from sc), sl as (select *, place <= 3 and able and directed and chained as selected from rk)"""


def _screen(spark, d):
    w = Window.partitionBy("series").orderBy("date")
    treatments = panel_m(spark, d).select(F.col("series").alias("treatment"), "date", (F.col("value") - F.lag("value").over(w)).alias("y"))
    candidates = panel_nation(spark, d).withColumnRenamed("series", "candidate")
    pairs = treatments.select("treatment").distinct().crossJoin(candidates.select("candidate").distinct())  # names only
    return instruments.instrument_screen(treatments, candidates, pairs, ["diff", "logdiff", "innov"], max_lag=2, top=3)


@query("iv_candidate_mining", f"""{SCREEN} select treatment, candidate, transform, lag, "rows", round(t, 4) as first_stage_t, round(r2, 6) as partial_r2, round(r2_cv, 5) as r2_cv, round(r2_cv_pooled, 5) as r2_cv_pooled, round(gap, 5) as cv_leak_gap, round(t_pre, 4) as t_pre_max, round(rho, 5) as rho_max_other,
directed as pass_directionality, chained as forward_chain_ok, led as pretrend_ok, specific as specificity_ok, weak as weak_iv, round(score, 5) as score, place, selected from sl""")
def _(spark, d):
    out = _screen(spark, d)
    return out.select("treatment", "candidate", "transform", "lag", "rows", F.round("first_stage_t", 4).alias("first_stage_t"), F.round("partial_r2", 6).alias("partial_r2"), *rounded("r2_cv", "r2_cv_pooled", "cv_leak_gap", digits=5), F.round("t_pre_max", 4).alias("t_pre_max"), F.round("rho_max_other", 5).alias("rho_max_other"), "pass_directionality", "forward_chain_ok", "pretrend_ok", "specificity_ok", "weak_iv", F.round("score", 5).alias("score"), "place", "selected")


@query("iv_candidate_decisions", f"""{SCREEN}, dc as (select treatment, candidate, max_by(selected, -place) as selected, bool_or(able) as able, concat_ws(';', case when not bool_or(able) then 'FEASIBILITY_FAIL' end, case when not bool_or(directed) then 'DIRECTIONALITY_FAIL' end, case when not bool_or(chained) then 'FORWARD_CHAIN_FAIL' end, case when not bool_or(led) then 'PRETREND_FAIL' end, case when not bool_or(specific) then 'SPECIFICITY_FAIL' end, case when bool_or(weak) then 'WEAK_IV' end) as reasons from sl group by all)
select treatment, candidate, case when not able then 'drop' when selected then 'select' else 'demote' end as decision, case when reasons <> '' then reasons when selected then 'PASS' else 'RANK' end as reasons from dc""")
def _(spark, d):
    return instruments.screen_decisions(_screen(spark, d))


def _instrumented(spark, d):
    """(series, date, y, d, z1, z2, w): each nation's value and its last one, two nations as instruments, and one that they move."""
    panel = panel_nation(spark, d)
    one = {c: panel.filter(F.col("series") == s).select("date", F.col("value").alias(c)) for c, s in (("d", "NATION_0"), ("z1", "NATION_5"), ("z2", "NATION_7"))}
    w = F.lag("value").over(Window.partitionBy("series").orderBy("date"))
    rows = panel.filter("series not in ('NATION_0', 'NATION_5', 'NATION_7')").select("series", "date", F.col("value").alias("y"), w.alias("w"))
    for c in one.values():
        rows = rows.join(c, "date")
    return rows.dropna()


INSTRUMENTS = f"""with {PANEL_NATION}, a as (select series, date, value as y, lag(value) over (partition by series order by date) as w from panel_nation where series not in ('NATION_0', 'NATION_5', 'NATION_7')),
j as (select a.*, d.value as d, p.value as z1, q.value as z2 from a join panel_nation d on d.date = a.date and d.series = 'NATION_0' join panel_nation p on p.date = a.date and p.series = 'NATION_5' join panel_nation q on q.date = a.date and q.series = 'NATION_7' where w is not null),
s as (select series, count(*) as n, avg(w) as mw, avg(y) as my, avg(d) as md, avg(z1) as m1, avg(z2) as m2, regr_slope(y, w) as sy, regr_slope(d, w) as sd, regr_slope(z1, w) as s1, regr_slope(z2, w) as s2 from j group by series),
c as (select j.series, date, n, y - my - sy * (w - mw) as y, d - md - sd * (w - mw) as d, z1 - m1 - s1 * (w - mw) as z1, z2 - m2 - s2 * (w - mw) as z2 from j join s using (series)),
m as (select series, any_value(n) as n, sum(z1 * z1) as aa, sum(z1 * z2) as ab, sum(z2 * z2) as bb, sum(z1 * d) as ad, sum(z2 * d) as bd, sum(d * d) as dd, sum(z1 * y) as ay, sum(z2 * y) as by_ from c group by series),
p as (select *, (bb * ad - ab * bd) / (aa * bb - ab * ab) as p1, (aa * bd - ab * ad) / (aa * bb - ab * ab) as p2 from m)"""


@query("first_stage_strength_multi", f"""{INSTRUMENTS}, u as (select c.series, date, z1 * (d - p1 * z1 - p2 * z2) as e, z2 * (d - p1 * z1 - p2 * z2) as f from c join p using (series)),
l as (select *, coalesce(lag(e) over k, 0) as e1, coalesce(lag(f) over k, 0) as f1, coalesce(lag(e, 2) over k, 0) as e2, coalesce(lag(f, 2) over k, 0) as f2 from u window k as (partition by series order by date)),
o as (select series, sum(e * e + 4.0 / 3 * e * e1 + 2.0 / 3 * e * e2) as ee, sum(f * f + 4.0 / 3 * f * f1 + 2.0 / 3 * f * f2) as ff, sum(e * f + 2.0 / 3 * (e * f1 + f * e1) + 1.0 / 3 * (e * f2 + f * e2)) as ef from l group by series),
t as (select p.*, ee, ff, ef, aa * bb - ab * ab as det, ee * ff - ef * ef as odet from p join o using (series)),
w as (select *, (bb * bb * ee - 2 * ab * bb * ef + ab * ab * ff) / (det * det) as v1, (ab * ab * ee - 2 * aa * ab * ef + aa * aa * ff) / (det * det) as v2, (ff * ad * ad - 2 * ef * ad * bd + ee * bd * bd) / odet as wald from t)
select series, n, case when n >= 4 then round(greatest(abs(p1) / sqrt(v1), abs(p2) / sqrt(v2)), 4) end as t, case when n >= 4 then round(wald / 2, 4) end as f_eff, case when n >= 4 then round(exp(-wald / 2), 6) end as underid_p, case when n >= 4 then round((p1 * ad + p2 * bd) / dd, 6) end as partial_r2 from w""")
def _(spark, d):
    out = instruments.first_stage_strength(_instrumented(spark, d), ["series"], "date", "d", ["z1", "z2"], ["w"], lags=2)
    return out.select("series", "n", *rounded("t", "f_eff", digits=4), *rounded("underid_p", "partial_r2"))


@query("two_stage_multi", f"""{INSTRUMENTS}, b as (select *, (p1 * ay + p2 * by_) / (p1 * ad + p2 * bd) as beta, p1 * ad + p2 * bd as hd from p),
u as (select c.series, date, (p1 * z1 + p2 * z2) * (y - beta * d) as e from c join b using (series)),
l as (select *, coalesce(lag(e) over k, 0) as e1, coalesce(lag(e, 2) over k, 0) as e2 from u window k as (partition by series order by date)),
o as (select series, sqrt(greatest(sum(e * e + 4.0 / 3 * e * e1 + 2.0 / 3 * e * e2), 0)) as root from l group by series)
select series, n, round(beta, 5) as beta, round(root / abs(hd), 5) as se, round({normal_p_sql('(beta * abs(hd) / root)')}, 5) as p from b join o using (series) where n >= 4""")
def _(spark, d):
    return instruments.two_stage(_instrumented(spark, d), ["series"], "date", "y", "d", ["z1", "z2"], ["w"], lags=2).select("series", "n", *rounded("beta", "se", "p", digits=5))


@query("ar_grid_multi")
def _(spark, d):
    """What two instruments together do not reject."""
    return instruments.anderson_rubin(_instrumented(spark, d), ["series"], "date", "y", "d", ["z1", "z2"], ["w"], lags=2).select("series", "n", *rounded("theta", "lo", "hi", digits=5), "status")
