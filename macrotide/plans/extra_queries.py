"""More queries: catalogs, scenarios, routes, interactions, mediation, instrument screens and Denton panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr, rounded
from macrotide.operators import attribution, calendar, denton, policy, regression
from macrotide.plans.registry import query
from macrotide.plans.regression_queries import _hac_sql
from macrotide.sources.panels import PANEL_M, PANEL_NATION, RESULTS, normal_p_sql, panel_m, panel_nation, results, table

N, M, R = f"with {PANEL_NATION}", f"with {PANEL_M}", f"with {RESULTS}"
QEND = "last_day((date_trunc('quarter', date) + interval 2 month)::date)"


@query("read_series_catalog", "with l as (select p_partkey::varchar || '|' || p_name || '|' || case when p_size % 3 = 0 then '' when p_size % 3 = 1 then 'm' else 'q' end || '|' || p_type as line from part), c as (select string_split(line, '|')[1]::bigint as id, string_split(line, '|')[2] as name, nullif(string_split(line, '|')[3], '') as freq, string_split(line, '|')[4] as units from l), o as (select p_partkey as id, case when p_retailprice > 950 then 'q' end as freq from part) select id, name, coalesce(c.freq, o.freq, 'unknown') as freq, units from c left join o using (id)")
def _(spark, d):
    part = table(spark, d, "part")
    freq = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "m").otherwise("q")
    fields = F.split(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", freq, "p_type"), r"\|")
    catalog = part.select(fields[0].cast("long").alias("id"), fields[1].alias("name"), F.nullif(fields[2], F.lit("")).alias("freq"), fields[3].alias("units"))
    other = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_retailprice") > 950, "q").alias("known"))
    return catalog.join(other, "id", "left").select("id", "name", F.coalesce("freq", "known", F.lit("unknown")).alias("freq"), "units")


@query("scenario_panels", f"{N}, q as (select date, quantile_cont(value, 0.1) as q10, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.9) as q90 from panel_nation group by date), l as (select date, 'q10' as label, q10 as v from q union all select date, 'q50', q50 from q union all select date, 'q90', q90 from q) select label, date, round(v, 6) as dense, case when month(date) % 3 = 0 then round(v, 6) end as sparse from l")
def _(spark, d):
    q = panel_nation(spark, d).groupBy("date").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    rows = q.select("date", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col("q")[i].alias("v")) for i, n in enumerate(("q10", "q50", "q90"))])).alias("x")).select("date", "x.*")
    return rows.select("label", "date", F.round("v", 6).alias("dense"), F.when(F.month("date") % 3 == 0, F.round("v", 6)).alias("sparse"))


CHOICES = """select estimator, case when n % 7 = 0 then 'error' else 'OK ' end as status, case when horizon % 3 = 0 then ' Denton' when horizon % 3 = 1 then 'chow_lin' end as method_used, 'litterman' as method, case when horizon % 2 = 0 then ' q -> m' end as route, 'y' as low, case when horizon < 4 then 'Q' else 'M' end as high, case when outcome > '3' then 'Sum' end as constraint_, 'last' as conversion from results"""


@query("policy_route_compare", f"""{R}, c as ({CHOICES}), u as (select estimator, case when route is not null then 'Q->M' else 'Y->' || high end as route, coalesce(lower(constraint_), 'last') as constraint_, lower(trim(coalesce(method_used, method))) as method, count(*) as n from c where lower(trim(status)) = 'ok' group by all)
select coalesce(a.route, b.route) as route, coalesce(a.constraint_, b.constraint_) as constraint, coalesce(a.method, b.method) as method, coalesce(a.n, 0) as baseline, coalesce(b.n, 0) as candidate, coalesce(b.n, 0) - coalesce(a.n, 0) as delta
from (select * from u where estimator = 'lp') a full join (select * from u where estimator = 'dml') b on a.route = b.route and a.constraint_ = b.constraint_ and a.method = b.method""")
def _(spark, d):
    """The ledger's rows as choices of methods, of raw estimates as one run and of those within flags as the other."""
    h = F.col("horizon")
    rows = results(spark, d).select(
        "estimator", F.when(F.col("n") % 7 == 0, "error").otherwise("OK ").alias("status"), F.when(h % 3 == 0, " Denton").when(h % 3 == 1, "chow_lin").alias("method_used"), F.lit("litterman").alias("method"),
        F.when(h % 2 == 0, " q -> m").alias("route"), F.lit("y").alias("low"), F.when(h < 4, "Q").otherwise("M").alias("high"), F.when(F.col("outcome") > "3", "Sum").alias("constraint"), F.lit(None).cast("string").alias("constraint_type"), F.lit("last").alias("conversion"),
    )
    return policy.usage_compare(*[rows.filter(F.col("estimator") == e) for e in ("lp", "dml")])


@query("policy_metric_compare", f"{R}, a as (select treatment, outcome, avg(se) as v from results where estimator = 'lp' group by all), b as (select treatment, outcome, avg(se) as v from results where estimator = 'dml' group by all) select coalesce(a.treatment, b.treatment) as treatment, coalesce(a.outcome, b.outcome) as outcome, round(a.v, 9) as baseline, round(b.v, 9) as candidate, round(b.v - a.v, 9) as delta, round(b.v / nullif(a.v, 0), 6) as ratio from a full join b on a.treatment = b.treatment and a.outcome = b.outcome")
def _(spark, d):
    means = results(spark, d).groupBy("estimator", "treatment", "outcome").agg(F.avg("se").alias("value"))
    out = policy.metric_compare(*[means.filter(F.col("estimator") == e) for e in ("lp", "dml")], ["treatment", "outcome"])
    return out.select("treatment", "outcome", *rounded("baseline", "candidate", "delta", digits=9), *rounded("ratio"))


@query("lp_state_interaction", f"""{N}, t as (select date, value as a, value * (case when quarter(date) <= 2 then 1 else 0 end) as b from panel_nation where series = 'NATION_0'), r as (select p.series, value as y, a, b from panel_nation p join t using (date) where p.series <> 'NATION_0'),
m as (select series, count(*) as n, regr_sxx(y, a) as aa, regr_sxx(y, b) as bb, regr_syy(y, a) as yy, regr_sxy(b, a) as ab, regr_sxy(y, a) as ay, regr_sxy(y, b) as b_y from r group by series),
f as (select series, n, (bb * ay - ab * b_y) / (aa * bb - ab * ab) as base, (aa * b_y - ab * ay) / (aa * bb - ab * ab) as gap, aa, bb, ab, yy, ay, b_y from m),
s as (select *, (yy - base * ay - gap * b_y) / (n - 3) as s2 from f)
select series, n, round(base, 4) as base, round(gap, 4) as gap, round(base + gap, 4) as in_state, round(sqrt(s2 * (aa + bb - 2 * ab) / (aa * bb - ab * ab)), 4) as in_state_se from s""")
def _(spark, d):
    panel = panel_nation(spark, d)
    t = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("a"), (F.col("value") * (F.quarter("date") <= 2).cast("int")).alias("b"))
    rows = panel.filter("series <> 'NATION_0'").withColumnRenamed("value", "y").join(t, "date")
    m = regression.gram(rows, ["series"], "y", ["a", "b"])
    base, gap = regression.two_slopes("a", "b", "y")
    m = m.withColumns({"base": base, "gap": gap}).withColumn("s2", F.expr("(s_y_y - base * s_a_y - gap * s_b_y) / (n - 3)"))
    # variance of the sum of both slopes: s2 * (S_aa + S_bb - 2 S_ab) / det
    return m.select("series", "n", *rounded("base", "gap", digits=4), F.round(F.col("base") + F.col("gap"), 4).alias("in_state"), F.round(F.sqrt(F.expr("s2 * (s_a_a + s_b_b - 2 * s_a_b) / (s_a_a * s_b_b - s_a_b * s_a_b)")), 4).alias("in_state_se"))


@query("channel_mediation", f"""with {RESULTS}, rs as (select treatment, horizon, case when outcome in ('1-URGENT', '2-HIGH') then 'factor' else 'outcome' end as kind, outcome as name, estimate as beta, p from results where estimator = 'lp'),
lk as (select o.name as outcome, f.name as factor, corr(o.beta, f.beta) as beta, regr_r2(o.beta, f.beta) as share from rs o join rs f using (treatment, horizon) where o.kind = 'outcome' and f.kind = 'factor' group by all),
ch as (select o.treatment, o.horizon, o.name as outcome, f.name as factor, o.beta as outcome_beta, f.beta * lk.beta as channel, f.beta * lk.beta * share as weighted, greatest(o.p, f.p) as screening_p from rs o join lk on lk.outcome = o.name join rs f on f.name = lk.factor and f.treatment = o.treatment and f.horizon = o.horizon where o.kind = 'outcome' and f.kind = 'factor'),
rk as (select *, row_number() over (order by screening_p, treatment, outcome, factor, horizon) as i, count(*) over () as n from ch), q_ as (select *, least(1, min(screening_p * n / i) over (order by screening_p, treatment, outcome, factor, horizon rows between current row and unbounded following)) as q from rk)
select treatment, horizon, outcome, factor, round(channel, 9) as channel, round(weighted, 9) as weighted, round(case when abs(outcome_beta) > 1e-12 then weighted / outcome_beta end, 5) as mediated_share, round(screening_p, 6) as screening_p, round(q, 6) as q, case when screening_p <= 0.05 then 'strong' when screening_p <= 0.1 then 'moderate' else 'weak' end as priority, q <= 0.1 as robust,
row_number() over (order by round(q, 9), abs(round(weighted, 9)) desc, abs(round(channel, 9)) desc, round(screening_p, 9), treatment, outcome, factor, horizon) as place from q_""")
def _(spark, d):
    """Two priorities as factors of the three others: responses from the ledger, links from how responses move together."""
    rows = results(spark, d).filter("estimator = 'lp'")
    responses = rows.select("treatment", "horizon", F.when(F.col("outcome").isin("1-URGENT", "2-HIGH"), "factor").otherwise("outcome").alias("kind"), F.col("outcome").alias("name"), F.col("estimate").alias("beta"), "p")
    o, f = (responses.filter(F.col("kind") == k).select("treatment", "horizon", F.col("name").alias(k), F.col("beta").alias(b)) for k, b in (("outcome", "y"), ("factor", "x")))
    links = o.join(f, ["treatment", "horizon"]).groupBy("outcome", "factor").agg(corr("y", "x").alias("beta"), F.regr_r2("y", "x").alias("share"), F.regr_r2("y", "x").alias("r2"))
    ranked = attribution.rank_channels(attribution.channel_mediation(responses, links))
    return ranked.select("treatment", "horizon", "outcome", "factor", *rounded("channel", "weighted", digits=9), F.round("mediated_share", 5).alias("mediated_share"), *rounded("screening_p", "q"), "priority", "robust", "place")


@query("first_stage_strength", f"""{N}, t as (select date, value as y from panel_nation where series = 'NATION_0'), r as (select p.series, p.date, y, value as x from panel_nation p join t using (date) where p.series <> 'NATION_0'), {_hac_sql('r', 'series', 'date', 2)}, q as (select series, regr_r2(y, x) as r2 from r group by series)
select series, n, round(beta, 5) as beta, round(beta / nullif(se, 0), 4) as t_hac, round(pow(beta / nullif(se, 0), 2), 3) as wald_f, round(r2, 6) as partial_r2, round({normal_p_sql('(beta / nullif(se, 0))')}, 6) as underid_p from hac join q using (series)""")
def _(spark, d):
    panel = panel_nation(spark, d)
    t = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("y"))
    rows = panel.filter("series <> 'NATION_0'").withColumnRenamed("value", "x").join(t, "date")
    fit = regression.hac_slope(rows, ["series"], "date", "y", "x", 2)
    r2 = rows.groupBy("series").agg(F.regr_r2("y", "x").alias("r2"))
    return fit.join(r2, "series").select("series", "n", F.round("beta", 5).alias("beta"), F.round("z", 4).alias("t_hac"), F.round(F.col("z") * F.col("z"), 3).alias("wald_f"), F.round("r2", 6).alias("partial_r2"), F.round("p", 6).alias("underid_p"))


@query("iv_candidate_screen", f"""{N}, t as (select date, value - lag(value) over (order by date) as d, lead(value) over (order by date) - value as d1 from panel_nation where series = 'NATION_0'), c as (select series as candidate, date, value - lag(value) over (partition by series order by date) as diff, value as level from panel_nation where series <> 'NATION_0'),
x as (select candidate, date, 'diff' as transform, diff as v from c union all select candidate, date, 'level', level from c), l as (select candidate, transform, k.lag, date, lag(v, k.lag) over (partition by candidate, transform, k.lag order by date) as z0, v from x, (select unnest([0, 1, 2]) as lag) k),
z as (select candidate, transform, lag, date, case when lag = 0 then v else z0 end as z from l), s as (select candidate, transform, lag, count(*) as n, regr_r2(d, z) as r2, abs(corr(d1, z)) as lead_corr from z join t using (date) where z is not null and d is not null and d1 is not null group by all),
k as (select *, r2 * (n - 2) / nullif(1 - r2, 0) as f, r2 - 0.5 * lead_corr * lead_corr as score from s) select candidate, transform, lag::integer as lag, n, round(f, 4) as f, round(r2, 6) as r2, round(lead_corr, 6) as lead_corr, round(score, 6) as score, row_number() over (order by round(score, 9) desc, candidate, transform, lag) as place from k qualify place <= 20""")
def _(spark, d):
    panel = panel_nation(spark, d)
    one = F.col("series") == "NATION_0"
    w = Window.partitionBy("series").orderBy("date")
    moves = panel.withColumns({"diff": F.col("value") - F.lag("value").over(w), "ahead": F.lead("value").over(w) - F.col("value")})
    t = moves.filter(one).select("date", F.col("diff").alias("d"), F.col("ahead").alias("d1"))
    wide = moves.filter(~one).withColumns({f"{x}{k}": F.lag(x, k).over(w) if k else F.col(x) for x in ("diff", "value") for k in (0, 1, 2)})
    tags = [F.struct(F.lit("diff" if x == "diff" else "level").alias("transform"), F.lit(k).alias("lag"), F.col(f"{x}{k}").alias("z")) for x in ("diff", "value") for k in (0, 1, 2)]
    rows = wide.select(F.col("series").alias("candidate"), "date", F.explode(F.array(*tags)).alias("x")).select("candidate", "date", "x.*").join(t, "date").filter("z is not null and d is not null and d1 is not null")
    s = rows.groupBy("candidate", "transform", "lag").agg(F.count("*").alias("n"), F.regr_r2("d", "z").alias("r2"), F.abs(corr("d1", "z")).alias("lead_corr"))
    s = s.withColumns({"f": F.col("r2") * (F.col("n") - 2) / F.when(F.col("r2") != 1, 1 - F.col("r2")), "score": F.col("r2") - 0.5 * F.col("lead_corr") * F.col("lead_corr")})
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "candidate", "transform", "lag"))).filter("place <= 20")  # one row for each screen
    return s.select("candidate", "transform", "lag", "n", F.round("f", 4).alias("f"), *rounded("r2", "lead_corr", "score"), "place")


@query("denton_panel")
def _(spark, d):
    """Quarterly sums of the monthly panel spread over months again."""
    low = panel_m(spark, d).groupBy("series", calendar.quarter_end(F.col("date")).alias("date")).agg(F.sum("value").alias("value"))
    return denton.denton_panel(low, 3).select("series", "date", "slot", *rounded("path"))


@query("denton_prior_panel")
def _(spark, d):
    """Yearly means of every nation spread over months, near a path through their anchors, without negative months."""
    low = panel_nation(spark, d).groupBy("series", F.make_date(F.year("date"), F.lit(12), F.lit(31)).alias("date")).agg(F.avg("value").alias("value"))
    return denton.denton_panel(low, 12, "mean", "prior", span=12, power=1, positive=True).select("series", "date", "slot", *rounded("path"))
