"""Queries of multiple testing, ranking and comparison over a results ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr, rounded, safe_ln
from macrotide.operators import comparison, controls, gates, inference, selection
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_NATION, RESULTS, panel_nation, results

R = f"with {RESULTS}"
KEY = ["treatment", "outcome", "horizon"]


@query("bh_by_holm_adjust", f"""{R}, k as (select *, row_number() over (partition by estimator, treatment order by p, outcome, horizon) as i, count(*) over (partition by estimator, treatment) as m from results),
h as (select *, list_sum([1.0 / x for x in range(1, m + 1)]) as h from k)
select estimator, treatment, outcome, horizon, round(least(1, min(p * m / i) over (partition by estimator, treatment order by i rows between current row and unbounded following)), 6) as bh,
round(least(1, min(p * m / i * h) over (partition by estimator, treatment order by i rows between current row and unbounded following)), 6) as "by",
round(least(1, max((m - i + 1) * p) over (partition by estimator, treatment order by i)), 6) as holm from h""")
def _(spark, d):
    out = inference.step_up(results(spark, d), ["estimator", "treatment"], ["outcome", "horizon"])
    return out.select("estimator", *KEY, *rounded("bh", "by", "holm"))


DRAWS = """nd as (select treatment, outcome, horizon, d.draw, 3.5 * ('0x' || substr(md5(treatment || '|' || outcome || '|' || horizon || '|' || d.draw), 1, 8))::bigint::double / 4294967296.0 as null_t from results, (select unnest(range(1, 100)) as draw) d where estimator = 'lp')"""


@query("romano_wolf", f"""{R}, {DRAWS}, k as (select treatment, outcome, horizon, abs(z) as abs_t, row_number() over (partition by treatment order by abs(z) desc, outcome, horizon) as place from results where estimator = 'lp'),
x as (select k.*, draw, max(null_t) over (partition by k.treatment, draw order by place desc) as top from nd join k using (treatment, outcome, horizon)),
c as (select treatment, outcome, horizon, place, (1 + sum((top >= abs_t)::int)) / (count(*) + 1) as raw from x group by all)
select treatment, outcome, horizon, place, round(max(raw) over (partition by treatment order by place), 6) as romano_wolf from c""")
def _(spark, d):
    rows = results(spark, d).filter("estimator = 'lp'").select(*KEY, F.abs("z").alias("abs_t"))
    draws = inference.null_draws(rows.select(*KEY), 99, KEY).withColumnRenamed("abs_t", "null_t")
    return inference.romano_wolf(rows, draws, ["treatment"], ["outcome", "horizon"]).select(*KEY, "place", *rounded("romano_wolf"))


@query("nc_calibration", f"""{R}, c as (select abs(z) as v from results where outcome = '5-LOW'), s as (select greatest(1, quantile_cont(v, 0.95) / 1.96) as inflation, count(*) as n_controls, list(v) as nulls from c)
select estimator, treatment, outcome, horizon, round(inflation, 6) as inflation, n_controls, round((1 + len(list_filter(nulls, lambda v: v >= abs(z)))) / (1 + n_controls), 6) as empirical_p from results, s where outcome <> '5-LOW' and n_controls >= 20""")
def _(spark, d):
    rows = results(spark, d)
    manifest = rows.select("outcome").distinct().filter("outcome = '5-LOW'")
    controls, targets = rows.join(manifest, "outcome", "left_semi"), rows.join(manifest, "outcome", "left_anti")
    return inference.control_calibration(targets, controls.select(*targets.columns)).select("estimator", *KEY, *rounded("inflation"), "n_controls", *rounded("empirical_p"))


@query("nc_semi_join", f"{R}, m as (select distinct treatment, outcome, horizon from results where estimator = 'dml' and p > 0.5) select estimator, treatment, outcome, horizon, p, (exists (select 1 from m where m.treatment = r.treatment and m.outcome = r.outcome and m.horizon = r.horizon))::int as is_control from results r")
def _(spark, d):
    rows = results(spark, d)
    manifest = rows.filter("estimator = 'dml' and p > 0.5").select(*KEY).distinct()
    inside = rows.join(manifest, KEY, "left_semi").withColumn("is_control", F.lit(1))
    return inside.unionByName(rows.join(manifest, KEY, "left_anti").withColumn("is_control", F.lit(0))).select("estimator", *KEY, "p", "is_control")


@query("outcome_ranking", f"""{R}, k as (select *, row_number() over (partition by estimator, treatment order by abs(estimate) desc, outcome, horizon) as place from results)
select estimator, treatment, outcome, horizon, estimate, place, case when place <= 3 and p < 0.1 then 'high' when place <= 10 then 'medium' else 'low' end as priority, (p < 0.1)::int as key_flag from k""")
def _(spark, d):
    w = Window.partitionBy("estimator", "treatment").orderBy(F.desc(F.abs("estimate")), "outcome", "horizon")
    rows = results(spark, d).withColumn("place", F.row_number().over(w))
    priority = F.when((F.col("place") <= 3) & (F.col("p") < 0.1), "high").when(F.col("place") <= 10, "medium").otherwise("low")
    return rows.select("estimator", *KEY, "estimate", "place", priority.alias("priority"), (F.col("p") < 0.1).cast("int").alias("key_flag"))


BOTH = "b as (select l.treatment, l.outcome, l.horizon, l.estimate as lp, m.estimate as dml, l.p as p_lp, m.p as p_dml from results l join results m using (treatment, outcome, horizon) where l.estimator = 'lp' and m.estimator = 'dml')"


def _both(rows):
    """Keys that both estimators have, with their estimates and p: one aggregation, no self join."""
    own = [F.max(F.when(F.col("estimator") == e, F.col(c))).alias(n) for e in ("lp", "dml") for c, n in (("estimate", e), ("p", f"p_{e}"))]
    return rows.groupBy(*KEY).agg(*own).filter("lp is not null and dml is not null")


@query("estimator_alignment", f"""{R}, {BOTH} select treatment, outcome, count(*) as n, round(avg((sign(lp) = sign(dml))::int), 6) as sign_agreement, case when count(*) >= 3 then round(corr(lp, dml), 6) end as correlation, round(avg(abs(lp - dml)), 6) as mean_delta, round(quantile_cont(abs(lp - dml), 0.5), 6) as median_delta, round(avg((p_lp < 0.1)::int), 6) as share_lp, round(avg((p_dml < 0.1)::int), 6) as share_dml from b group by grouping sets ((), (treatment), (outcome))""")
def _(spark, d):
    both = _both(results(spark, d))
    delta = F.abs(F.col("lp") - F.col("dml"))
    return both.groupingSets([[], ["treatment"], ["outcome"]], "treatment", "outcome").agg(
        F.count("*").alias("n"), F.round(F.avg((F.signum("lp") == F.signum("dml")).cast("int")), 6).alias("sign_agreement"), F.when(F.count("*") >= 3, F.round(corr("lp", "dml"), 6)).alias("correlation"), F.round(F.avg(delta), 6).alias("mean_delta"),
        F.round(F.percentile(delta, F.lit(0.5)), 6).alias("median_delta"), F.round(F.avg((F.col("p_lp") < 0.1).cast("int")), 6).alias("share_lp"), F.round(F.avg((F.col("p_dml") < 0.1).cast("int")), 6).alias("share_dml"))


@query("estimator_disagreement", f"""{R}, {BOTH}, k as (select *, abs(lp - dml) as delta, row_number() over (partition by treatment order by abs(lp - dml) desc, outcome, horizon) as place from b)
select treatment, outcome, horizon, round(delta, 6) as delta, (sign(lp) <> sign(dml))::int as sign_flip, ((p_lp < 0.1) <> (p_dml < 0.1))::int as significance_mismatch, place, treatment || '/' || outcome || '/h' || horizon as label from k where place <= 5""")
def _(spark, d):
    rows = _both(results(spark, d)).withColumn("delta", F.abs(F.col("lp") - F.col("dml")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("treatment").orderBy(F.desc("delta"), "outcome", "horizon"))).filter("place <= 5")
    return rows.select(*KEY, *rounded("delta"), (F.signum("lp") != F.signum("dml")).cast("int").alias("sign_flip"), ((F.col("p_lp") < 0.1) != (F.col("p_dml") < 0.1)).cast("int").alias("significance_mismatch"), "place", F.concat_ws("/", "treatment", "outcome", F.concat(F.lit("h"), F.col("horizon"))).alias("label"))


@query("support_counts", f"{R} select estimator, treatment, count(*) as n, count_if(p < 0.05)::bigint as n_p05, count_if(p < 0.1)::bigint as n_p10, count_if(estimate > 0)::bigint as n_positive from results group by grouping sets ((estimator), (estimator, treatment))")
def _(spark, d):
    return results(spark, d).groupingSets([["estimator"], ["estimator", "treatment"]], "estimator", "treatment").agg(F.count("*").alias("n"), F.count_if(F.col("p") < 0.05).alias("n_p05"), F.count_if(F.col("p") < 0.1).alias("n_p10"), F.count_if(F.col("estimate") > 0).alias("n_positive"))


SPECS = """s as (select treatment, outcome, horizon, estimator as tag, estimate, p from results union all select treatment, outcome, horizon, 'c', estimate * (case when horizon % 2 = 0 then 0.5 else -0.25 end), least(1, p * 2) from results where estimator = 'lp')"""


def _specs(rows):
    other = rows.filter("estimator = 'lp'").select(*KEY, F.lit("c").alias("tag"), (F.col("estimate") * F.when(F.col("horizon") % 2 == 0, 0.5).otherwise(-0.25)).alias("estimate"), F.least(F.lit(1.0), F.col("p") * 2).alias("p"))
    return rows.select(*KEY, F.col("estimator").alias("tag"), "estimate", "p").unionByName(other)


@query("wspec_shift", f"""{R}, {SPECS}, w as (select treatment, outcome, horizon, max(case when tag = 'lp' then estimate end) as lp, max(case when tag = 'dml' then estimate end) as dml, max(case when tag = 'c' then estimate end) as c, max(case when tag = 'lp' then p end) as plp, max(case when tag = 'dml' then p end) as pdml, max(case when tag = 'c' then p end) as pc from s group by all)
select treatment, outcome, horizon, round(lp, 6) as lp, round(dml, 6) as dml, round(c, 6) as c, (sign(lp) <> sign(dml) or sign(lp) <> sign(c))::int as sign_flip, ((plp < 0.1) <> (pdml < 0.1) or (plp < 0.1) <> (pc < 0.1))::int as p10_flip, round(greatest(abs(lp - dml), abs(lp - c)), 6) as max_delta, round((abs(lp - dml) + abs(lp - c)) / 2, 6) as mean_delta from w where lp is not null and dml is not null and c is not null""")
def _(spark, d):
    w = _specs(results(spark, d)).groupBy(*KEY).pivot("tag", ["lp", "dml", "c"]).agg(F.max("estimate").alias("e"), F.max("p").alias("p")).filter("lp_e is not null and dml_e is not null and c_e is not null")
    lp, dml, c = (F.col(f"{t}_e") for t in ("lp", "dml", "c"))
    sig = [F.col(f"{t}_p") < 0.1 for t in ("lp", "dml", "c")]
    return w.select(*KEY, F.round(lp, 6).alias("lp"), F.round(dml, 6).alias("dml"), F.round(c, 6).alias("c"), ((F.signum(lp) != F.signum(dml)) | (F.signum(lp) != F.signum(c))).cast("int").alias("sign_flip"), ((sig[0] != sig[1]) | (sig[0] != sig[2])).cast("int").alias("p10_flip"), F.round(F.greatest(F.abs(lp - dml), F.abs(lp - c)), 6).alias("max_delta"), F.round((F.abs(lp - dml) + F.abs(lp - c)) / 2, 6).alias("mean_delta"))


@query("bundle_flips", f"""{R}, {SPECS}, d as (select a.treatment, b.tag, (sign(a.estimate) <> sign(b.estimate))::int as flip, abs(a.estimate - b.estimate) as delta from s a join s b using (treatment, outcome, horizon) where a.tag = 'lp' and b.tag <> 'lp')
select treatment, tag, count(*) as n, sum(flip)::bigint as flips, round(max(delta), 6) as max_delta from d group by all""")
def _(spark, d):
    specs = _specs(results(spark, d))
    base = specs.filter("tag = 'lp'").select(*KEY, F.col("estimate").alias("base"))
    rows = specs.filter("tag <> 'lp'").join(base, KEY)
    return rows.groupBy("treatment", "tag").agg(F.count("*").alias("n"), F.sum((F.signum("base") != F.signum("estimate")).cast("int")).alias("flips"), F.round(F.max(F.abs(F.col("base") - F.col("estimate"))), 6).alias("max_delta"))


CHECKS = f"""{BOTH}, pr as (select treatment, outcome, horizon, lead(p) over (partition by treatment, outcome order by horizon) as p_next from results where estimator = 'lp'),
checks as (select treatment, outcome, horizon, sign(lp) = sign(dml) as endpoint, p_dml < 0.2 as calibration, p_next >= 0.1 as lead, not (p_lp < 0.1 and p_dml >= 0.1) as episode, abs(lp - dml) <= 0.5 * abs(lp) as wspec from b left join pr using (treatment, outcome, horizon))"""
GATES = ["endpoint", "calibration", "lead", "episode", "wspec"]


def _checks(rows):
    """Five checks of each key, true where it passes: same sign, calibrated p, nothing a horizon later, significance kept, estimate kept."""
    w = Window.partitionBy("treatment", "outcome").orderBy("horizon")
    after = rows.filter("estimator = 'lp'").select(*KEY, F.lead("p").over(w).alias("p_next"))
    both = _both(rows).join(after, KEY, "left")
    lost = (F.col("p_lp") < 0.1) & (F.col("p_dml") >= 0.1)
    return both.select(*KEY, (F.signum("lp") == F.signum("dml")).alias("endpoint"), (F.col("p_dml") < 0.2).alias("calibration"), (F.col("p_next") >= 0.1).alias("lead"), (~lost).alias("episode"), (F.abs(F.col("lp") - F.col("dml")) <= 0.5 * F.abs("lp")).alias("wspec"))


@query("gate_summary", f"""{R}, {CHECKS} select treatment, outcome, horizon, case when not (endpoint and calibration and coalesce(lead, true) and episode and wspec) then 'demote' else 'hold' end as action,
coalesce(nullif(concat_ws(';', {', '.join(f"case when not {g} then '{g.upper()}_FAIL' end" for g in GATES)}), ''), 'PASS') as reasons from checks""")
def _(spark, d):
    return gates.gate_summary(_checks(results(spark, d)), KEY, GATES)


@query("fragility_shares", f"""{R}, {CHECKS}, s as (select treatment, avg((not lead)::int) as lead_share, avg((not episode)::int) as episode_share, avg((not wspec)::int) as wspec_share from checks group by treatment)
select treatment, round(lead_share, 6) as lead_share, round(episode_share, 6) as episode_share, round(wspec_share, 6) as wspec_share, lead_share >= 0.1 as lead_fragile, episode_share >= 0.1 as episode_fragile, wspec_share >= 0.5 as wspec_fragile, lead_share >= 0.1 or episode_share >= 0.1 or wspec_share >= 0.5 as fragile from s""")
def _(spark, d):
    checks = _checks(results(spark, d)).select("treatment", *[(~F.col(c)).alias(c) for c in ("lead", "episode", "wspec")])
    out = gates.fragility_shares(checks, ["treatment"], {"lead": 0.1, "episode": 0.1, "wspec": 0.5})
    return out.select("treatment", *rounded("lead_share", "episode_share", "wspec_share"), "lead_fragile", "episode_fragile", "wspec_fragile", "fragile")


@query("domain_shift", f"""{R}, k as (select *, row_number() over (partition by estimator, treatment order by abs(estimate) desc, outcome, horizon) as place from results)
select a.treatment, a.outcome, a.horizon, (sign(a.estimate) <> sign(b.estimate))::int as sign_flip, ((a.p < 0.1) <> (b.p < 0.1))::int as significance_flip, b.place - a.place as rank_shift from k a join k b using (treatment, outcome, horizon) where a.estimator = 'lp' and b.estimator = 'dml'""")
def _(spark, d):
    return comparison.domain_shift(results(spark, d), KEY, "estimator", "lp", "dml", ["treatment"])


@query("latest_results", f"""{R}, r as (select *, horizon % 3 as spec, n as run from results), k as (select *, row_number() over (partition by estimator, treatment, outcome, spec order by run desc, horizon) as r from r)
select estimator, treatment, outcome, spec, horizon, run, estimate from k where r = 1""")
def _(spark, d):
    rows = results(spark, d).withColumns({"spec": F.col("horizon") % 3, "run": F.col("n")})
    return inference.latest(rows, ["estimator", "treatment", "outcome", "spec"], [F.desc("run"), F.col("horizon")]).select("estimator", "treatment", "outcome", "spec", "horizon", "run", "estimate")


@query("effect_columns", f"{R}, x as (select *, case when horizon % 2 = 0 then estimate * 2 end as scaled, case when horizon % 3 = 0 then estimate - se end as lo0 from results) select estimator, treatment, outcome, horizon, round(coalesce(scaled, estimate), 6) as effect, round(coalesce(lo0, estimate - 1.96 * se), 6) as lo, round(estimate + 1.96 * se, 6) as hi from x")
def _(spark, d):
    rows = results(spark, d).withColumns({"scaled": F.when(F.col("horizon") % 2 == 0, F.col("estimate") * 2), "lo0": F.when(F.col("horizon") % 3 == 0, F.col("estimate") - F.col("se"))})
    return rows.select("estimator", *KEY, F.round(F.coalesce("scaled", "estimate"), 6).alias("effect"), F.round(F.coalesce("lo0", F.col("estimate") - 1.96 * F.col("se")), 6).alias("lo"), F.round(F.col("estimate") + 1.96 * F.col("se"), 6).alias("hi"))


@query("family_tag", f"{R} select distinct outcome, case outcome when '1-URGENT' then 'prices' when '2-HIGH' then 'prices' else case when regexp_matches(outcome, 'MEDIUM|LOW') then 'volumes' else 'other' end end as family from results")
def _(spark, d):
    rows = results(spark, d).select("outcome").distinct()
    known = rows.sparkSession.createDataFrame([("1-URGENT", "prices"), ("2-HIGH", "prices")], "outcome string, mapped string")
    return rows.join(F.broadcast(known), "outcome", "left").select("outcome", F.coalesce("mapped", F.when(F.col("outcome").rlike("MEDIUM|LOW"), "volumes").otherwise("other")).alias("family"))


@query("contract_id", f"{R} select treatment, outcome, horizon, 'iv_' || substr(sha1(concat_ws('|', treatment, outcome, horizon::varchar, coalesce(nullif(estimator, 'dml'), ''))), 1, 16) as contract_id from results")
def _(spark, d):
    rows = results(spark, d)
    parts = [F.col("treatment"), F.col("outcome"), F.col("horizon").cast("string"), F.coalesce(F.nullif("estimator", F.lit("dml")), F.lit(""))]
    return rows.select(*KEY, F.concat(F.lit("iv_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)).alias("contract_id"))


@query("lp_reliability_tier", f"""with {PANEL_NATION}, l as (select series, date, value as y, lag(value) over w as a, lag(value, 2) over w as b, year(date) as year from panel_nation window w as (partition by series order by date)),
g as (select series, year % 3 as part, count(*) as n, corr(a, b) as r from l where a is not null and b is not null and y is not null group by all),
f as (select series, part, n / 3.0 as obs, (1 + abs(r)) / (1 - abs(r)) as condition, length(series) % 3 as dropped, part = 1 as capped, case when n < 20 then 'few_rows' end as skip_reason from g),
e as (select *, dropped / 2 as share, skip_reason is not null as skip, coalesce(obs < 1.25, false) or condition > 1e10 as hard from f),
k as (select *, (rank() over (order by obs) + (count(*) over (partition by obs) - 1) / 2) / count(*) over () as ro, (rank() over (order by -round(log10(condition), 9)) + (count(*) over (partition by round(log10(condition), 9)) - 1) / 2) / count(*) over () as rc, (rank() over (order by -share) + (count(*) over (partition by share) - 1) / 2) / count(*) over () as rd from e where not skip and not hard),
s as (select series, part, greatest(0, least(1, 0.5 * ro + 0.3 * rc + 0.2 * rd - 0.1 * capped::int - 0.1 * (share > 0)::int)) as score from k)
select series, part, round(share, 5) as dropped_share, round(score, 6) as score, case when skip then 'skip' when score >= 0.67 and (not capped or (score >= 0.85 and obs >= 3 and condition <= 1e6)) then 'high' when score >= 0.33 then 'medium' else 'low' end as tier from e left join s using (series, part)""")
def _(spark, d):
    """Design diagnostics of a fit on two lags, for each nation and every third year."""
    w = Window.partitionBy("series").orderBy("date")
    rows = panel_nation(spark, d).select("series", F.col("value").alias("y"), F.lag("value").over(w).alias("a"), F.lag("value", 2).over(w).alias("b"), (F.year("date") % 3).alias("part"))
    fits = controls.design_guards(rows, ["series", "part"], ["y"], ["a", "b"], free=1)
    named = fits.select("series", "part", (F.col("n") / 3).alias("obs_per_regressor"), F.pow(F.lit(10.0), F.round(F.log10("condition"), 9)).alias("condition"), F.lit(0).alias("rank_deficit"), F.lit(2).alias("selected"), (F.length("series") % 3).alias("dropped"), (F.col("part") == 1).alias("capped"), F.when(F.col("n") < 20, "few_rows").alias("skip_reason"))
    return gates.reliability_tiers(named).select("series", F.col("part").cast("long").alias("part"), F.round("dropped_share", 5).alias("dropped_share"), *rounded("score"), "tier")


@query("contract_expand", f"""{R}, t as (select distinct treatment, outcome from results where p < 0.2), e as (select unnest(['iv', 'lp_iv']) as kind), h as (select unnest([0, 4, 8]) as horizon) select treatment, outcome, kind, horizon::integer as horizon from t, e, h""")
def _(spark, d):
    pairs = results(spark, d).filter("p < 0.2").select("treatment", "outcome").distinct()
    return pairs.withColumn("kind", F.explode(F.array(F.lit("iv"), F.lit("lp_iv")))).withColumn("horizon", F.explode(F.array(F.lit(0), F.lit(4), F.lit(8))))


@query("drift_report", f"""{R}, a as (select treatment || '/' || outcome || '/' || horizon as name, case when p < 0.1 then 'pass' else 'fail' end as status, estimate as score from results where estimator = 'lp'), b as (select treatment || '/' || outcome || '/' || horizon as name, case when p < 0.1 then 'pass' else 'fail' end as status, estimate as score from results where estimator = 'dml'),
j as (select coalesce(a.name, b.name) as name, a.name is null as gone, b.name is null as fresh, a.status as s1, b.status as s0, a.score as v1, b.score as v0 from a full join b on a.name = b.name)
select name, case when gone then 'removed' when fresh then 'added' when s1 is distinct from s0 or abs(v1 - v0) > 1e-12 then 'changed' else 'same' end as change, round(v1 - v0, 6) as delta, case when gone or fresh then 'medium' when s1 is distinct from s0 or abs(v1 - v0) >= 0.05 then 'high' else 'low' end as severity from j""")
def _(spark, d):
    name = F.concat_ws("/", "treatment", "outcome", "horizon")
    rows = results(spark, d).select("estimator", "horizon", name.alias("name"), F.when(F.col("p") < 0.1, "pass").otherwise("fail").alias("status"), F.col("estimate").alias("score"))
    now = rows.filter("estimator = 'lp'").select("name", F.col("status").alias("s1"), F.col("score").alias("v1"))
    then = rows.filter("estimator = 'dml'").select("name", F.col("status").alias("s0"), F.col("score").alias("v0"))
    j = now.join(then, "name", "full")
    other = ~F.col("s1").eqNullSafe(F.col("s0"))
    delta = F.col("v1") - F.col("v0")
    change = F.when(F.col("s1").isNull(), "removed").when(F.col("s0").isNull(), "added").when(other | (F.abs(delta) > 1e-12), "changed").otherwise("same")
    severity = F.when(F.col("s1").isNull() | F.col("s0").isNull(), "medium").when(other | (F.abs(delta) >= 0.05), "high").otherwise("low")
    return j.select("name", change.alias("change"), F.round(delta, 6).alias("delta"), severity.alias("severity"))


@query("window_qvalues", f"""{R}, k as (select estimator, treatment, outcome, horizon, p, row_number() over (partition by treatment, outcome order by p, estimator, horizon) as i, count(*) over (partition by treatment, outcome) as n from results),
s as (select *, max(case when p <= 0.1 / 1.1 * i / n then i else 0 end) over (partition by treatment, outcome) as rejected from k), m as (select *, greatest(1, n - rejected) as m0 from s)
select estimator, treatment, outcome, horizon, round(least(1, min(p * m0 / i * 1.1) over (partition by treatment, outcome order by i rows between current row and unbounded following)), 6) as q from m""")
def _(spark, d):
    pair = Window.partitionBy("treatment", "outcome")
    order = pair.orderBy("p", "estimator", "horizon")
    rows = results(spark, d).withColumns({"i": F.row_number().over(order), "n_p": F.count("*").over(pair)})
    rows = rows.withColumn("rejected", F.max(F.when(F.col("p") <= 0.1 / 1.1 * F.col("i") / F.col("n_p"), F.col("i")).otherwise(0)).over(pair))
    m0 = F.greatest(F.lit(1), F.col("n_p") - F.col("rejected"))
    return rows.select("estimator", *KEY, F.round(F.least(F.lit(1.0), F.min(F.col("p") * m0 / F.col("i") * 1.1).over(order.rowsBetween(0, Window.unboundedFollowing))), 6).alias("q"))


@query("pair_combine", f"""{R}, f as (select treatment, outcome, count(*) as k, -2 * sum(ln(greatest(p, 1e-12))) as chi2 from results group by all)
select treatment, outcome, k, round(chi2, 5) as chi2, round(exp(-chi2 / 2) * list_sum([pow(chi2 / 2, j) / gamma(j + 1.0) for j in range(0, k)]), 6) as fisher_p from f""")
def _(spark, d):
    rows = results(spark, d).groupBy("treatment", "outcome").agg(F.count("*").alias("k"), (-2 * F.sum(F.ln(F.greatest("p", F.lit(1e-12))))).alias("chi2"))
    # the tail of an even chi-square is a finite sum: terms (chi2 / 2)^j / j!
    tail = F.expr("aggregate(sequence(1, cast(k as int) - 1), named_struct('t', 1.0D, 's', 1.0D), (a, j) -> named_struct('t', a.t * chi2 / 2 / j, 's', a.s + a.t * chi2 / 2 / j), a -> a.s)")
    tail = F.when(F.col("k") > 1, tail).otherwise(F.lit(1.0))
    return rows.select("treatment", "outcome", "k", F.round("chi2", 5).alias("chi2"), F.round(F.exp(-F.col("chi2") / 2) * tail, 6).alias("fisher_p"))


@query("tmle_headline", f"""{R}, e as (select *, case horizon % 4 when 0 then 0.01 when 1 then 0.1 when 2 then 0.04 end as eps, case when estimator = 'dml' then 'tmle' else estimator end as kind from results),
k as (select *, row_number() over (partition by kind, treatment, outcome, horizon % 2 order by round(abs(eps - 0.05), 12) nulls last, eps nulls last, horizon) as r from (select *, case when kind = 'tmle' then eps + horizon / 1000 end as e2 from e)),
j as (select *, row_number() over (partition by kind, treatment, outcome, horizon % 2 order by round(abs(e2 - 0.05), 12) nulls last, e2 nulls last) as best from k)
select kind as estimator, treatment, outcome, horizon, e2 as eps, estimate from j where kind <> 'tmle' or best = 1""")
def _(spark, d):
    """The ledger's within estimates as if targeted at truncations that follow from the horizon, of which two parities each keep one."""
    h = F.col("horizon")
    tmle = F.col("estimator") == "dml"
    eps = F.when(h % 4 == 0, 0.01).when(h % 4 == 1, 0.1).when(h % 4 == 2, 0.04) + h / 1000
    rows = results(spark, d).withColumns({"eps": F.when(tmle, eps), "half": h % 2}).withColumn("estimator", F.when(tmle, "tmle").otherwise(F.col("estimator")))
    return comparison.headline_rows(rows, ["treatment", "outcome", "half"]).select("estimator", *KEY, "eps", "estimate")


@query("oster_stability", f"""{R}, {BOTH} select treatment, outcome, horizon, round(abs(dml) / nullif(abs(lp), 0), 5) as stability_ratio, (abs(dml) < abs(lp))::int as shrinks from b""")
def _(spark, d):
    """How much of the plain slope is left within return flags; below 1 it shrinks."""
    lp, dml = F.col("lp"), F.col("dml")
    return _both(results(spark, d)).select(*KEY, F.round(selection.stability_ratio(lp, dml), 5).alias("stability_ratio"), (F.abs(dml) < F.abs(lp)).cast("int").alias("shrinks"))


@query("confidence_tier", f"""{R}, {BOTH} select treatment, outcome, horizon, case when sign(lp) = sign(dml) and p_lp < 0.05 and p_dml < 0.05 then 'confirmatory' when sign(lp) = sign(dml) and least(p_lp, p_dml) < 0.05 then 'robust' when least(p_lp, p_dml) < 0.1 then 'suggestive' else 'insufficient' end as tier from b""")
def _(spark, d):
    same, low = F.signum("lp") == F.signum("dml"), F.least("p_lp", "p_dml")
    tier = F.when(same & (F.col("p_lp") < 0.05) & (F.col("p_dml") < 0.05), "confirmatory").when(same & (low < 0.05), "robust").when(low < 0.1, "suggestive").otherwise("insufficient")
    return _both(results(spark, d)).select(*KEY, tier.alias("tier"))


@query("quantile_variant_range", f"""with {PANEL_NATION}, v as (select 'level' as variant, series, date, value as v from panel_nation union all select 'change', series, date, value - lag(value) over (partition by series order by date) from panel_nation union all select 'log', series, date, ln(value) from panel_nation where value > 0),
c as (select a.variant, a.series, b.series as other, corr(a.v, b.v) as r from v a join v b on a.variant = b.variant and a.date = b.date and a.series <> b.series where a.v is not null and b.v is not null group by all), s as (select variant, series, avg(1 - abs(r)) as score from c group by all),
j as (select b.series, b.score, min(o.score) as least, max(o.score) as greatest, count(o.score) as variants from s b left join s o on o.series = b.series and o.variant <> 'level' where b.variant = 'level' group by all)
select series, round(score, 6) as score, round(least, 6) as least, round(greatest, 6) as greatest, variants, row_number() over (order by round(score, 9) desc, series) as place from j""")
def _(spark, d):
    """How little each nation goes with all others, and the range of that in changes and logarithms."""
    panel, w = panel_nation(spark, d), Window.partitionBy("series").orderBy("date")
    kinds = {"level": F.col("value"), "change": F.col("value") - F.lag("value").over(w), "log": safe_ln(F.col("value"))}
    rows = panel.select("series", "date", *[v.alias(k) for k, v in kinds.items()]).select("series", "date", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.col(k).alias("v")) for k in kinds])).alias("x")).select("series", "date", "x.*").filter("v is not null")
    other = rows.select(F.col("series").alias("other"), "date", "variant", F.col("v").alias("u"))
    scores = rows.join(other, ["date", "variant"]).filter("series <> other").groupBy("variant", "series", "other").agg(corr("v", "u").alias("r")).groupBy("variant", "series").agg(F.avg(1 - F.abs("r")).alias("score"))
    out = comparison.variant_range(scores.filter("variant = 'level'"), scores.filter("variant <> 'level'"), ["series"])
    return out.select("series", *rounded("score", "least", "greatest"), "variants", "place")


@query("spec_stability", f"""{R}, k as (select *, row_number() over (partition by estimator, treatment order by abs(estimate) desc, outcome, horizon) as place, p < 0.1 as keyed from results),
j as (select a.treatment, (sign(a.estimate) = sign(b.estimate))::int as same_sign, (a.keyed = b.keyed)::int as same_key, abs(a.place - b.place) as shift, case when a.keyed then b.keyed::int end as retained from k a join k b using (treatment, outcome, horizon) where a.estimator = 'lp' and b.estimator = 'dml')
select treatment, count(*) as n, round(avg(same_sign), 6) as sign_match, round(avg(same_key), 6) as priority_match, round(quantile_cont(shift::double, 0.5), 6) as median_shift, round(coalesce(avg(retained), 0), 6) as key_retention, round(0.4 * avg(same_sign) + 0.3 * avg(same_key) + 0.2 / (1 + quantile_cont(shift::double, 0.5)) + 0.1 * coalesce(avg(retained), 0), 6) as score from j group by treatment""")
def _(spark, d):
    out = comparison.spec_stability(results(spark, d), KEY, "estimator", "lp", "dml", ["treatment"])
    return out.select("treatment", "n", *rounded("sign_match", "priority_match", "median_shift", "key_retention", "score"))
