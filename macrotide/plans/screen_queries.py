"""Queries of rolling pair screens and their scores, falsifications and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr, rounded
from macrotide.operators import gates, screening
from macrotide.plans.registry import query
from macrotide.sources.panels import PANEL_M, PANEL_NATION, normal_p_sql, panel_m, panel_nation

WIDTH = 24


def _windows(spark, d):
    """Windows of all ordered pairs of nations."""
    panel = panel_nation(spark, d)
    return screening.rolling_pairs(panel, panel.select(F.col("series").alias("target")).distinct(), WIDTH)


WINDOWS = f"""with {PANEL_NATION}, pr as (select t.series as target, c.series as candidate, t.date, t.value as y, c.value as x from panel_nation t join panel_nation c on t.date = c.date and t.series <> c.series),
sm as (select *, count(*) over w as n, sum(x) over w as sx, sum(y) over w as sy, sum(x * x) over w as sxx, sum(y * y) over w as syy, sum(x * y) over w as sxy from pr window w as (partition by target, candidate order by date rows between {WIDTH - 1} preceding and current row)),
rb as (select target, candidate, date, (n * sxy - sx * sy) / nullif(sqrt(greatest((n * sxx - sx * sx) * (n * syy - sy * sy), 0)), 0) as r, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) as beta from sm where n = {WIDTH}),
zz as (select *, r * sqrt({WIDTH - 2} / nullif(1 - r * r, 0)) as z from rb),
win as (select *, {normal_p_sql('z')} as p, row_number() over (partition by target, candidate order by date) as i from zz)"""


def _score_sql(source: str, keys: str, name: str = "sc") -> str:
    def summed(sign: str, times: str = "") -> str:
        return f"sum(case when p < 0.1 and r {sign} 0 then (1 - p / 0.1){times} else 0 end)"

    ep, sp, en, sn = summed(">"), summed(">", " * least(abs(r), 1)"), summed("<"), summed("<", " * least(abs(r), 1)")
    return f"""{name}__ as (select {keys}, count(*) as n, {ep} as ep, {sp} as sp, {en} as en, {sn} as sn from {source} group by {keys}),
{name}_ as (select *, 100 * sp / n * ep / (ep + 12) as vp, 100 * sn / n * en / (en + 12) as vn from {name}__),
{name} as (select *, greatest(vp, vn) as score, case when vp >= vn then ep else en end / n as share, coalesce(case when vp >= vn then sp / nullif(ep, 0) else sn / nullif(en, 0) end, 0) as strength from {name}_)"""


@query("driver_response_windows", f"{WINDOWS} select target, candidate, date, round(r, 5) as r, round(beta, 5) as beta, round(p, 5) as p from win")
def _(spark, d):
    return _windows(spark, d).select("target", "candidate", "date", *rounded("r", "beta", "p", digits=5))


@query("rank_candidates", f"{WINDOWS}, {_score_sql('win', 'target, candidate')} select target, candidate, round(score, 5) as score, row_number() over (partition by target order by round(score, 8) desc, candidate) as place from sc")
def _(spark, d):
    scores = screening.directional_score(_windows(spark, d), ["target", "candidate"])
    return screening.ranked(scores, ["target"], "candidate", F.round("score", 8)).select("target", "candidate", *rounded("score", digits=5), "place")


@query("shortlist", f"{WINDOWS}, {_score_sql('win', 'target, candidate')}, k as (select *, row_number() over (partition by target order by round(score, 8) desc, candidate) as place, case when score > 5 then 'promoted' else 'provisional' end as status from sc), h as (select target, max(case when status = 'promoted' then 1 else 0 end) as any_promoted from k group by target) select target, candidate, status, place from k join h using (target) where (any_promoted = 1 and status = 'promoted') or (any_promoted = 0 and place <= 3)")
def _(spark, d):
    scores = screening.ranked(screening.directional_score(_windows(spark, d), ["target", "candidate"]), ["target"], "candidate", F.round("score", 8))
    rows = scores.withColumn("status", F.when(F.col("score") > 5, "promoted").otherwise("provisional"))
    rows = rows.withColumn("any_promoted", F.max((F.col("status") == "promoted").cast("int")).over(Window.partitionBy("target")))
    return rows.filter("(any_promoted = 1 and status = 'promoted') or (any_promoted = 0 and place <= 3)").select("target", "candidate", "status", "place")


@query("shortlist_stability", f"{WINDOWS}, y as (select target, candidate, year(date) as yr, avg((p < 0.1)::int) as share from win group by all), s as (select target, candidate, count(*) as years, count_if(share >= 0.5) as hits from y group by all) select target, candidate, years, hits::bigint as hits, case when hits >= 3 then 'core_stable' when hits >= 1 then 'moderate' else 'exploratory' end as band from s")
def _(spark, d):
    yearly = _windows(spark, d).groupBy("target", "candidate", F.year("date").alias("yr")).agg(F.avg((F.col("p") < 0.1).cast("int")).alias("share"))
    out = yearly.groupBy("target", "candidate").agg(F.count("*").alias("years"), F.count_if(F.col("share") >= 0.5).alias("hits"))
    return out.withColumn("band", F.when(F.col("hits") >= 3, "core_stable").when(F.col("hits") >= 1, "moderate").otherwise("exploratory"))


@query("early_late_holdout", f"{WINDOWS}, hw as (select *, ntile(2) over (partition by target, candidate order by date) as half from win), {_score_sql('hw', 'target, candidate, half')}, ab as (select a.target, a.candidate, a.score as early, b.score as late from sc a join sc b using (target, candidate) where a.half = 1 and b.half = 2) select target, count(*) as n, round(corr(early, late), 4) as correlation, round(avg(abs(early - late)), 5) as mean_gap from ab group by target")
def _(spark, d):
    halves = _windows(spark, d).withColumn("half", F.ntile(2).over(Window.partitionBy("target", "candidate").orderBy("date")))
    scores = screening.directional_score(halves, ["target", "candidate", "half"])
    both = scores.groupBy("target", "candidate").agg(F.max(F.when(F.col("half") == 1, F.col("score"))).alias("early"), F.max(F.when(F.col("half") == 2, F.col("score"))).alias("late")).filter("early is not null and late is not null")
    return both.groupBy("target").agg(F.count("*").alias("n"), F.round(corr("early", "late"), 4).alias("correlation"), F.round(F.avg(F.abs(F.col("early") - F.col("late"))), 5).alias("mean_gap"))


@query("directionality_gap", f"{WINDOWS} select a.target, a.candidate, round(avg((a.p < 0.1)::int) - avg((b.p < 0.1)::int), 5) as gap, count(*) as n from win a join win b on a.target = b.candidate and a.candidate = b.target and b.i = a.i - 1 group by all")
def _(spark, d):
    windows = _windows(spark, d).select("target", "candidate", "i", "p")
    back = windows.select(F.col("candidate").alias("target"), F.col("target").alias("candidate"), (F.col("i") + 1).alias("i"), F.col("p").alias("p_back"))
    return windows.join(back, ["target", "candidate", "i"]).groupBy("target", "candidate").agg(F.round(F.avg((F.col("p") < 0.1).cast("int")) - F.avg((F.col("p_back") < 0.1).cast("int")), 5).alias("gap"), F.count("*").alias("n"))


@query("shift_falsification", f"{WINDOWS}, ks as (select unnest([0, 3, 6]) as k), sh as (select target, candidate, date, k, i, p, beta, lag(r, 3) over (partition by target, candidate, k order by i) as r3, lag(r, 6) over (partition by target, candidate, k order by i) as r6, r as r0 from win, ks), sf as (select target, candidate, k, p, beta, case k when 0 then r0 when 3 then r3 else r6 end as r from sh), sg as (select * from sf where r is not null), {_score_sql('sg', 'target, candidate, k')} select target, candidate, k::integer as k, n, round(score, 5) as score from sc")
def _(spark, d):
    w = Window.partitionBy("target", "candidate").orderBy("i")
    windows = _windows(spark, d).withColumns({"r3": F.lag("r", 3).over(w), "r6": F.lag("r", 6).over(w)})
    shifted = windows.select("target", "candidate", "p", "beta", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("r")) for k, c in ((0, "r"), (3, "r3"), (6, "r6"))])).alias("s")).select("target", "candidate", "p", "beta", "s.k", "s.r").filter("r is not null")
    return screening.directional_score(shifted, ["target", "candidate", "k"]).select("target", "candidate", "k", "n", *rounded("score", digits=5))


@query("placebo_sign_flip", f"{WINDOWS}, dr as (select win.*, d.draw, case when ('0x' || substr(md5(target || '|' || candidate || '|' || i || '|' || d.draw), 1, 4))::bigint % 2 = 0 then 1 else -1 end as flip from win, (select unnest(range(1, 101)) as draw) d), m as (select target, candidate, draw, abs(avg(r * flip)) as null_score from dr group by all), o as (select target, candidate, abs(avg(r)) as observed from win group by all) select target, candidate, round(any_value(observed), 5) as observed, round((1 + sum((null_score >= observed - 1e-9)::int)) / (1 + count(*)), 5) as empirical_p from m join o using (target, candidate) group by all")
def _(spark, d):
    windows = _windows(spark, d)
    draws = windows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(100))))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", "target", "candidate", "i", "draw")), 1, 4), 16, 10).cast("long")
    null = draws.groupBy("target", "candidate", "draw").agg(F.abs(F.avg(F.col("r") * F.when(bits % 2 == 0, 1).otherwise(-1))).alias("null_score"))
    observed = windows.groupBy("target", "candidate").agg(F.abs(F.avg("r")).alias("observed"))
    return null.join(observed, ["target", "candidate"]).groupBy("target", "candidate").agg(F.round(F.first("observed"), 5).alias("observed"), F.round((1 + F.sum((F.col("null_score") >= F.col("observed") - 1e-9).cast("int"))) / (1 + F.count("*")), 5).alias("empirical_p"))


@query("score_block_bootstrap", f"{WINDOWS}, n_ as (select target, candidate, count(*) as n, greatest(1, floor(sqrt(count(*)) + 0.5))::bigint as k from win group by all), b as (select win.target, win.candidate, d.draw, ((d.draw * 1103515245 + ((win.i - 1) // k) * 12345) % 2147483648) % (n - k + 1) + (win.i - 1) % k + 1 as j from win join n_ using (target, candidate), (select unnest(range(1, 201)) as draw) d where n > k), rs as (select b.target, b.candidate, b.draw, w.r, w.p, w.beta from b join win w on w.target = b.target and w.candidate = b.candidate and w.i = b.j), {_score_sql('rs', 'target, candidate, draw')} select target, candidate, count(*) as draws, round(quantile_cont(score, 0.05), 5) as q05, round(quantile_cont(score, 0.95), 5) as q95 from sc group by all")
def _(spark, d):
    return screening.bootstrap_scores(_windows(spark, d), ["target", "candidate"], draws=200).select("target", "candidate", "draws", *rounded("q05", "q95", digits=5))


def _t_sql(h: int) -> str:
    return f"abs(corr(t, c{h})) * sqrt((count(c{h}) - 2) / (1 - corr(t, c{h}) * corr(t, c{h})))"


@query("nc_candidate_screen", f"""with {PANEL_NATION}, {PANEL_M}, a as (select series as candidate, date, value as c, {', '.join(f'lead(value, {h}) over (partition by series order by date) as c{h}' for h in (1, 2, 3, 4))} from panel_nation),
q as (select t.series as treatment, y.series as outcome, date, t.value as t, y.value as y from panel_m t join panel_nation y using (date) where y.series in ('NATION_0', 'NATION_1')),
s as (select treatment, outcome, candidate, count(*) as n, case when count(*) >= 24 then abs(corr(y, c)) end as similarity, greatest({', '.join(_t_sql(h) for h in (1, 2, 3, 4))}) as lead_t from q join a using (date) where candidate <> outcome group by all),
k as (select *, 0.65 * coalesce(similarity, 0) + 0.35 / (1 + lead_t) as score from s), r as (select *, row_number() over (partition by treatment, outcome order by round(score, 9) desc, round(similarity, 9) desc nulls last, round(lead_t, 9), candidate) as place, coalesce(similarity >= 0.2, false) as alike, lead_t <= 1.645 as quiet from k)
select treatment, outcome, candidate, n, round(similarity, 5) as similarity, round(lead_t, 4) as lead_t, round(score, 5) as score, place, case when not (alike and quiet) then 'drop' when place <= 5 then 'select' else 'demote' end as decision,
concat_ws(';', case when not alike then 'SIMILARITY_FAIL' end, case when not quiet then 'NULL_SCREEN_FAIL' end, case when alike and quiet then case when place <= 5 then 'PASS' else 'RANK' end end) as reasons from r""")
def _(spark, d):
    panel = panel_nation(spark, d)
    t = panel_m(spark, d).select(F.col("series").alias("treatment"), "date", F.col("value").alias("t"))
    y = panel.filter("series in ('NATION_0', 'NATION_1')").select(F.col("series").alias("outcome"), "date", F.col("value").alias("y"))
    out = gates.control_screen(panel, t.join(y, "date"))
    return out.select("treatment", "outcome", "candidate", "n", F.round("similarity", 5).alias("similarity"), F.round("lead_t", 4).alias("lead_t"), F.round("score", 5).alias("score"), "place", "decision", "reasons")


@query("block_permutation_test", f"with {PANEL_NATION}, t as (select date, value as t from panel_nation where series = 'NATION_0'), r as (select p.series, p.value as y, t, row_number() over (partition by p.series order by p.date) - 1 as i from panel_nation p join t using (date) where p.series <> 'NATION_0'), b as (select distinct series, i // 6 as b from r), o as (select series, draw, b, row_number() over (partition by series, draw order by md5(series || '|' || draw || '|' || b), b) - 1 as place from b, (select unnest(range(1, 30)) as draw)), q as (select r.series, o.draw, r.t, row_number() over (partition by r.series, o.draw order by o.place, r.i) - 1 as i from r join o on o.series = r.series and o.b = r.i // 6), n as (select q.series, draw, abs(corr(q.t, r.y)) as null_corr from q join r using (series, i) group by all), s as (select series, abs(corr(t, y)) as observed from r group by series) select series, round(any_value(observed), 5) as observed, round((1 + sum((null_corr >= observed - 1e-9)::int)) / (1 + count(*)), 5) as permutation_p from n join s using (series) group by series")
def _(spark, d):
    panel = panel_nation(spark, d)
    t = panel.filter("series = 'NATION_0'").select("date", F.col("value").alias("t"))
    w = Window.partitionBy("series").orderBy("date")
    rows = panel.filter("series <> 'NATION_0'").withColumnRenamed("value", "y").join(t, "date").withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("b", F.expr("i div 6"))
    order = Window.partitionBy("series", "draw").orderBy(F.md5(F.concat_ws("|", "series", "draw", "b")), "b")
    blocks = rows.select("series", "b").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(29)))).withColumn("at", F.row_number().over(order))
    moved = rows.join(blocks, ["series", "b"]).select("series", "draw", "t", (F.row_number().over(Window.partitionBy("series", "draw").orderBy("at", "i")) - 1).cast("long").alias("i"))
    null = moved.join(rows.select("series", "i", "y"), ["series", "i"]).groupBy("series", "draw").agg(F.abs(corr("t", "y")).alias("null_corr"))
    observed = rows.groupBy("series").agg(F.abs(corr("t", "y")).alias("observed"))
    return null.join(observed, "series").groupBy("series").agg(F.round(F.first("observed"), 5).alias("observed"), F.round((1 + F.sum((F.col("null_corr") >= F.col("observed") - 1e-9).cast("int"))) / (1 + F.count("*")), 5).alias("permutation_p"))
