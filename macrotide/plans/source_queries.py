"""Queries of readers, ledgers, inventories and run comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from macrotide.functions.columns import corr, rounded
from macrotide.operators import calendar, inference, ledgers
from macrotide.plans.registry import query
from macrotide.sources.panels import LEDGER_RAW, PANEL_GAPS, PANEL_M, RESULTS, ledger_raw, panel_gaps, panel_m, results, table


@query("read_series", "with r as (select o_orderpriority as series, o_orderdate::date as date, try_cast(o_totalprice::varchar as double) as value, o_orderkey as seq from orders), k as (select *, row_number() over (partition by series, date order by seq desc) as r from r where value is not null) select series, date, value from k where r = 1")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("string").try_cast("double").alias("value"), F.col("o_orderkey").alias("seq"))
    return inference.latest(rows.filter("value is not null"), ["series", "date"], [F.desc("seq")]).select("series", "date", "value")


@query("read_panel_wide", f"with {PANEL_GAPS}, w as (pivot panel_gaps on series in ('1-URGENT', '2-HIGH', '3-MEDIUM') using max(value) group by date) unpivot w on columns(* exclude date) into name series value value")
def _(spark, d):
    wide = panel_gaps(spark, d).groupBy("date").pivot("series", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.max("value"))
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "series", "value").filter("value is not null")


@query("merge_panels_first_wins", f"with {PANEL_GAPS}, u as (select 1 as src, * from panel_gaps where series <= '3' union all select 2, date, series, value * 2 from panel_m where series >= '2'), f as (select series, min(src) as src from u group by series) select series, date, u.value, src::integer as src from u join f using (series, src)")
def _(spark, d):
    first = panel_gaps(spark, d).filter("series <= '3'").withColumn("src", F.lit(1))
    second = panel_m(spark, d).filter("series >= '2'").withColumn("value", F.col("value") * 2).withColumn("src", F.lit(2))
    both = first.unionByName(second)
    return both.join(both.groupBy("series").agg(F.min("src").alias("src")), ["series", "src"]).select("series", "date", "value", "src")


CLEAN = f"""with {LEDGER_RAW}, ledger as (select *, case when class_text like '%PROMO%' then 'bill' when class_text like '%ECONOMY%' then 'note' when class_text like '%MEDIUM%' then 'bond' when class_text like '%SMALL%' then 'tips' when class_text like '%STANDARD%' then 'frn' else 'other' end as type,
greatest((maturity_date - record_date) / 365.25, 0) as remaining, (maturity_date - issue_date) / 365.25 as original from ledger_raw where lower(class_text) not like '%total%' and amount > 0 and maturity_date >= record_date)"""


@query("ledger_clean", CLEAN + " select record_date, type, count(*) as n, round(sum(amount), 2) as amount, round(avg(remaining), 6) as remaining, round(avg(original), 6) as original from ledger group by all")
def _(spark, d):
    return ledgers.clean_ledger(ledger_raw(spark, d)).groupBy("record_date", "type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.avg("remaining"), 6).alias("remaining"), F.round(F.avg("original"), 6).alias("original"))


_shares = ", ".join(f"round(sum(case when type = '{n}' then amount else 0 end) / sum(amount), 6) as {n}_share" for n in ("bill", "note", "bond", "tips", "frn", "other"))
_low, _parts = 0.0, []
for _high, _name in ledgers.BUCKETS:
    _test = " and ".join([f"remaining > {_low}"] * bool(_low) + [f"remaining <= {_high}"] * bool(_high))
    _parts.append(f"round(sum(case when {_test} then amount else 0 end), 2) as amount_{_name}, round(sum(case when {_test} then amount else 0 end) / sum(amount), 6) as share_{_name}")
    _low = _high


@query("ledger_metrics", CLEAN + f" select record_date, round(sum(amount), 2) as total, count(*) as securities, {_shares}, round(sum(amount * remaining) / sum(amount), 6) as wam, round(sum(amount * coupon) / sum(amount), 6) as coupon, round(sum(amount * yield) / sum(amount), 6) as yield, round(sum(case when last_day(issue_date) = record_date then amount else 0 end), 2) as new_issues, {', '.join(_parts)} from ledger group by record_date")
def _(spark, d):
    out = ledgers.ledger_metrics(ledgers.clean_ledger(ledger_raw(spark, d)))
    money = ["total", "new_issues", *[f"amount_{n}" for _, n in ledgers.BUCKETS]]
    return out.select("record_date", "securities", *rounded(*money, digits=2), *rounded(*[c for c in out.columns if c not in (*money, "record_date", "securities")]))


@query("state_to_national_quarterly", "with q as (select n_name as state, year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter, count(*) as v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all) select make_date(left(quarter, 4)::int, right(quarter, 1)::int * 3, 1) as start, last_day(make_date(left(quarter, 4)::int, right(quarter, 1)::int * 3, 1)) as date, sum(v)::bigint as value from q group by all")
def _(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    day = F.to_date("o_orderdate")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("c_nationkey", F.concat(F.year(day), F.lit("-Q"), F.quarter(day)).alias("quarter")).agg(F.count("*").alias("v"))
    start = F.make_date(F.substring("quarter", 1, 4).cast("int"), F.substring("quarter", 7, 1).cast("int") * 3, F.lit(1))
    return rows.groupBy(start.alias("start"), F.last_day(start).alias("date")).agg(F.sum("v").alias("value"))


@query("claims_to_month_end", "with c as (select o_orderdate::date as date, o_orderpriority as component, case when o_orderstatus = 'F' then 'US' else 'S' || o_custkey % 50 end as state, o_totalprice as v from orders), f as (select *, max((state = 'US')::int) over () as has_us from c) select last_day(date) as date, component, round(sum(v), 2) as value from f where has_us = 0 or state = 'US' group by all")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("component"), F.when(F.col("o_orderstatus") == "F", "US").otherwise(F.concat(F.lit("S"), F.col("o_custkey") % 50)).alias("state"), F.col("o_totalprice").alias("v"))
    national = rows.agg(F.max((F.col("state") == "US").cast("int")).alias("has_us"))
    return rows.crossJoin(F.broadcast(national)).filter("has_us = 0 or state = 'US'").groupBy(F.last_day("date").alias("date"), "component").agg(F.round(F.sum("v"), 2).alias("value"))


@query("fiscal_month_parse", "with f as (select 'FY ' || (year(o_orderdate) + (month(o_orderdate) >= 10)::int) || ' ' || lpad(month(o_orderdate)::varchar, 2, '0') as txt, count(*) as n from orders group by all) select txt, last_day(make_date(substr(txt, 4, 4)::int - (right(txt, 2)::int >= 10)::int, right(txt, 2)::int, 1)) as date, n from f")
def _(spark, d):
    day = F.to_date("o_orderdate")
    text = F.concat(F.lit("FY "), F.year(day) + (F.month(day) >= 10).cast("int"), F.lit(" "), F.lpad(F.month(day).cast("string"), 2, "0"))
    rows = table(spark, d, "orders").groupBy(text.alias("txt")).agg(F.count("*").alias("n"))
    month = F.regexp_extract("txt", r" (\d\d)$", 1).cast("int")
    year = F.regexp_extract("txt", r"^FY (\d{4})", 1).cast("int") - (month >= 10).cast("int")
    return rows.select("txt", F.last_day(F.make_date(year, month, F.lit(1))).alias("date"), "n")


@query("series_inventory", f"with {PANEL_GAPS} select series, count(*) as n, count(*) - count(value) as missing, round(count(value)::double / count(*), 6) as coverage, min(case when value is not null then date end) as first_valid, max(case when value is not null then date end) as last_valid, round(min(value), 6) as least, round(max(value), 6) as greatest, case when series <> '5-LOW' then 'ok' end as status from panel_gaps group by series")
def _(spark, d):
    panel = panel_gaps(spark, d)
    status = panel.select("series").distinct().filter("series <> '5-LOW'").withColumn("status", F.lit("ok"))
    valid = F.when(F.col("value").isNotNull(), F.col("date"))
    out = panel.groupBy("series").agg(F.count("*").alias("n"), (F.count("*") - F.count("value")).alias("missing"), F.round(F.count("value") / F.count("*"), 6).alias("coverage"), F.min(valid).alias("first_valid"), F.max(valid).alias("last_valid"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("greatest"))
    return out.join(status, "series", "left")


@query("fetch_diagnostics_report", "with r as (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k, value from events) select event_type, count(*) as n, count(k) as with_k, round(avg((k % 5 = 0)::int), 6) as retry_rate, round(sum(value) / nullif(sum(k), 0), 6) as value_per_k from r group by event_type")
def _(spark, d):
    rows = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"), "value")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.round(F.avg((F.col("k") % 5 == 0).cast("int")), 6).alias("retry_rate"), F.round(F.try_divide(F.sum("value"), F.sum("k")), 6).alias("value_per_k"))


@query("fetch_profile_compare", "with p as (select event_type, user_id % 2 as run, count(*) as n, avg(value) as mean from events group by all) select b.event_type, b.n::bigint as n_b, a.n::bigint as n_a, round(b.n / nullif(a.n, 0), 6) as n_ratio, round(b.mean / nullif(a.mean, 0), 6) as mean_ratio from p b join p a using (event_type) where b.run = 1 and a.run = 0")
def _(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("run")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    a, b = (rows.filter(F.col("run") == r).select("event_type", F.col("n").alias(f"n_{t}"), F.col("mean").alias(f"m_{t}")) for r, t in ((0, "a"), (1, "b")))
    return b.join(a, "event_type").select("event_type", "n_b", "n_a", F.round(F.try_divide("n_b", "n_a"), 6).alias("n_ratio"), F.round(F.try_divide("m_b", "m_a"), 6).alias("mean_ratio"))


@query("panel_compare", f"""with {PANEL_GAPS}, j as (select coalesce(a.series, b.series) as series, a.value as x, b.value as y from panel_m a full join panel_gaps b using (series, date))
select series, count(*) as n, count_if(x is null or y is null)::bigint as unmatched, round(max(abs(x - y)), 6) as max_abs, round(sqrt(avg((x - y) * (x - y))), 6) as rmse, round(avg(abs(x - y) / nullif(abs(x), 0)), 6) as mean_rel, round(corr(x, y), 6) as correlation from j group by series""")
def _(spark, d):
    a = panel_m(spark, d).withColumnRenamed("value", "x")
    b = panel_gaps(spark, d).withColumnRenamed("value", "y")
    gap = F.col("x") - F.col("y")
    return a.join(b, ["series", "date"], "full").groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"), F.round(F.max(F.abs(gap)), 6).alias("max_abs"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.avg(F.try_divide(F.abs(gap), F.abs("x"))), 6).alias("mean_rel"), F.round(corr("x", "y"), 6).alias("correlation"))


@query("generated_series", f"with {PANEL_M}, w as (select date, max(case when series = '1-URGENT' then value end) as a, max(case when series = '2-HIGH' then value end) as b from panel_m group by date) select date, round(a - b, 6) as gap, round((a + b) / nullif(a - b, 0), 4) as ratio, round(a + b, 6) as total from w")
def _(spark, d):
    wide = panel_m(spark, d).groupBy("date").pivot("series", ["1-URGENT", "2-HIGH"]).agg(F.max("value")).toDF("date", "a", "b")
    out = wide.withColumns({"gap": F.col("a") - F.col("b"), "total": F.col("a") + F.col("b")}).withColumn("ratio", F.try_divide("total", "gap"))
    return out.select("date", *rounded("gap"), F.round("ratio", 4).alias("ratio"), *rounded("total"))


@query("scale_results_sd", f"""with {RESULTS}, s as (select c_mktsegment as treatment, stddev_samp(l_tax) as sd from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1)
select estimator, treatment, outcome, horizon, round(estimate * sd, 6) as scaled, round(se * sd, 6) as scaled_se, round((estimate - 1.96 * se) * sd, 6) as lo, round((estimate + 1.96 * se) * sd, 6) as hi from results join s using (treatment)""")
def _(spark, d):
    lines, orders, customers = table(spark, d, "lineitem").select("l_orderkey", "l_tax"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("treatment"))
    sd = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("treatment").agg(F.stddev_samp("l_tax").alias("sd"))
    e, s = F.col("estimate"), F.col("se")
    return results(spark, d).join(sd, "treatment").select("estimator", "treatment", "outcome", "horizon", *[F.round(x * F.col("sd"), 6).alias(n) for n, x in (("scaled", e), ("scaled_se", s), ("lo", e - 1.96 * s), ("hi", e + 1.96 * s))])
