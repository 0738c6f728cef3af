"""Long panels (series, date, value) and result tables built from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.functions.columns import normal_p


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps become dates where a query asks for them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(x: str | Column) -> Column:
    """A sum of money that doesn't depend on the order of rows."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(18,2)")).cast("double")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))


def panel_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by priority, in units of 700,000."""
    orders = _orders(spark, sf_dir)
    return orders.groupBy(F.last_day("day").alias("date"), F.col("o_orderpriority").alias("series")).agg((exact_sum("o_totalprice") / 7e5).alias("value"))


def panel_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``panel_m`` with missing values and outliers at months that follow from the date and the series."""
    key = F.year("date") * 12 + F.month("date") + F.length("series")
    value = F.when(key % 7 == 0, None).when(key % 11 == 0, F.col("value") * 10).otherwise(F.col("value"))
    return panel_m(spark, sf_dir).withColumn("value", value)


def panel_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value by priority, in units of 700."""
    return _orders(spark, sf_dir).groupBy(F.col("day").alias("date"), F.col("o_orderpriority").alias("series")).agg((exact_sum("o_totalprice") / 7e2).alias("value"))


def panel_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value by the customer's nation, in units of 700,000."""
    orders = _orders(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("c_nationkey", F.last_day("day").alias("date")).agg(exact_sum("o_totalprice").alias("total"))
    return rows.join(nations, rows["c_nationkey"] == nations["n_nationkey"]).select(F.col("n_name").alias("series"), "date", (F.col("total") / 7e5).alias("value"))


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A security ledger: order lines as securities, part types as classes, ship dates as maturities."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = _orders(spark, sf_dir).select("o_orderkey", "day")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(parts, lines["l_partkey"] == parts["p_partkey"])
        .select(F.last_day("day").alias("record_date"), F.col("day").alias("issue_date"), F.to_date("l_shipdate").alias("maturity_date"), F.col("p_type").alias("class_text"), F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("coupon"), F.col("l_tax").alias("yield"))
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results ledger: slopes of discount on tax by segment, priority and line number, raw (lp) and within return flags (dml)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(customers, orders["o_custkey"] == customers["c_custkey"])
        .select(F.col("c_mktsegment").alias("treatment"), F.col("o_orderpriority").alias("outcome"), F.col("l_linenumber").alias("horizon"), F.col("l_returnflag").alias("flag"), F.col("l_discount").cast("decimal(6,2)").alias("y"), F.col("l_tax").cast("decimal(6,2)").alias("x"))
    )
    key, x, y = ["treatment", "outcome", "horizon"], F.col("x"), F.col("y")
    cells = rows.groupBy(*key, "flag").agg(F.count("*").alias("n"), *[F.sum(v).cast("double").alias(k) for k, v in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y))])
    n, sx, sy = F.sum("n"), F.sum("sx"), F.sum("sy")
    within = [F.sum(F.col(c) - F.col(a) * F.col(b) / F.col("n")) for c, a, b in (("sxx", "sx", "sx"), ("sxy", "sx", "sy"), ("syy", "sy", "sy"))]
    raw = [F.sum("sxx") - sx * sx / n, F.sum("sxy") - sx * sy / n, F.sum("syy") - sy * sy / n]
    moments = cells.groupBy(*key).agg(n.alias("n"), F.struct(F.lit("lp").alias("e"), raw[0].alias("xx"), raw[1].alias("xy"), raw[2].alias("yy")).alias("a"), F.struct(F.lit("dml").alias("e"), within[0].alias("xx"), within[1].alias("xy"), within[2].alias("yy")).alias("b"))
    long = moments.select(*key, "n", F.explode(F.array("a", "b")).alias("m")).filter("n > 4 and m.xx > 1e-12")
    slope = F.col("m.xy") / F.col("m.xx")
    se = F.sqrt(F.greatest(F.col("m.yy") - F.col("m.xy") * F.col("m.xy") / F.col("m.xx"), F.lit(0.0)) / (F.col("n") - 2) / F.col("m.xx"))
    out = long.select(F.col("m.e").alias("estimator"), *key, "n", F.round(slope, 9).alias("estimate"), F.round(se, 9).alias("se")).filter("se > 0")
    return out.withColumn("z", F.round(F.col("estimate") / F.col("se"), 9)).withColumn("p", F.round(normal_p(F.col("z")), 9))


PANEL_M = "panel_m as (select last_day(o_orderdate::date) as date, o_orderpriority as series, sum(o_totalprice::decimal(18,2))::double / 7e5 as value from orders group by all)"
PANEL_GAPS = PANEL_M + """,
panel_gaps as (select date, series, case when (year(date) * 12 + month(date) + length(series)) % 7 = 0 then null
  when (year(date) * 12 + month(date) + length(series)) % 11 = 0 then value * 10 else value end as value from panel_m)"""
PANEL_D = "panel_d as (select o_orderdate::date as date, o_orderpriority as series, sum(o_totalprice::decimal(18,2))::double / 7e2 as value from orders group by all)"
PANEL_NATION = """panel_nation as (select n_name as series, last_day(o_orderdate::date) as date, sum(o_totalprice::decimal(18,2))::double / 7e5 as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""
LEDGER_RAW = """ledger_raw as (select last_day(o_orderdate::date) as record_date, o_orderdate::date as issue_date, l_shipdate::date as maturity_date, p_type as class_text,
  l_extendedprice as amount, l_discount as coupon, l_tax as yield from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""


def normal_p_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{x} * {x}))"


RESULTS = f"""base as (select c_mktsegment as treatment, o_orderpriority as outcome, l_linenumber as horizon, l_returnflag as flag, l_discount::decimal(6,2) as y, l_tax::decimal(6,2) as x
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
cells as (select treatment, outcome, horizon, flag, count(*) as n, sum(x)::double as sx, sum(y)::double as sy, sum(x * x)::double as sxx, sum(x * y)::double as sxy, sum(y * y)::double as syy from base group by all),
moments as (
  select 'lp' as estimator, treatment, outcome, horizon, sum(n)::bigint as n, sum(sxx) - sum(sx) * sum(sx) / sum(n) as xx, sum(sxy) - sum(sx) * sum(sy) / sum(n) as xy, sum(syy) - sum(sy) * sum(sy) / sum(n) as yy from cells group by all
  union all
  select 'dml', treatment, outcome, horizon, sum(n)::bigint, sum(sxx - sx * sx / n), sum(sxy - sx * sy / n), sum(syy - sy * sy / n) from cells group by all),
fits as (select estimator, treatment, outcome, horizon, n, round(xy / xx, 9) as estimate, round(sqrt(greatest(yy - xy * xy / xx, 0) / (n - 2) / xx), 9) as se from moments where n > 4 and xx > 1e-12),
scored as (select *, round(estimate / se, 9) as z from fits where se > 0),
results as (select *, round({normal_p_sql('z')}, 9) as p from scored)"""
