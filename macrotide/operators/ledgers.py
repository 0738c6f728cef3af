"""Security ledgers: cleaning and per-date metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text in a class name, and the type it means, in order of precedence (fixed values).
TYPES = (("PROMO", "bill"), ("ECONOMY", "note"), ("MEDIUM", "bond"), ("SMALL", "tips"), ("STANDARD", "frn"))
#: Upper bounds in years of the maturity buckets (fixed values).
BUCKETS = ((1.0, "to_1y"), (3.0, "1_3y"), (5.0, "3_5y"), (7.0, "5_7y"), (10.0, "7_10y"), (None, "over_10y"))


def clean_ledger(raw: DataFrame) -> DataFrame:
    """Types from class text, remaining and original years (remaining at least 0); without aggregate rows, matured securities and amounts of 0 or less."""
    kind: Column | None = None
    for text, name in TYPES:
        test = F.contains(F.upper("class_text"), F.lit(text))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    remaining = F.greatest(F.datediff("maturity_date", "record_date") / 365.25, F.lit(0.0))
    out = raw.filter(~F.contains(F.lower("class_text"), F.lit("total"))).withColumns({"type": kind.otherwise("other"), "remaining": remaining, "original": F.datediff("maturity_date", "issue_date") / 365.25})
    return out.filter((F.col("amount") > 0) & (F.col("maturity_date") >= F.col("record_date")))


def ledger_metrics(ledger: DataFrame) -> DataFrame:
    """Totals, type shares, value-weighted maturity, coupon and yield, new issues and maturity buckets by record date, in one aggregation."""
    amount = F.col("amount")
    total = F.sum(amount)

    def weighted(x: str) -> Column:
        return F.try_divide(F.sum(amount * F.col(x)), F.sum(F.when(F.col(x).isNotNull(), amount)))

    shares = [F.try_divide(F.sum(F.when(F.col("type") == name, amount).otherwise(0.0)), total).alias(f"{name}_share") for _, name in (*TYPES, (None, "other"))]
    buckets, low = [], 0.0
    for high, name in BUCKETS:
        inside = (F.col("remaining") > low) if low else F.lit(True)
        inside = inside & (F.col("remaining") <= high) if high else inside
        part = F.sum(F.when(inside, amount).otherwise(0.0))
        buckets += [part.alias(f"amount_{name}"), F.try_divide(part, total).alias(f"share_{name}")]
        low = high
    fresh = F.sum(F.when(F.last_day("issue_date") == F.col("record_date"), amount).otherwise(0.0))
    return ledger.groupBy("record_date").agg(total.alias("total"), F.count("*").alias("securities"), *shares, weighted("remaining").alias("wam"), weighted("coupon").alias("coupon"), weighted("yield").alias("yield"), fresh.alias("new_issues"), *buckets)
