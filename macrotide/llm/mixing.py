"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from macrotide.llm.store import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Source tables of up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with sums of columns over all rows before each, in an order dealt to ranges; one task sees a row for each range only."""
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(f"{name}_here") for name, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *[F.coalesce(F.sum(f"{name}_here").over(earlier), F.lit(0)).alias(f"{name}_earlier") for name in sums])
    out = ranged.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(totals), "range")
    return out.select(*rows.columns, *[(F.col(name) + F.col(f"{name}_earlier")).alias(name) for name in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all
    sizes. No target exceeds ``max_repeats`` times its source's size: with caps c and weights
    w, target = min(c, level * w), where the level that shares everything is the greatest
    (total - caps below) / (weights not below) over the sources by c / w. Sources are ranked
    within ranges, so that they may be as many as sites.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = _with_sums_before(totals, by_name, {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    summed = _with_sums_before(ranked, [F.col("cap") / F.col("weight"), *by_name], {"below": F.col("cap"), "weight_below": F.col("weight")})
    total, weighed = summed.agg(F.sum("source_size"), F.sum("weight")).first()  # one row
    (level,) = summed.agg(F.max((F.lit(total) - F.col("below")) / (F.lit(weighed) - F.col("weight_below")))).first()
    return (
        summed.withColumn("target", F.least(F.col("cap").cast("double"), F.greatest(F.lit(0.0), F.lit(level).cast("double") * F.col("weight"))))
        .withColumn("rate", F.coalesce(F.least(F.try_divide("target", "source_size"), F.lit(float(max_repeats))), F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and the seed, the same in every run and engine; a null id draws as ''."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, size: Column | None = None) -> DataFrame:
    """(doc, size, source_size, target, copies), where ``doc`` is a struct of the row of ``docs``.

    ``size`` is a document's size; unless it is given, the words of the text, 0 of a null one.
    Null sources are one source. Repeated rows are planned alike, each for itself. Copies:
    floor(rate) plus one where ``draw`` is below the fraction. Sources whose size is 0 have
    target and copies 0. Very long texts are counted whole. An empty table gives no rows.
    """
    size = word_count(F.col(text_col)) if size is None else size
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("own_source"), size.alias("size"))
    targets = written(source_targets(sized.select(F.col("own_source").alias("source"), "size"), weights, max_repeats), "mix-targets")
    held = targets.agg(F.sum(F.coalesce(F.length("source"), F.lit(0)) + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    copies = F.floor("rate") + (draw(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return sized.join(targets, F.col("own_source").eqNullSafe(F.col("source"))).select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    planned = plan_mix(docs, **options).filter("copies > 0")
    return planned.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of ``documents``; texts are read once. Nulls, repeats and the like as in ``plan_mix``."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    planned = plan_mix(sized, size=F.col("size"))
    return planned.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from totals),
capped as (select *, source_size * 3 as cap,
  coalesce(sum(source_size * 3) over (order by source_size * 3 / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as below,
  sum(weight) over (order by source_size * 3 / weight, source nulls last rows between current row and unbounded following) as rest from ranked),
levelled as (select *, max(((select sum(source_size) from totals) - below)::double / rest) over () as level from capped),
targets as (select source, source_size, least(cap::double, greatest(0.0::double, level * weight)) as target from levelled),
rated as (select d.doc_id, d.size, t.source_size, t.target, coalesce(least(t.target / nullif(t.source_size, 0), 3.0), 0.0) as rate,
  ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint::double / 4294967296.0 as u
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) as taken from rated
"""
