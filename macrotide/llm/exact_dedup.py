"""Exact deduplication with a log-structured merge index of text digests, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import discard, table, written

#: Memtables that a table is flushed in; runs of one level that are merged into one of the next.
BATCHES, FAN = 4, 3
#: Bits of a filter for each of its digests, at least; a filter of more than MAX_BITS (16 MB) is left out, and digests are joined themselves.
BITS_EACH, MAX_BITS = 8, 1 << 27
#: Keys of dropped rows (some 64 bytes each) of up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def digest_filter(digests: DataFrame, n: int) -> tuple[DataFrame, int] | None:
    """(bitmap rows (bucket, bits), size in bits) of the ``n`` rows of a column ``digest``, or None if it would be too large to broadcast."""
    size = 1 << 15
    while size < BITS_EACH * n:
        size *= 2
    if size > MAX_BITS:
        return None
    slot = _slot(size)
    return digests.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")), size


def may_contain(rows: DataFrame, digests: DataFrame, found: tuple[DataFrame, int] | None) -> DataFrame:
    """Rows whose digest the filter of ``digests`` may hold; without one, those whose digest is there."""
    if found is None:
        return rows.join(digests, "digest", "left_semi")
    slot = _slot(found[1])
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, cast(at % 8 as int)) & 1")
    return (
        rows.withColumns({"bucket": F.bitmap_bucket_number(slot), "at": at})
        .join(F.broadcast(found[0]), "bucket")  # MAX_BITS at most
        .withColumn("byte", byte)
        .filter(bit == 1)
        .drop("bucket", "at", "byte", "bits")
    )


def merged(rows: DataFrame) -> DataFrame:
    """One row for each digest from rows (digest, smallest, largest, n, n_largest); a null id is smaller than any other."""
    by_top = rows.groupBy("digest", "largest").agg(F.min("smallest").alias("smallest"), F.sum("n").alias("n"), F.sum("n_largest").alias("n_largest"))
    return (
        by_top.groupBy("digest")
        .agg(F.min("smallest").alias("smallest"), F.max(F.struct("largest", "n_largest")).alias("top"), F.sum("n").alias("n"))
        .select("digest", "smallest", F.col("top.largest").alias("largest"), "n", F.col("top.n_largest").alias("n_largest"))
    )


class DigestLog:
    """A log-structured merge index: runs ``(digest, smallest, largest, n, n_largest)`` sorted by digest, in levels, each with a filter.

    ``flush`` writes a memtable as a run of level 0 and looks its digests up in older runs, behind
    their filters. FAN runs of one level are compacted into one of the next, which keeps the
    smallest and the largest id of each digest.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.runs = spark, []

    def flush(self, rows: DataFrame) -> DataFrame:
        """Add (id, digest); returns the digests (digest) that this batch repeats: within itself, or of older runs."""
        one = F.lit(1).cast("long")
        run = self._add(0, rows.select("digest", F.col("id").alias("smallest"), F.col("id").alias("largest"), one.alias("n"), one.alias("n_largest")))
        hits = run.filter("n > 1").select("digest")
        for _, older, found in self.runs[:-1]:
            hits = hits.unionByName(may_contain(run.select("digest"), older.select("digest"), found).join(older.select("digest"), "digest", "left_semi"))
        hits = written(hits.dropDuplicates(), "digest-hits")
        level = 0
        while sum(own == level for own, _, _ in self.runs) >= FAN:
            self._compact(level)
            level += 1
        return hits

    def lookup(self) -> DataFrame:
        """One row for each digest of all runs."""
        rows = None
        for _, run, _ in self.runs:
            rows = run if rows is None else rows.unionByName(run)
        return merged(rows)

    def tables(self) -> list[DataFrame]:
        return [x for _, run, found in self.runs for x in (run, *(found or ())[:1])]

    def _compact(self, level: int) -> None:
        old = [run for own, run, _ in self.runs if own == level]
        rows = old[0]
        for run in old[1:]:
            rows = rows.unionByName(run)
        self.runs = [x for x in self.runs if x[0] != level]
        self._add(level + 1, rows)
        discard(*old)

    def _add(self, level: int, rows: DataFrame) -> DataFrame:
        run = written(merged(rows).sortWithinPartitions("digest"), "digest-run")
        found = digest_filter(run.select("digest"), run.count())
        self.runs.append((level, run, found and (written(found[0], "digest-filter"), found[1])))
        return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, smallest, largest, n, n_largest) for every row of ``docs``.

    A null text counts as empty, and a null id is smaller than any other. Rows that repeat come
    out again, and each counts in ``n``. Digests that several rows share are verified byte for
    byte; if two texts ever share one, its rows are grouped by the text itself. Very long texts
    are read whole; other columns of ``docs`` play no part. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    digests = written(rows.select("id", "digest"), "digests")
    log, hits = DigestLog(docs.sparkSession), None
    for batch in range(BATCHES):
        found = log.flush(digests.filter(F.pmod(F.xxhash64("id"), F.lit(BATCHES)) == batch))
        hits = found if hits is None else hits.unionByName(found)
    hits = written(hits.dropDuplicates(), "digest-hits")
    known = digest_filter(hits, hits.count())
    verified = may_contain(rows.select("text", "digest"), hits, known).groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    clash = written(verified.filter("lo <> hi").select("digest"), "digest-clash")
    out = ["id", "digest", "smallest", "largest", "n", "n_largest"]
    index = written(log.lookup(), "digest-index")
    whole = digests.join(index, "digest").select(*out)
    if clash.limit(1).count() == 0:
        whole = written(whole, "exact-groups")
        discard(digests, index, hits, *log.tables())
        return whole
    apart = rows.join(clash, "digest")
    counted = apart.groupBy("digest", "text", "id").agg(F.count("*").alias("rows"))
    by_text = counted.groupBy("digest", "text").agg(F.min("id").alias("smallest"), F.max(F.struct("id", "rows")).alias("top"), F.sum("rows").alias("n"))
    split = apart.join(by_text, ["digest", "text"]).withColumns({"largest": F.col("top.id"), "n_largest": F.col("top.rows")})
    return whole.join(clash, "digest", "left_anti").select(*out).unionByName(split.select(*out))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest id, with all columns of ``docs``.

    A row without an id stays only if no row of its group has one. Of rows that tie, with one id
    and text, one stays. Columns of ``docs`` may have any names; an empty table gives no rows.
    """
    groups = exact_groups(docs, id_col, text_col)
    dropped = groups.filter(~F.col("id").eqNullSafe(F.col("largest"))).select(F.col("id").alias("dropped_id"), F.col("digest").alias("dropped_digest")).dropDuplicates()
    dropped = written(dropped, "exact-copies")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), digest.alias("digest"))
    rows = rows.join(dropped, (F.col("digest") == F.col("dropped_digest")) & F.col("id").eqNullSafe(F.col("dropped_id")), "left_anti")
    if groups.filter("n_largest > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "digest"])
    return rows.select("doc.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its group; rows that tie for the largest doc_id are all ``kept``."""
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("largest").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("largest")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP4_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
