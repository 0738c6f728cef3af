"""Importance resampling towards a target distribution: hashed n-grams of overlapped regex scans, weights, and a Gumbel draw."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from macrotide.llm.store import discard, table, written

#: Bytes that separate words, once A-Z are lower-cased: all of ASCII but digits and letters.
SEPARATORS = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, MIN_N, MAX_N = 10_000, 1, 1
SEED, MIN_WORDS, PERCENT = 2024, 20, 10


def scanner(n: int) -> bytes:
    """A pattern for n words of a text whose words are joined by one space: scanned overlapped, it matches at every word, and only there."""
    return rb"(?<![^ ])" + rb"[^ ]+ " * (n - 1) + rb"[^ ]+(?![^ ])"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_n: int = MIN_N, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts): how often each bucket occurs in every row's whole text, as two arrays in order of bucket.

    A feature is a run of ``min_n`` to ``max_n`` words; its bucket is the CRC-32 of its UTF-8 bytes
    modulo ``buckets``. A null, empty or wordless text has none. Repeated rows each give a row,
    other columns are not read, an empty table gives no rows. A task holds one text and its
    counts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        apart, scans = re.compile(SEPARATORS), [regex.compile(scanner(n)) for n in range(min_n, max_n + 1)]
        for batch in batches:
            words, sizes, found, times = [], [], [], []
            for text in batch.column(1):
                line = apart.sub(b" ", (text.as_py() or "").encode().lower()).strip(b" ")
                spans = Counter(m.group() for scan in scans for m in scan.finditer(line, overlapped=True))
                own = Counter()
                for span, count in spans.items():
                    own[zlib.crc32(span) % buckets] += count
                held = sorted(own)
                words.append(line.count(b" ") + 1 if line else 0)
                sizes.append(spans.total())
                found.append(held)
                times.append([own[b] for b in held])
            columns = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets array<int>, counts array<long>")


def bucket_counts(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of every bucket in all rows of ``features``; summed up by Spark, a table of a fixed size comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2))
            np.add.at(total, at, times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in counted.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the target's smoothed share over the source's) of every bucket."""
    s, t, size = source.astype(float), target.astype(float), len(source)
    return np.floor(scale * np.log((t + 1) * (source.sum() + float(size)) / ((s + 1) * (target.sum() + float(size))))).astype(np.int64)


def weights(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of each row's features, 0 without any."""
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
            row = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, gain[at] * times)
            size = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total // np.maximum(size, 1))], names)

    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))) with u from the SHA-256 of seed and id; a null id counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(scale) * F.log(-F.log(u)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` numbered from 1 in an order: dealt to ranges, numbered in each, and moved up by the rows of the ranges before."""
    ranges = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))  # a row for each range
    here = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.withColumn(name, here).join(F.broadcast(before), "range").select(*rows.columns, (F.col(name) + F.col("before")).alias(name))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_n: int = MIN_N, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null unless the row is drawn.

    Rows of at least ``min_words`` words compete; floor(percent / 100) of them with the highest
    scores are drawn, ties to the smaller id (null ids first, then fewer features; rows alike in
    all of these in any order). Nulls, empty and long texts and repeats as in ``features``. With
    an empty ``target`` the gains rest on smoothing alone; an empty ``docs`` gives no rows.
    """
    options = {"text_col": text_col, "min_n": min_n, "max_n": max_n, "buckets": buckets}
    counted = written(features(docs, id_col, **options), "features")
    aims = features(target.withColumn("no id", F.lit(0)), "no id", **options)
    scored = weights(counted, gains(bucket_counts(counted, buckets), bucket_counts(aims, buckets)))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("idle", F.col("n_words") < min_words)
    out = ranked(scored, [F.col("idle"), F.col("score").desc(), F.col("doc_id"), F.col("n_features")])
    (able,) = out.agg(F.count_if(~F.col("idle"))).first()
    discard(counted)
    drawn = ~F.col("idle") & (F.col("rank") <= percent * able // 100)
    return out.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).cast("long").alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw of a tenth of ``documents`` towards ``benchmark``; nulls, ties and the like as in ``resample``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with words as (select 'd' as side, doc_id as id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select 'b', null, null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
occurrences as (select side, row, w, count(*) as n from (select side, row, unnest(w) as w from words) group by all),
lookup as (select list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, step: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
bytes as (select w, list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::bigint, 2))::bigint) as b from (select distinct w from occurrences)),
hashed as (select w, xor(list_reduce(list_concat([4294967295::bigint], b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, lookup),
sums as (select bucket, sum(n) filter (side = 'd') as s, sum(n) filter (side = 'b') as t from occurrences join hashed using (w) group by bucket),
gains as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (sum(s) over () + 10000)::double / ((coalesce(s, 0) + 1)::double * (coalesce(sum(t) over (), 0) + 10000)::double)))::bigint as gain from sums),
weighed as (select row, sum(n)::bigint as n, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight from occurrences join hashed using (w) join gains using (bucket) where side = 'd' group by row),
scored as (select id as doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::varchar, '')), 1, 8))::bigint::double + 0.5) / 4294967296.0::double)))::bigint as score
  from words left join weighed using (row) where side = 'd'),
ordered as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls first, n_features) as place, count(*) filter (n_features >= 20) over () as able from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * able // 100 then place end as rank from ordered
"""
