"""Audit of how sources differ: vocabularies by language, exact sparse document vectors, group sums and sparse comparison of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from macrotide.llm.fertility import coded
from macrotide.llm.store import beside, table, written
from macrotide.llm.text import texts

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, ADDED, SCALE, TOP = 3, 1, 1_000_000_000, 200
#: ``CountVectorizer`` gathers its vocabulary on the driver and sends it to every task: it is used if there can be no more terms than this.
DRIVER_TERMS = 1 << 18
MAX_VOCABULARY = (1 << 31) - 1

_IN_TERM, _LOWERED = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWERED[65:91] += 32


def _keyed(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def term_vectors(keyed: DataFrame) -> DataFrame:
    """(lang, source, terms, counts) of every row of (lang, source, text): the sparse vector of its whole text, keyed by the terms themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in texts(batch.column(2)):
                inside = np.concatenate([[False], _IN_TERM[data], [False]])
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
                ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
                codes, distinct = coded(_LOWERED[data], begins, ends)
                wide = max(1, len(distinct))
                key, count = np.unique((np.searchsorted(offsets, begins, "right") - 1) * wide + codes, return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(len(offsets)) * wide), pa.int32())
                terms = pa.array(distinct, pa.string()).take(pa.array(key % wide))
                vectors = [pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(count, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], *vectors], ["lang", "source", "terms", "counts"])

    return keyed.mapInArrow(run, "lang string, source string, terms array<string>, counts array<long>")


def sums_of_term_vectors(vectors: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): vectors summed by group, before anything is shuffled."""
    entries = vectors.select("lang", "source", F.inline(F.arrays_zip("terms", "counts")))
    return entries.groupBy("lang", "source", F.col("terms").alias("term")).agg(F.sum("counts").alias("n"), F.count(F.lit(1)).alias("docs"))


def sums_of_model_vectors(keyed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The same for the terms in at least ``min_docs`` documents of their language, by ``CountVectorizer``.

    One model serves all languages: a word is language, zero byte and term, so that its document
    frequency is the term's in that language. The vocabulary is not cut. Sparse vectors are
    summed entry by entry, as a ``Summarizer`` would fill an array of the vocabulary's length for
    every group.
    """
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    words = written(keyed.select("lang", "source", F.transform(terms, lambda t: F.concat("lang", F.lit("\0"), t)).alias("words")), "words")
    schema = "lang string, source string, term string, n long, docs long"
    frequent = words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count().filter(F.col("count") >= min_docs)
    if frequent.isEmpty():  # a model without a vocabulary cannot be fitted
        return keyed.sparkSession.createDataFrame([], schema)
    model = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(min_docs), vocabSize=MAX_VOCABULARY).fit(words)
    vectors = model.transform(words).select("lang", "source", F.unwrap_udt("vector").alias("vector"))
    entries = vectors.select("lang", "source", F.inline(F.arrays_zip("vector.indices", "vector.values")))
    sums = entries.toDF("lang", "source", "index", "times").groupBy("lang", "source", "index").agg(F.sum("times").cast("long").alias("n"), F.count(F.lit(1)).alias("docs"))
    named = keyed.sparkSession.createDataFrame([(i, w.rpartition("\0")[2]) for i, w in enumerate(model.vocabulary)], "index int, term string")
    return sums.join(named, "index").select(*[c.split()[0] for c in schema.split(", ")])


def _share(count: Column, total: Column, size: Column, added: int, scale: int) -> Column:
    """1 + floor(scale * (count + added) / (total + added * size)), exact; null where there is no term at all."""
    wide = [c.cast("decimal(20,0)") for c in (count + added, total + added * size)]
    return 1 + F.call_function("div", (F.lit(scale).cast("decimal(11,0)") * wide[0]).cast("decimal(38,0)"), F.nullif(wide[1].cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, added: int = ADDED, scale: int = SCALE, top: int = TOP, driver_terms: int = DRIVER_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of a language differ from each other and from the language.

    A group is a (lang, source) that occurs; null lang, source and text count as ''. A language's
    V terms are those in at least ``min_docs`` of its documents. Every group, and every language,
    gives each of them a smoothed share p = 1 + floor(scale * (count + added) / (N + added * V)),
    N its occurrences of them all. Two shares differ by floor((p - q)^2 / q). Part ``pair`` has a row
    for each other source of the language, its value the sum over all V terms (0 without terms);
    part ``term`` has the first ``top`` terms that the group has and uses more than the language.
    Ranks count from 1 by value, then by item in byte order. Repeated rows count each time,
    texts are read whole, other columns are not read, an empty table gives no rows.

    Vectors are by ``CountVectorizer`` if its vocabulary is within ``driver_terms`` for certain: a
    term in ``min_docs`` documents takes as many bytes and separators at least. Else they are keyed
    by terms, and the vocabulary stays a table. Both give the same sums. Terms that a group lacks share one p, so that pairs are worked out from
    the terms that occur: from the number of a group's terms with each p, and from the terms that
    both groups have.
    """
    keyed = _keyed(docs, lang_col, source_col, text_col)
    (most,) = keyed.agg(F.sum(F.octet_length("text") + 1)).first()
    few = (most or 0) <= driver_terms * 2 * min_docs
    sums = sums_of_model_vectors(keyed, min_docs) if few else sums_of_term_vectors(term_vectors(keyed))
    return compare(keyed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).select("lang", "source"), sums, min_docs, added, scale, top)


def compare(groups: DataFrame, sums: DataFrame, min_docs: int, added: int, scale: int, top: int) -> DataFrame:
    """The audit of ``groups`` (lang, source) from ``sums`` (lang, source, term, n, docs)."""
    groups = written(groups, "groups")
    by_term = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = written(by_term.filter(F.col("docs") >= min_docs).drop("docs"), "vocabulary")  # a row for each term, with an entry for each source that has it
    in_lang = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n")), "lang", "left").fillna(0)
    in_group = kept.select("lang", F.inline("by_source")).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    sized = groups.join(in_lang, "lang").join(in_group, ["lang", "source"], "left").fillna(0)
    zero = F.lit(0).cast("long")
    sized = written(sized.withColumn("p0", _share(zero, F.col("group_n"), F.col("terms"), added, scale)), "sized")

    entries = beside(kept.select("lang", "term", "total", F.inline("by_source")), sized, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("group_n"), F.col("terms"), added, scale), _share(F.col("total"), F.col("lang_n"), F.col("terms"), added, scale)
    entries = written(entries.select("lang", "term", "source", "p0", p.alias("p"), q.alias("q")), "shares")

    def ranks(rows: DataFrame) -> Column:
        return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))

    terms = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", ranks(terms)).filter(F.col("rank") <= top)

    others = sized.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = sized.select("lang", "source", "terms", "p0").join(others, "lang").filter("source <> item")
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * _gap(F.col("p0"), F.col("q0")), F.lit(0)).alias("part"))
    level = entries.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("m"))
    own = level.join(others, "lang").filter("source <> item")
    own = own.select("lang", "source", "item", (F.col("m") * (_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))).alias("part"))
    theirs = level.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("p").alias("q"), "m")
    theirs = theirs.join(sized.select("lang", "source", "p0"), "lang").filter("source <> item")
    theirs = theirs.select("lang", "source", "item", (F.col("m") * (_gap(F.col("p0"), F.col("q")) - _gap(F.col("p0"), F.col("q0")))).alias("part"))
    both = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("a"))
    both = both.select("lang", F.explode("a").alias("x"), "a").select("lang", "x", F.explode("a").alias("y")).filter("x.source <> y.source")
    p, p0, q, q0 = (F.col(c) for c in ("x.p", "x.p0", "y.p", "y.p0"))
    both = both.select("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), (_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)).alias("part"))
    pairs = base.unionByName(own).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    pairs = pairs.withColumn("rank", ranks(pairs))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of ``documents``; nulls, repeats and the like as in ``audit``."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
entries as (select lang, source, row, w, count(*) as n from (select lang, source, row, unnest(w) as w from docs) group by all),
kept as (select lang, w, sum(n)::hugeint as n from entries group by lang, w having count(*) >= 3),
groups as (select distinct lang, source from docs),
langs as (select lang, (select count(*) from kept k where k.lang = l.lang)::hugeint as v, coalesce((select sum(n) from kept k where k.lang = l.lang), 0)::hugeint as total from (select distinct lang from docs) l),
counts as (select g.lang, g.source, k.w, k.n as lang_n, coalesce(c.n, 0)::hugeint as n from groups g join kept k using (lang)
  left join (select lang, source, w, sum(n) as n from entries group by all) c on c.lang = g.lang and c.source = g.source and c.w = k.w),
sized as (select c.*, v, total, sum(n) over (partition by c.lang, source)::hugeint as own from counts c join langs using (lang)),
shares as (select *, 1 + 1000000000::hugeint * (n + 1) // (own + v) as p, 1 + 1000000000::hugeint * (lang_n + 1) // (total + v) as q from sized),
pairs as (select a.lang, a.source, b.source as item, coalesce((select sum((x.p - y.p) * (x.p - y.p) // y.p) from shares x join shares y on x.lang = y.lang and x.w = y.w
  where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source),
terms as (select lang, source, w as item, ((p - q) * (p - q) // q)::bigint as value from shares where n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms)
select * from ranked where part = 'pair' or rank <= 200
"""
