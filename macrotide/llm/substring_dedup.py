"""Substring deduplication by seed and extend.

Winnowing gives every window of ``window`` words an anchor, its k-gram with the least hash, so
that equal windows have the same anchor at the same place. Consecutive windows with one anchor
are a span. Anchors that occur more than once are the seeds: documents are joined on them, each
span to the first one that is alike, and, where the spans of a seed differ, each window to the
first one that is alike. Matches that go on from one another are chained, compared word by word,
and extended both ways as far as words agree; what is as long as a window is kept, and repeats
that touch are joined to maximal ones.

No step puts all occurrences of a passage together: first occurrences are minima, summed up
before the shuffle, and every occurrence is then joined to one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import discard, table, written
from macrotide.llm.text import Words, drawn_key, gram_hashes, joined, run_hashes, texts

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 20, 8
#: Per-document lists of up to so many bytes in all are broadcast to the texts; larger ones meet them in a shuffle.
BROADCAST_BYTES = 48 << 20
NO_ID = -(1 << 63)


def spans_of(hashes: np.ndarray, others: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(doc, anchor hash, span hash, first window, windows) of all spans of texts with words first[i]:first[i + 1].

    hashes and others are two independent hashes of each word.
    """
    count = np.diff(first)
    windows = np.maximum(0, count - window + 1)
    doc = np.repeat(np.arange(len(count)), windows)
    start = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    key = gram_hashes(hashes, anchor)
    places = window - anchor + 1
    low = np.uint64(places.bit_length())
    least = np.full(len(start), np.iinfo(np.uint64).max)
    for d in range(places):  # the least hash in each window, and of equal ones the first
        np.minimum(least, (key[start + d] >> low) << low | np.uint64(d), out=least)
    at = start + (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    begin = start[head]
    whole = joined(run_hashes(others, begin, begin + n + window - 1), (at[head] - begin).astype(np.uint64))
    return doc[head], key[at[head]].view(np.int64), whole.view(np.int64), begin - first[:-1][doc[head]], n


def all_spans(docs: DataFrame, keys: list[str], window: int, anchor: int, key: int) -> DataFrame:
    """(*keys, seed, span, place) of (*keys, text); place is the first window and the number of windows, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in texts(batch.column(len(keys))):
                words = Words(data, offsets)
                doc, seed, span, begin, n = spans_of(words.hashes(0, key), words.hashes(1, key), words.first, window, anchor)
                own = [batch.column(i)[rows].take(pa.array(doc)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(seed), pa.array(span), pa.array(begin << 8 | n)], [*keys, "seed", "span", "place"])

    return docs.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", seed long, span long, place long")


def _with_lists(docs: DataFrame, lists: DataFrame, keys: list[str], how: str) -> DataFrame:
    """docs joined to a written table of one row for each document, by broadcast only if that is small."""
    size = sum((8 * F.size(c) for c, kind in lists.dtypes if kind.startswith("array")), F.lit(64))
    held = lists.agg(F.sum(size.cast("long"))).first()[0] or 0
    return docs.join(F.broadcast(lists) if held <= BROADCAST_BYTES else lists, keys, how)


def _kinds(keys: list[str]) -> str:
    return ", ".join(f"{k} long" for k in keys)


def window_hashes(docs: DataFrame, wanted: DataFrame, keys: list[str], window: int, key: int) -> DataFrame:
    """(*keys, hash, at) of every window of the spans in wanted (*keys, places: array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in texts(batch.column(len(keys))):
                words = Words(data, offsets)
                lists = batch.column(len(keys) + 1)[rows]
                place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                n = place & 255
                at = np.repeat(place >> 8, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.repeat(doc, n)
                hashed = gram_hashes(words.hashes(1, key), window)[words.first[:-1][doc] + at]
                own = [batch.column(i)[rows].take(pa.array(doc)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(hashed.view(np.int64)), pa.array(at)], [*keys, "hash", "at"])

    chosen = _with_lists(docs, wanted, keys, "inner").select(*keys, "text", "places")
    return chosen.mapInArrow(run, f"{_kinds(keys)}, hash long, at long")


def repeated_windows(docs: DataFrame, keys: list[str], window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(*keys, begin, n, first_*, first_begin): runs of n windows of (*keys, text) that start earlier too, by keys and then by place."""
    if window - anchor + 1 > 255:
        raise ValueError("a span packs its windows into eight bits: at most 254 more words in a window than in an anchor")
    key = drawn_key()
    spans = all_spans(docs, keys, window, anchor, key)
    # Minima are written before they are joined, so that the joins have shuffles of their own, of which Spark can split a frequent key.
    seeds = written(spans.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "seeds")
    repeated = written(spans.join(seeds, "seed"), "seeded-spans")
    here = F.struct(*keys, "place")
    firsts = written(repeated.groupBy("seed", "span").agg(F.min(here).alias("first")), "first-spans")
    first_keys = [F.col(f"first.{k}").alias(f"first_{k}") for k in keys]
    later = repeated.join(firsts, ["seed", "span"]).filter(here != F.col("first"))
    whole = later.select(*keys, F.shiftright("place", 8).alias("begin"), F.col("place").bitwiseAND(255).alias("n"), *first_keys, F.shiftright("first.place", 8).alias("first_begin"))
    varied = firsts.groupBy("seed").agg(F.min("span").alias("lo"), F.max("span").alias("hi")).filter("lo <> hi").select("seed")
    wanted = firsts.join(written(varied, "varied-seeds"), "seed").groupBy(*[F.col(f"first.{k}").alias(k) for k in keys]).agg(F.collect_list("first.place").alias("places"))
    windows = written(window_hashes(docs, written(wanted, "varied-spans"), keys, window, key), "span-windows")
    at = F.struct(*keys, "at")
    earliest = windows.groupBy("hash").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first")
    single = windows.join(written(earliest, "first-windows"), "hash").filter(at > F.col("first"))
    single = single.select(*keys, F.col("at").alias("begin"), F.lit(1).cast("long").alias("n"), *first_keys, F.col("first.at").alias("first_begin"))
    out = written(whole.unionByName(single), "matches")
    discard(seeds, repeated, firsts, windows)
    return out


def chains(matches: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(*keys, start, n_words, first_*, first_start): matches of a document that go on from one another, as one.

    A match whose first occurrence the document had matched before is taken as a match with that
    earlier place of its own, so that periodic texts chain too.
    """
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(width)
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            begin, n, *first, first_begin = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields))
            own = [batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in range(width)]
            order = np.lexsort((begin, first_begin, *first, doc))
            same = np.ones(max(0, len(order) - 1), bool)
            for x in (doc, first_begin, *first):
                same &= x[order][1:] == x[order][:-1]
            again, before = order[1:][same], order[:-1][same]
            first_begin, first = first_begin.copy(), [x.copy() for x in first]
            first_begin[again] = begin[before]
            for x, y in zip(first, own):
                x[again] = y[again]
            order = np.lexsort((begin, doc))
            doc, begin, n, first_begin = (x[order] for x in (doc, begin, n, first_begin))
            first, own = [x[order] for x in first], [x[order] for x in own]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] != begin[:-1] + n[:-1]) | (first_begin[1:] - begin[1:] != first_begin[:-1] - begin[:-1])
            for x in first:
                new[1:] |= x[1:] != x[:-1]
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(doc)) - 1
            n_words = begin[last] + n[last] + window - 1 - begin[head]
            columns = [*[x[head] for x in own], begin[head], n_words, *[x[head] for x in first], first_begin[head]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    names = [*keys, "start", "n_words", *[f"first_{k}" for k in keys], "first_start"]
    listed = matches.groupBy(*keys).agg(F.collect_list(F.struct("begin", "n", *[f"first_{k}" for k in keys], "first_begin")).alias("matches"))
    return listed.mapInArrow(run, _kinds(names))


def passages(docs: DataFrame, wanted: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """(*keys, start, n_words, lead, passage) for wanted (*keys, start, n_words): those words with up to ``margin`` more on each side, ``lead`` before them."""
    lists = written(wanted.dropDuplicates().groupBy(*keys).agg(F.collect_list("start").alias("starts"), F.collect_list("n_words").alias("sizes")), "wanted-passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            size = 0
            for i, (x, starts, sizes) in enumerate(zip(*[batch.column(len(keys) + j).to_pylist() for j in range(3)])):
                words = x.encode().split()
                for start, n in zip(starts, sizes):
                    low = max(0, start - margin)
                    own.append(i)
                    out.append((start, n, start - low, b" ".join(words[low : start + n + margin])))
                    size += len(out[-1][3])
                if size > 1 << 24 or out and i == len(batch) - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(j).take(pa.array(own)) for j in range(len(keys))], *columns], names)
                    own, out, size = [], [], 0

    names = [*keys, "start", "n_words", "lead", "passage"]
    return _with_lists(docs, lists, keys, "inner").select(*keys, "text", "starts", "sizes").mapInArrow(run, f"{_kinds(names[:-1])}, passage binary")


def agreed(x: list[bytes], y: list[bytes], at: int, n: int, window: int) -> list[tuple[int, int]]:
    """Runs [start, end) of at least ``window`` words in which x and y (laid beside each other) agree, from n words at ``at`` extended both ways."""
    if x[at : at + n] == y[at : at + n]:
        start, end = at, at + n
        while start and x[start - 1] == y[start - 1]:
            start -= 1
        while end < len(x) and end < len(y) and x[end] == y[end]:
            end += 1
        return [(start, end)]
    out, start = [], 0
    for i in range(min(len(x), len(y)) + 1):
        if i == min(len(x), len(y)) or x[i] != y[i]:
            if i - start >= window:
                out.append((start, i))
            start = i + 1
    return out


def extended(docs: DataFrame, chained: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(*keys, first, last): the runs of words of each document that, compared word by word, are repeats."""
    there = [F.col(f"first_{k}").alias(k) for k in keys]
    wanted = chained.select(*keys, "start", "n_words").unionByName(chained.select(*there, F.col("first_start").alias("start"), "n_words"))
    found = written(passages(docs, wanted, keys, 2 * window), "passages")
    theirs = found.select(*[F.col(k).alias(f"first_{k}") for k in keys], F.col("start").alias("first_start"), "n_words", F.col("lead").alias("their_lead"), F.col("passage").alias("theirs"))
    both = chained.join(found, [*keys, "start", "n_words"]).join(theirs, [*[f"first_{k}" for k in keys], "first_start", "n_words"])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            for i, (start, n, lead, x, their_lead, y) in enumerate(zip(*[batch.column(width + j).to_pylist() for j in range(6)])):
                shared = min(lead, their_lead)
                for a, b in agreed(x.split()[lead - shared :], y.split()[their_lead - shared :], shared, n, window):
                    own.append(i)
                    out.append((start - shared + a, start - shared + b))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[], []])]
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(pa.array(own, pa.int64())) for j in range(width)], *columns], [*keys, "first", "last"])

    out = written(both.select(*keys, "start", "n_words", "lead", "passage", "their_lead", "theirs").mapInArrow(run, f"{_kinds(keys)}, first long, last long"), "repeated-runs")
    discard(found)
    return out


def repeats(docs: DataFrame, keys: list[str], window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(*keys, starts, ends): the maximal repeats of each document that has any, in words."""
    matches = repeated_windows(docs, keys, window, anchor)
    chained = written(chains(matches, keys, window), "match-chains")
    discard(matches)
    runs = extended(docs, chained, keys, window).groupBy(*keys).agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for runs in batch.column(len(keys)).to_pylist():
                own: list[list[int]] = []
                for a, b in sorted((r["first"], r["last"]) for r in runs):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                starts.append([a for a, _ in own])
                ends.append([b for _, b in own])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(starts, kind), pa.array(ends, kind)], [*keys, "starts", "ends"])

    return runs.mapInArrow(run, f"{_kinds(keys)}, starts array<long>, ends array<long>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept, starts, ends]) for every row of ``docs``.

    Words covered by a window that also starts earlier go: with a smaller id, or earlier in the
    same text. A null text has no words; a null id is smaller than any other. Rows that repeat
    an id and text are one document and come out alike; of different texts under one id, the one
    with the smaller hash is the earlier. Very long texts are read whole; other columns of
    ``docs`` play no part, whatever their names. An empty table gives no rows.
    """
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    ids = docs.select(own_id.alias("own")).groupBy("own").count().filter("count > 1")
    keys = ["own"] + ["text_hash"] * bool(ids.limit(1).count())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(own_id.alias("own"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.col(id_col).alias("id"))
    once = rows if len(keys) == 1 else rows.dropDuplicates(keys)
    found = written(repeats(once.select(*keys, "text"), keys, window, anchor), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, starts, ends in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                words = x.encode().split()
                kept, at = [], 0
                for a, b in zip(starts or [], ends or []):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *[joined.decode()] * keep_text))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            spans = [batch.column(2), batch.column(3)] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *spans], names)

    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept", "starts", "ends"] * keep_text]
    kind = docs.schema[id_col].dataType.simpleString()
    both = _with_lists(rows, found, keys, "left").select("id", "text", "starts", "ends")
    return both.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string, starts array<long>, ends array<long>" * keep_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of all documents; nulls, repeats and the like as in ``remove_repeats``."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).withColumnRenamed("id", "doc_id")
