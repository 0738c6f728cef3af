"""Quality rules from tokeniser fertility: how well public vocabularies fit a document's words, judged against its language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import beside, table, written
from macrotide.llm.text import Words, texts

#: The vocabulary whose tokens give all three measures (it falls back to bytes), and a byte-level one whose characters per token are held beside it.
PIECES, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Words whose tokens a task remembers.
REMEMBERED = 400_000
#: A document fails the base rules with fewer words, or with a greater percentage of repeated words.
MIN_WORDS, MAX_REPEATED = 50, 50


@lru_cache(maxsize=4)
def encoder(path: str):
    """(function from a list of words to their lists of ids, flags of the ids that are single bytes of no piece)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        single = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.get_piece_size())])
        return lambda words: model.encode(words, num_threads=1), single
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda words: [model.encode_ordinary(w) for w in words], np.zeros(max(ranks.values()) + 1, bool)


class WordTokens:
    """Ids of single words by a vocabulary that falls back to bytes, and how many tokens a byte-level one makes of them.

    A word is encoded once while it is remembered: up to REMEMBERED words, then all are forgotten.
    """

    def __init__(self, pieces: str, byte_level: str):
        (self.encode, self.single), (self.encode_bytes, _) = encoder(pieces), encoder(byte_level)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.size, self.byte_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """Where ``size`` and ``byte_size`` have the words' numbers of tokens."""
        if len(self.place) > REMEMBERED:
            self._forget()
        place = self.place
        new = [w for w in words if w not in place]
        found = self.encode(new)
        place.update(zip(new, range(len(place), len(place) + len(new))))
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.int32))
        self.size = np.append(self.size, np.fromiter(map(len, found), np.int64))
        self.byte_size = np.append(self.byte_size, np.fromiter(map(len, self.encode_bytes(new)), np.int64))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def spread(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after another."""
        size = self.size[places]
        first = np.cumsum(self.size) - self.size
        return self.ids[np.repeat(first[places] - np.cumsum(size) + size, size) + np.arange(size.sum())]


@lru_cache(maxsize=1)
def word_tokens(pieces: str, byte_level: str) -> WordTokens:
    """One for all tasks of a Python worker."""
    return WordTokens(pieces, byte_level)


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Codes of the spans data[start:end], equal where their bytes are, and the distinct spans in order of code."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    gathered = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])] if at[-1] else np.zeros(0, np.uint8)
    spans = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(gathered)).dictionary_encode()
    return spans.indices.to_numpy().astype(np.int64), spans.dictionary.to_pylist()


def _renumbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each distinct pair, from 0."""
    wide = int(b.max()) + 1 if len(b) else 1
    return np.unique(a * wide + b, return_inverse=True)[1].astype(np.int64)


def repeated_words(codes: np.ndarray, doc: np.ndarray, docs: int, window: int = 3) -> np.ndarray:
    """For each text, its words inside windows of so many consecutive words that the text holds twice or more, first ones included."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    run = _renumbered(doc[:n], codes[:n])
    for i in range(1, window):
        run = _renumbered(run, codes[i : n + i])
    whole = doc[:n] == doc[window - 1 :]
    times = np.bincount(run[whole], minlength=n)
    often = whole & (times[run] > 1)
    covered = np.zeros(len(codes), bool)
    for i in range(window):
        covered[i : n + i] |= often
    return np.bincount(doc[covered], minlength=docs)


def duplicate_lines(words: Words) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line of it."""
    data, offsets = words.data, words.offsets
    docs = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)  # a line's end is not part of it
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[full], ends[full]
    if not len(starts):
        return np.zeros(docs, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    codes, _ = coded(data, starts, ends)
    distinct = np.unique(doc * (int(codes.max()) + 1) + codes) // (int(codes.max()) + 1)
    return np.bincount(doc, minlength=docs) - np.bincount(distinct, minlength=docs)


def entropies(doc: np.ndarray, ids: np.ndarray, docs: int) -> np.ndarray:
    """Shannon entropy in bits of each text's tokens, 0 without any."""
    wide = int(ids.max()) + 1 if len(ids) else 1
    key, count = np.unique(doc * wide + ids, return_counts=True)
    own = key // wide
    total = np.bincount(doc, minlength=docs)
    share = count / total[own]
    return np.bincount(own, -share * np.log2(share), docs) + 0.0


SYMBOLS, SPACE = np.zeros(256, bool), np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SPACE[[32, *range(9, 14)]] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_byte_token double, byte_share double, token_entropy double"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    after = np.concatenate([[0], np.cumsum(flags)])
    return after[offsets[1:]] - after[offsets[:-1]]


def described(data: np.ndarray, offsets: np.ndarray, vocabulary: WordTokens) -> list[np.ndarray]:
    """The columns of MEASURES for texts that lie beside each other in ``data``."""
    words = Words(data, offsets)
    docs = len(words.counts)
    codes, distinct = coded(data, words.starts, words.ends)
    places = vocabulary.places(distinct)[codes]
    ids = vocabulary.spread(places)
    token_doc = np.repeat(words.doc, vocabulary.size[places])
    n_tokens = np.bincount(token_doc, minlength=docs)
    single = np.bincount(token_doc[vocabulary.single[ids]], minlength=docs)
    byte_tokens = np.bincount(words.doc, vocabulary.byte_size[places], docs)
    chars = _sums(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
    some = np.maximum(n_tokens, 1)
    return [
        words.counts, chars, _sums(SYMBOLS[data], offsets), duplicate_lines(words), repeated_words(codes, words.doc, docs), n_tokens,
        chars / some, chars / np.maximum(byte_tokens, 1), single / some, entropies(token_doc, ids, docs),
    ]


#: What bands are set for: measure -> whether low values are rejected too.
BANDED = {"chars_per_token": True, "chars_per_byte_token": True, "byte_share": False, "token_entropy": True}
#: A band reaches so many robust standard deviations (of at least LEAST_SPREAD) from its language's median.
WIDTH, LEAST_SPREAD = 6.0, 0.01
#: Languages with fewer documents past the base rules have no bands.
LEAST_DOCS = 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: str | None = None, byte_level: str | None = None) -> DataFrame:
    """(doc_id, lang, the columns of MEASURES, base_failed) of every row of ``docs``, from whole texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` and are encoded one by one by both vocabularies (paths). A
    null or empty text has no words and 0 in every measure. Repeated rows each give a row, other
    columns are not read, an empty table gives no rows. A task holds about a megabyte of texts,
    or a single longer one, at a time.
    """
    pieces, byte_level = pieces or vocabulary_path(PIECES), byte_level or vocabulary_path(BYTE_LEVEL)
    kinds = {"long": pa.int64(), "double": pa.float64()}
    columns = [c.split() for c in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_tokens(pieces, byte_level)
        for batch in batches:
            for part, data, offsets in texts(batch.column(2)):
                own = [pa.array(np.asarray(c), kinds[kind], safe=False) for (_, kind), c in zip(columns, described(data, offsets, vocabulary))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], *own], ["doc_id", "lang", *[name for name, _ in columns]])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, {MEASURES}").withColumn("base_failed", failed)


def _rounded(name: str) -> Column:
    """To three places and at most 1,000, so that a median's table of values is bounded however many documents there are."""
    return F.least(F.round(name, 3), F.lit(1000.0))


def bands(measured: DataFrame, width: float = WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, low_<measure>, high_<measure>): one row for each language, from all its documents past the base rules.

    A band is the median plus and minus ``width`` robust standard deviations (1.4826 times the
    median distance from the median). Null bounds reject nothing: the lower one of a measure
    judged by its upper end only, and all of a language with fewer than ``least_docs`` documents.
    """
    past = measured.filter("not base_failed")
    middle = past.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *[F.percentile(_rounded(m), F.lit(0.5)).alias(f"mid_{m}") for m in BANDED])
    away = beside(past, written(middle, "middles"), ["lang"]).groupBy("lang", "docs", *[f"mid_{m}" for m in BANDED])
    spread = away.agg(*[F.percentile(F.round(F.abs(_rounded(m) - F.col(f"mid_{m}")), 3), F.lit(0.5)).alias(f"off_{m}") for m in BANDED])
    reach = {m: width * F.greatest(1.4826 * F.col(f"off_{m}"), F.lit(LEAST_SPREAD)) for m in BANDED}
    known = F.col("docs") >= least_docs
    low = [F.when(known & F.lit(both), F.col(f"mid_{m}") - reach[m]).alias(f"low_{m}") for m, both in BANDED.items()]
    high = [F.when(known, F.col(f"mid_{m}") + reach[m]).alias(f"high_{m}") for m in BANDED]
    return spread.select("lang", *low, *high)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``rejected_by`` (names of the measures outside their language's band) and ``kept``.

    ``kept`` is false for a row that fails the base rules or has a measure outside its band.
    """
    outside = [F.when((F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}")), F.lit(m)) for m in BANDED]
    joined = beside(measured, limits, ["lang"], "left").withColumn("rejected_by", F.array_compact(F.array(*outside)))
    return joined.select(*measured.columns, "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def op12_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility, base rules and verdict of every row of ``documents``; nulls, repeats and the like as in ``measure``."""
    measured = written(measure(table(spark, sf_dir, "documents")), "fertility")
    return judge(measured, written(bands(measured), "bands"))
