"""Hidden Markov language model: Baum-Welch over all training text, exact likelihoods by scaled forward recursion.

Symbols are the most frequent words, the end of a text, and classes of all other words by their
last bytes. A word of a class has the probability of its class times its share of the class,
(count + 1) / (sum of the class's counts + 1 + 1), in which words never seen together count as
one. So every text has an exact, proper probability, and no vocabulary that grows with the
corpus is ever sent to a task: counts beyond the table of frequent words are joined by shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import table, written
from macrotide.llm.text import Words, mixed, texts

#: States; words with a symbol of their own; words whose count is in the shared table; word classes.
STATES, FREQUENT, TABLED, CLASSES = 8, 1 << 15, 1 << 18, 1 << 10
#: Passes of Baum-Welch over all training text; weight of the unigram in each state.
PASSES, SMOOTHING = 4, 100.0
#: Passes that regroup all distinct training texts before the first states are taken from their groups.
REGROUPINGS = 2
#: Words in a numpy batch of sequences, and distinct words that a task sums before it hands them on.
BATCH, HELD = 1 << 20, 1 << 21


def word_classes(words: Words, classes: int = CLASSES) -> np.ndarray:
    """The class of each word, from its last three bytes."""
    key = np.zeros(len(words.starts), np.uint64)
    for back in (1, 2, 3):
        at = words.ends - back
        key = key * np.uint64(257) + np.where(at >= words.starts, words.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mixed(key) % np.uint64(classes)).astype(np.int64)


def corpus_key(docs: DataFrame) -> int:
    """A key for word hashes from all of (id, held_out, text): the same whenever they are, whatever their order."""
    (total,) = docs.agg(F.sum(F.xxhash64("id", "held_out", "text").cast("decimal(38,0)"))).first()
    return int.from_bytes(hashlib.blake2b(str(total or 0).encode(), digest_size=8).digest(), "little")


def count_words(docs: DataFrame, classes: int = CLASSES, key: int = 0) -> DataFrame:
    """(word, class, n): the count of every word hash in (text)."""

    def merged(parts: list) -> list:
        word, cls, n = (np.concatenate(x) for x in zip(*parts))
        word, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        return [(word, cls[first], np.bincount(inverse, n, len(word)).astype(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, data, offsets in texts(batch.column(0)):
                words = Words(data, offsets, lower=True)
                if len(words.starts):
                    parts += merged([(words.hashes(0, key).view(np.int64), word_classes(words, classes), np.ones(len(words.starts), np.int64))])
                    held += len(parts[-1][0])
                if held > HELD:
                    parts = merged(parts)
                    if (held := len(parts[0][0])) > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["word", "class", "n"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)[0]], ["word", "class", "n"])

    counted = docs.select("text").mapInArrow(run, "word long, class long, n long")
    return counted.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Vocabulary:
    """What tasks need to know of the words: tables whose size is fixed by parameters."""

    def __init__(self, top: pa.Table, n_docs: int, n_types: int, n_tokens: int, class_sums: dict[int, int], frequent: int, classes: int):
        word, n, cls = (top.column(c).to_numpy() for c in ("word", "n", "class"))
        rank = np.lexsort((word, -n))
        own = np.full(len(word), -1, np.int64)
        own[rank[:frequent]] = np.arange(min(frequent, len(word)))
        order = np.argsort(word)
        self.word, self.n, self.own = word[order], n[order], own[order]
        self.frequent, self.classes = min(frequent, len(word)), classes
        self.end, self.n_docs = self.frequent + classes, n_docs
        #: Training tokens and distinct ones, the end included.
        self.tokens, self.types = n_tokens + n_docs, n_types + (n_docs > 0)
        total = np.ones(classes)
        for c, s in class_sums.items():
            total[c] += s
        for w in np.flatnonzero(self.own >= 0):
            total[cls[order][w]] -= self.n[w] + 1
        self.class_log = np.log10(total)

    @property
    def symbols(self) -> int:
        return self.frequent + self.classes + 1


def encoded(docs: DataFrame, vocabulary: Vocabulary, key: int = 0) -> DataFrame:
    """(id, held_out, n_tokens, symbols, n_known, count_log, word_log, unlisted) from (id, held_out, text).

    count_log: sum of log10(count + 1) of the tabled words and the end. word_log: sum of the
    logarithms of the tabled words' shares of their classes; the unlisted words' lack their
    counts yet. unlisted: hashes of the words that are not tabled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["id", "held_out", "n_tokens", "symbols", "n_known", "count_log", "word_log", "unlisted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        count_log = np.log10(v.n + 1.0)
        for batch in batches:
            for rows, data, offsets in texts(batch.column(2)):
                words = Words(data, offsets, lower=True)
                n = len(offsets) - 1
                word = words.hashes(0, key).view(np.int64)
                at = np.minimum(np.searchsorted(v.word, word), max(0, len(v.word) - 1))
                tabled = v.word[at] == word if len(v.word) else np.zeros(len(word), bool)
                own = np.where(tabled, v.own[at], -1) if len(v.word) else np.full(len(word), -1)
                cls = word_classes(words, v.classes)
                symbol = np.where(own >= 0, own, v.frequent + cls)
                gain = np.where(tabled, count_log[at], 0.0) if len(v.word) else np.zeros(len(word))
                share = np.where(own >= 0, 0.0, gain - v.class_log[cls])
                with_end = np.insert(symbol, words.first[1:], v.end).astype("<u2" if v.symbols <= 1 << 16 else "<u4")
                width = with_end.itemsize
                ends = (words.first + np.arange(n + 1)) * width
                raw = with_end.tobytes()
                missing = ~tabled
                cuts = np.concatenate([[0], np.cumsum(np.bincount(words.doc[missing], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[rows], batch.column(1)[rows], pa.array(words.counts + 1), pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                    pa.array((np.bincount(words.doc, tabled, n) + (v.n_docs > 0)).astype(np.int64)), pa.array(np.bincount(words.doc, gain, n) + np.log10(v.n_docs + 1.0)), pa.array(np.bincount(words.doc, share, n).astype(float)),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(word[missing])),
                ], names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, symbols binary, n_known long, count_log double, word_log double, unlisted array<long>")


class Model:
    """start (K), move (K, K) and emit (symbols, K): rows of move and columns of emit sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def packed(self, sequences: list[np.ndarray]) -> tuple:
        """Sequences, the longest first, laid out by position: all first symbols, all second ones, and so on."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
        begins = np.concatenate([[0], np.cumsum(active)])
        rank = np.repeat(np.arange(len(lengths)), lengths)
        position = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = begins[position] + rank
        symbol, who = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        symbol[place] = np.concatenate([sequences[i] for i in order])
        who[place] = rank
        return order, active, begins, symbol, who

    def forward(self, active: np.ndarray, begins: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and their scales, whose logarithms sum to a sequence's log-likelihood."""
        alpha = self.emit[symbol]
        scale = np.empty(len(symbol), alpha.dtype)
        for t, n in enumerate(active):
            now = alpha[begins[t] : begins[t] + n]
            now *= self.start if t == 0 else alpha[begins[t - 1] : begins[t - 1] + n] @ self.move
            total = now.sum(1)
            now /= total[:, None]
            scale[begins[t] : begins[t] + n] = total
        return alpha, scale

    def log_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        order, active, begins, symbol, who = self.packed(sequences)
        _, scale = self.forward(active, begins, symbol)
        out = np.empty(len(sequences))
        out[order] = np.bincount(who, np.log10(scale.astype(float)), len(sequences))
        return out

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch: expected starts, moves and emissions of the sequences."""
        _, active, begins, symbol, _ = self.packed(sequences)
        alpha, scale = self.forward(active, begins, symbol)
        move = np.zeros(self.move.shape)
        back = self.move.T.copy()
        beta = np.ones((active[0], len(self.start)), alpha.dtype)
        for t in range(len(active) - 1, -1, -1):
            now = alpha[begins[t] : begins[t] + active[t]]
            if t + 1 < len(active) and active[t + 1]:
                n, at = active[t + 1], begins[t + 1]
                ahead = self.emit[symbol[at : at + n]] * beta[:n] / scale[at : at + n, None]
                move += now[:n].T @ ahead
                beta[:n] = ahead @ back
            if t + 1 < len(active):
                # alpha of the next position has served its purpose: it becomes the posterior there
                alpha[begins[t + 1] : begins[t + 1] + active[t + 1]] *= later
            later = beta[: active[t]].copy()
        alpha[: active[0]] *= later
        emit = np.stack([np.bincount(symbol, alpha[:, k], len(self.emit)) for k in range(len(self.start))], 1)
        return alpha[: active[0]].sum(0, dtype=float), move * self.move, emit


def _sequences(column: pa.Array, kind: str) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """(rows, symbol sequences) of about BATCH symbols; no row is cut."""
    out, size, at = [], 0, 0
    for i, raw in enumerate(column):
        out.append(np.frombuffer(raw.as_buffer(), kind))
        size += len(out[-1])
        if size >= BATCH:
            yield slice(at, i + 1), out
            out, size, at = [], 0, i + 1
    if out:
        yield slice(at, len(column)), out


def _noise(symbols: int, states: int) -> np.ndarray:
    """Fixed numbers in [0, 1) for each symbol and state."""
    return (mixed(np.arange(symbols * states, dtype=np.uint64)) >> np.uint64(40)).astype(float).reshape(-1, states) / (1 << 24)


def grouped_counts(sequences: list[np.ndarray], gains: np.ndarray) -> np.ndarray:
    """Symbol counts (symbols, K) of whole texts, each counted in the group whose gains sum to most over its symbols."""
    lengths = np.array([len(x) for x in sequences])
    symbol = np.concatenate(sequences).astype(np.int64)
    group = np.add.reduceat(gains[symbol], np.cumsum(lengths) - lengths, axis=0).argmax(1)
    size, states = gains.shape
    return np.bincount(symbol * states + np.repeat(group, lengths), minlength=size * states).reshape(size, states)


def first_model(grouped, unigram: np.ndarray, states: int) -> Model:
    """States that start from groups of all distinct training texts, each mixed with the unigram; moves start rare.

    ``grouped(gains)`` sums ``grouped_counts`` over these texts. They are first dealt by fixed
    projections of their symbol counts, less those of the unigram, and then regrouped by the
    group under which a text is likeliest.
    """
    noise = _noise(len(unigram), states)
    gains = noise - unigram @ noise
    for k in range(REGROUPINGS + 1):
        counts = grouped(gains) + SMOOTHING * unigram[:, None]
        groups = counts / counts.sum(0)
        gains = np.log(groups)
    emit = (0.5 * groups + 0.5 * unigram[:, None]) * (1 + 0.01 * noise)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def train(coded: DataFrame, vocabulary: Vocabulary, states: int = STATES, passes: int = PASSES, smoothing: float = SMOOTHING) -> Model:
    """Baum-Welch over every training text; Spark sums the expected counts symbol by symbol.

    Texts are trained on whole, so that starts are counted at their starts only. Copies count
    once in the first states and each in training. Without training text the model is uniform.
    """
    spark, size = coded.sparkSession, vocabulary.symbols
    kind = "<u2" if size <= 1 << 16 else "<u4"
    learn = coded.filter("not held_out").select("symbols")
    distinct = written(learn.groupBy(F.xxhash64("symbols").alias("h"), F.length("symbols").alias("n")).agg(F.first("symbols").alias("symbols")).select("symbols"), "distinct-texts")
    columns = [f"c{k}" for k in range(states)]

    def counts(model: Model | np.ndarray | None, over: DataFrame = learn) -> dict[int, np.ndarray]:
        shared = spark.sparkContext.broadcast(model.astype("f4") if isinstance(model, np.ndarray) else model and Model(model.start.astype("f4"), model.move.astype("f4"), model.emit.astype("f4")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            emit, rest = np.zeros((size, states)), np.zeros((states + 1, states))
            for batch in batches:
                for _, found in _sequences(batch.column(0), kind):
                    if m is None:
                        emit[:, 0] += np.bincount(np.concatenate(found), minlength=size)
                        continue
                    if isinstance(m, np.ndarray):
                        emit += grouped_counts(found, m)
                        continue
                    start, move, own = m.expected(found)
                    emit += own
                    rest[0] += start
                    rest[1:] += move
            used = np.flatnonzero(emit.any(1))
            key = np.concatenate([used, -1 - np.arange(states + 1)])
            values = np.concatenate([emit[used], rest])
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(values[:, k]) for k in range(states)]], ["key", *columns])

        summed = over.mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in columns)).groupBy("key").agg(*[F.sum(c).alias(c) for c in columns])
        got = summed.toArrow()  # one row for each symbol and state: fixed by parameters
        shared.unpersist()
        values = np.stack([got.column(c).to_numpy() for c in columns], 1) if len(got) else np.zeros((0, states))
        return dict(zip(got.column("key").to_pylist(), values))

    seen = counts(None)
    unigram = np.ones(size)
    for key, row in seen.items():
        if key >= 0:
            unigram[key] += row[0]
    unigram /= unigram.sum()

    def grouped(gains: np.ndarray) -> np.ndarray:
        emit = np.zeros((size, states))
        for key, row in counts(gains, distinct).items():
            if key >= 0:
                emit[key] = row
        return emit

    model = first_model(grouped, unigram, states)
    for _ in range(passes):
        emit, rest = np.zeros((size, states)), np.zeros((states + 1, states))
        for key, row in counts(model).items():
            if key >= 0:
                emit[key] = row
            else:
                rest[-1 - key] = row
        emit += smoothing * unigram[:, None]
        start, move = rest[0] + 1.0, rest[1:] + 1.0 / states
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def hmm_scores(docs: DataFrame, states: int = STATES, passes: int = PASSES, frequent: int = FREQUENT, tabled: int = TABLED, classes: int = CLASSES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (id, held_out, text).

    A null or empty text is an end alone, and a null held_out counts as false. Repeated rows
    each count in training and each get a row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    key = corpus_key(docs)
    counts = written(count_words(docs.filter("not held_out"), classes, key), "word-counts")
    n_docs = docs.filter("not held_out").count()
    sums = counts.groupBy("class").agg(F.sum(F.col("n") + 1).alias("s"), F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # one row for each class
    # The words of as many of the highest count ranges as the table has room for: no task sorts candidates of all others.
    counts = counts.withColumn("range", F.floor(F.log2("n") * 64))
    room, least = tabled, 1 << 30
    for r in sorted(counts.groupBy("range").count().collect(), reverse=True):  # some thousand ranges at most
        if (room := room - r["count"]) < 0:
            break
        least = r["range"]
    top = counts.filter(F.col("range") >= least).select("word", "n", "class").toArrow()
    vocabulary = Vocabulary(top, n_docs, sum(r["types"] for r in sums), sum(r["n"] for r in sums), {r["class"]: r["s"] for r in sums}, frequent, classes)
    coded = written(encoded(docs, vocabulary, key).withColumn("row", F.monotonically_increasing_id()), "coded-texts")
    model = train(coded, vocabulary, states, passes)
    shared = spark.sparkContext.broadcast(model)
    kind = "<u2" if vocabulary.symbols <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _sequences(batch.column(1), kind):
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(shared.value.log_likelihoods(found))], ["row", "symbol_log"])

    likely = coded.select("row", "symbols").mapInArrow(run, "row long, symbol_log double")
    rare = (
        coded.select("row", F.explode("unlisted").alias("word"))
        .join(counts.select("word", "n"), "word")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count("*").alias("rare_known"))
    )
    zero = F.lit(0.0)
    whole = coded.drop("symbols", "unlisted").join(likely, "row").join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", zero)
    total = F.lit(float(np.log10(vocabulary.tokens + vocabulary.types + 1)))
    return whole.select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"),
        (F.col("count_log") + rare_log - F.col("n_tokens") * total).alias("base_score"), (F.col("symbol_log") + F.col("word_log") + rare_log).alias("score"),
    )


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return hmm_scores(docs.select(F.col("doc_id").alias("id"), held_out.alias("held_out"), "text")).withColumnRenamed("id", "doc_id")
