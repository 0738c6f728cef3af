"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import table, written
from macrotide.llm.text import _LOWER, _SPACE, span_hashes, texts

#: Hashed weights; rated rows used for fitting at most; gradients taken, and L2 penalty of the fit.
DIMENSIONS, MAX_TRAIN, STEPS, PENALTY = 1 << 17, 40_000, 45, 2e-5
#: Bytes of a word's stem, and correction pairs that L-BFGS keeps.
STEM, PAIRS = 4, 10
#: A document is selected if P(grade >= SELECT_GRADE) is at least SELECT_AT.
SELECT_GRADE, SELECT_AT = 2, 0.5

_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def hashed_features(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of texts: runs of letters and digits, their stems, and runs of signs, each hashed.

    A token's value is 1, and 1 more for each doubling of its count in the text up to 3; the
    share of words that repeat the word before them is a feature of its own.
    """
    kind = np.where(_SPACE[data], 0, np.where(_WORDY[data], 1, 2)).astype(np.int8)
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    held = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[held], ends[held]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    lower = _LOWER[data]
    hashed = span_hashes(lower, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    same = np.zeros(len(starts), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
    long = ends - starts > STEM
    stems = span_hashes(lower, starts[long], starts[long] + STEM, 1)
    key = np.concatenate([row, row[long]]) * dimensions + (np.concatenate([hashed, stems]) % np.uint64(dimensions)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    value = np.minimum(1 + np.log2(count), 3).astype(np.float32)
    n = len(offsets) - 1
    share = np.bincount(row, same, n) / np.maximum(1, np.bincount(row, minlength=n))
    rows = np.flatnonzero(share > 0)
    key = np.concatenate([key, rows * dimensions + int(_REPEAT % np.uint64(dimensions))])
    value = np.concatenate([value, 3 * share[rows].astype(np.float32)])
    return key // dimensions, key % dimensions, value


def tails(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1.. from scores and ordered thresholds."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -30, 30)))


def _length_scale(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(1, np.bincount(row, value.astype(float) ** 2, n))) ** 0.5


def gradient(row, index, value, grade, weights, thresholds) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the negative log-likelihood of some rated rows: of the weights, of the thresholds, and the value."""
    n = len(grade)
    score = np.bincount(row, weights[index] * value, n)
    above = np.hstack([np.ones((n, 1)), tails(score, thresholds), np.zeros((n, 1))])
    i = np.arange(n)
    p = np.maximum(above[i, grade] - above[i, grade + 1], 1e-9)
    slope = above * (1 - above)
    by_score = -(slope[i, grade] - slope[i, grade + 1]) / p
    by_threshold = np.zeros(len(thresholds) + 2)
    np.add.at(by_threshold, grade, slope[i, grade] / p)
    np.add.at(by_threshold, grade + 1, -slope[i, grade + 1] / p)
    return np.bincount(index, by_score[row] * value, len(weights)), by_threshold[1:-1], float(-np.log(p).sum())


class OrdinalModel:
    """Shared weights (with the features' scales) and ordered thresholds; grades 0 .. len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, index, value = hashed_features(data, offsets, len(self.weights))
        n = len(offsets) - 1
        value = value * _length_scale(row, value, n)[row]
        return np.bincount(row, self.weights[index] * value, n).astype(float)  # of no rows at all, numpy counts in integers


def lbfgs(value_and_gradient: Callable, x: np.ndarray, evaluations: int, pairs: int = PAIRS) -> np.ndarray:
    """Minimize within a number of evaluations; each step is halved until it gains enough."""
    fx, g = value_and_gradient(x)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < evaluations and np.abs(g).max() > 1e-7:
        q, kept = g.copy(), []
        for s, y in reversed(history):
            kept.append((s @ q) / (s @ y))
            q -= kept[-1] * y
        q *= (history[-1][0] @ history[-1][1]) / (history[-1][1] @ history[-1][1]) if history else 1 / np.abs(g).sum()
        for (s, y), a in zip(history, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        while True:
            fn, gn = value_and_gradient(x - step * q)
            used += 1
            if fn <= fx - 1e-4 * step * (g @ q) or step < 1e-3 or used >= evaluations:
                break
            step /= 2
        if fn > fx:
            break
        s, y = -step * q, gn - g
        x, fx, g = x - step * q, fn, gn
        if s @ y > 1e-12:
            history = [*history, (s, y)][-pairs:]
    return x


def fit(rated: DataFrame, grades: int = 3, dimensions: int = DIMENSIONS, max_train: int = MAX_TRAIN, steps: int = STEPS, penalty: float = PENALTY) -> OrdinalModel:
    """Fit to (text, grade), grade in 0 .. grades - 1; Spark sums value and gradient over partitions.

    At most about ``max_train`` rows are used, chosen by a hash of the text. Rows without a grade
    are left out; a null text is empty. Without rated rows, every weight is 0 and all grades are
    as likely. The driver holds vectors of ``dimensions`` only.
    """
    spark = rated.sparkSession
    prior = np.ones(grades)
    rated = rated.filter(F.col("grade").between(0, grades - 1)).select(F.coalesce("text", F.lit("")).alias("text"), F.col("grade").cast("int").alias("grade"))
    for grade, n in rated.groupBy("grade").count().collect():  # one row for each grade
        prior[grade] += n
    total = prior.sum() - grades
    first = np.array([-np.log(prior[k:].sum() / prior[:k].sum()) for k in range(1, grades)])
    if not total:
        return OrdinalModel(np.zeros(dimensions), first)
    share = min(1.0, max_train / total)
    if share < 1:
        rated = rated.filter(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, data, offsets in texts(batch.column(0)):
                row, index, value = hashed_features(data, offsets, dimensions)
                value = value * _length_scale(row, value, len(offsets) - 1)[row]
                columns = [x.tobytes() for x in (grade[rows].astype("<i4"), row.astype("<u2" if len(grade[rows]) < 65536 else "<u4"), index.astype("<i4"), value.astype("<f2"))]
                yield pa.RecordBatch.from_arrays([pa.array([len(offsets) - 1], pa.int32()), *[pa.array([x], pa.binary()) for x in columns]], ["n", "grade", "row", "index", "value"])

    encoded = written(rated.mapInArrow(encode, "n int, grade binary, row binary, index binary, value binary"), "rated-features").coalesce(16)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for n, grade, row, index, value in zip(*[c.to_pylist() for c in batch.columns]):
                yield np.frombuffer(row, "<u2" if n < 65536 else "<u4").astype(np.int64), np.frombuffer(index, "<i4"), np.frombuffer(value, "<f2").astype(np.float32), np.frombuffer(grade, "<i4")

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(dimensions)
        for _, index, _, _ in blocks(batches):
            counts += np.bincount(index, minlength=dimensions)
        yield pa.RecordBatch.from_arrays([pa.array([counts.astype("<f4").tobytes()])], ["counts"])

    used = encoded.agg(F.sum("n")).first()[0] or 1
    # Here and below each task returns one row of a fixed size.
    counts = sum(np.frombuffer(r[0], "<f4").astype(float) for r in encoded.mapInArrow(document_counts, "counts binary").collect())
    scale = np.sqrt(np.log((used + 1) / (counts + 1)).clip(0.01))

    def thresholds_of(x: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([x[dimensions : dimensions + 1], np.exp(x[dimensions + 1 :])]))

    def value_and_gradient(x: np.ndarray) -> tuple[float, np.ndarray]:
        thresholds = thresholds_of(x)
        shared = spark.sparkContext.broadcast(((x[:dimensions] * scale).astype("<f4"), thresholds))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, t = shared.value
            by_weight, by_threshold, loss = np.zeros(dimensions), np.zeros(len(t)), 0.0
            for row, index, value, grade in blocks(batches):
                gw, gt, own = gradient(row, index, value, grade, w, t)
                by_weight, by_threshold, loss = by_weight + gw, by_threshold + gt, loss + own
            yield pa.RecordBatch.from_arrays([pa.array([by_weight.astype("<f4").tobytes()]), pa.array([by_threshold.tobytes()]), pa.array([loss])], ["w", "t", "loss"])

        sums = encoded.mapInArrow(partial, "w binary, t binary, loss double").collect()
        shared.unpersist()
        by_weight = scale * sum(np.frombuffer(r[0], "<f4").astype(float) for r in sums) / used + penalty * x[:dimensions]
        by_threshold = sum(np.frombuffer(r[1]) for r in sums) / used
        rest = np.array([by_threshold[k:].sum() for k in range(len(by_threshold))])
        rest[1:] *= np.exp(x[dimensions + 1 :])
        return sum(r[2] for r in sums) / used + penalty / 2 * float(x[:dimensions] @ x[:dimensions]), np.concatenate([by_weight, rest])

    start = np.concatenate([np.zeros(dimensions), first[:1], np.log(np.diff(first).clip(1e-3))])
    x = lbfgs(value_and_gradient, start, steps)
    return OrdinalModel(x[:dimensions] * scale, thresholds_of(x))


def judge(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", at_grade: int = SELECT_GRADE, at: float = SELECT_AT) -> DataFrame:
    """(id, score, expected_grade, tail_probability, selected) for every row; a null text is empty.

    tail_probability is P(grade >= at_grade); a tie with ``at`` is selected. Rows that repeat are
    judged alike, very long texts whole; other columns play no part, and an empty table gives no
    rows. The model sent to the tasks has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype("<f4"), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*shared.value)
        for batch in batches:
            for rows, data, offsets in texts(batch.column(1)):
                score = model.score(data, offsets)
                p = tails(score, model.thresholds)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(score), pa.array(p.sum(1)), pa.array(p[:, at_grade - 1]), pa.array(p[:, at_grade - 1] >= at)], ["id", "score", "expected_grade", "tail_probability", "selected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, expected_grade double, tail_probability double, selected boolean")


def select_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", at_grade: int = SELECT_GRADE, at: float = SELECT_AT) -> DataFrame:
    """The rows of ``docs`` whose P(grade >= at_grade) is at least ``at``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype("<f4"), model.thresholds))
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*shared.value)
        for batch in batches:
            for rows, data, offsets in texts(batch.column(column)):
                kept = tails(model.score(data, offsets), model.thresholds)[:, at_grade - 1] >= at
                yield batch[rows].filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def graded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, grade): 2 for quality without toxicity, 0 for toxic text without quality, else 1; of clashing labels the lowest grade."""
    grade = F.col("quality") + 1 - F.col("toxic")
    return table(spark, sf_dir, "labels").select("doc_id", grade.cast("int").alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade")).filter("grade is not null")


def fitted(spark: SparkSession, sf_dir: str, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """The model of the labelled ``documents``; of more than ``max_train`` labels about so many, chosen by a hash of the id."""
    labels = graded_labels(spark, sf_dir)
    n = labels.count()
    if n > max_train:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(max_train / n * (1 << 20)))
    rated = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # about max_train rows at most
    return fit(rated, max_train=2 * max_train)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgement of every row of ``documents`` by the model fitted on ``labels``; nulls, ties and repeats as in ``judge``."""
    return judge(table(spark, sf_dir, "documents"), fitted(spark, sf_dir)).withColumnRenamed("id", "doc_id")
