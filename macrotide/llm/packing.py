"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import random
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import table, written
from macrotide.llm.text import drawn_key, span_hashes, texts

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Pieces of a shard (a problem of its own), islands of a shard, epochs between migrations, and an island's population, elite and crossovers in an epoch.
SHARD, ISLANDS, EPOCHS, POPULATION, ELITE, CROSSOVERS = 2048, 2, 2, 5, 2, 8
#: Tasks that islands are dealt to at most; each holds an island or some of them.
TASKS = 4096
#: Bins filled to less than this share are unpacked and packed again across shards.
LOOSE = 0.97
#: Words whose ids a task remembers.
REMEMBERED = 1_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of whole texts by a tokenizer that never joins words across white space.

    Runs of ASCII signs after an ASCII letter or digit and before another or space are words of
    their own, as they are to the tokenizer. Words are told apart by 128 bits of hashes. New ones
    are encoded some dozens at a time: a word's ids end with its last pretoken's, whose last id is
    that of a token at a word's end. Up to REMEMBERED words are remembered, those used last.
    """

    PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
    TOGETHER = 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have a core each
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pretokens = regex.compile(self.PRETOKENS)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.kind = np.full(256, 3, np.int8)  # 0 white space, 1 ASCII letters and digits, 2 signs, 3 others
        self.kind[[32, *range(9, 14)]] = 0
        self.kind[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
        self.kind[list(self.SIGNS.encode())] = 2
        self.calls = 0
        self._forget()

    def _forget(self) -> None:
        """No word is known any more, and hashes have another key."""
        self.key = drawn_key()
        #: In order of hash: the words' two hashes, where their ids are, how many, and when they were last used.
        self.words = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.ids = np.zeros(0, "<u4")

    def _count(self, word: str) -> int:
        """Pretokens of a word; what is guessed without the pattern is never too many, so that a group's sum shows any that are too few."""
        if word.isalpha():
            return 1
        stem = word.rstrip(self.SIGNS)
        if not stem or stem.isalpha():
            return 1 + bool(stem)
        return len(self.pretokens.findall(unicodedata.normalize("NFC", word).lower()))

    def _encoded(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode() for w in words]
        groups = [texts[i : i + self.TOGETHER] for i in range(0, len(texts), self.TOGETHER)]
        out: list[np.ndarray] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            after = np.cumsum([self._count(w) for w in group])
            if len(stops) == after[-1] and (not len(stops) or stops[-1] == len(ids)) and not self.special.search(" ".join(group)):
                at = np.concatenate([[0], stops])[after].tolist()
                out += [ids[x:y] for x, y in zip([0, *at[:-1]], at)]
            else:
                out += [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts, which lie beside each other in data."""
        kind = self.kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, stops = kind > 0, kind > 0
        begins[1:] &= (kind[:-1] == 0) | edge[1:-1]
        stops[:-1] &= (kind[1:] == 0) | edge[1:-1]
        change = edge.copy()
        change[1:-1] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(change)
        low, high = runs[:-1], runs[1:]
        own = kind[low] == 2
        low, high = low[own], high[own]
        before = ~edge[low] & (kind[np.maximum(low - 1, 0)] == 1)
        inside = ~edge[high]
        after = kind[np.minimum(high, len(data) - 1)]
        apart = before & (~inside | (after <= 1))
        begins[low[apart]] = True
        stops[low[apart] - 1] = True
        apart &= inside & (after == 1)
        begins[high[apart]] = True
        stops[high[apart] - 1] = True
        return np.flatnonzero(begins), np.flatnonzero(stops) + 1

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word among those remembered, after new ones have been encoded."""
        hashes, checks = span_hashes(data, starts, ends, 0, self.key), span_hashes(data, starts, ends, 1, self.key)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        check = checks[first]
        known = self.words[0]
        at = np.minimum(np.searchsorted(known, unique), max(0, len(known) - 1))
        held = known[at] == unique if len(known) else np.zeros(len(unique), bool)
        if (check[inverse] != checks).any() or (held.any() and (self.words[1][at[held]] != check[held]).any()):
            self._forget()  # different words with equal hashes: all are told apart by another key
            return self._places(data, starts, ends)
        new = np.flatnonzero(~held)
        found = self._encoded([data[a:b].tobytes() for a, b in zip(starts[first[new]], ends[first[new]])])
        size = np.array([len(x) for x in found], np.int64)
        own = [unique[new], check[new], len(self.ids) + np.cumsum(size) - size, size, np.full(len(new), self.calls)]
        self.words[4][at[held]] = self.calls
        if len(known) + len(new) > REMEMBERED:  # the half that was used last stays
            used = self.words[4]
            kept = used >= np.partition(used, len(used) // 2)[len(used) // 2] if len(used) else held
            kept |= used == self.calls
            self.words = [x[kept] for x in self.words]
        self.words = [np.concatenate([x, y]) for x, y in zip(self.words, own)]
        order = np.argsort(self.words[0], kind="stable")
        self.words = [x[order] for x in self.words]
        self.ids = np.concatenate([self.ids, *found])
        if len(self.ids) > 2 * self.words[3].sum() + (1 << 20):
            self.ids = self.ids[self._spread(np.arange(len(self.words[0])))]
            self.words[2] = np.cumsum(self.words[3]) - self.words[3]
        return np.searchsorted(self.words[0], unique)[inverse]

    def _spread(self, places: np.ndarray) -> np.ndarray:
        """Where the ids of the words at these places are, one after another."""
        size = self.words[3][places]
        return np.repeat(self.words[2][places] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids, as little-endian 32-bit numbers, of texts data[offsets[i]:offsets[i + 1]]."""
        self.calls += 1
        if self.special.search(data.tobytes().decode()):
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        starts, ends = self._cut(data, offsets)
        if not len(starts):
            return [b""] * (len(offsets) - 1)
        places = self._places(data, starts, ends)
        raw = self.ids[self._spread(places)].tobytes()
        after = 4 * np.concatenate([[0], np.cumsum(self.words[3][places])])[np.searchsorted(starts, offsets)]
        return [raw[a:b] for a, b in zip(after[:-1].tolist(), after[1:].tolist())]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and an end id, cut only if longer than ``capacity``.

    A null or empty text is the end id alone. Repeated rows each give their pieces.
    """
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in batches:
            for part, data, offsets in texts(batch.column(1)):
                rows, own = [], []
                for i, ids in enumerate(encode(data, offsets)):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        own.append(i)
                        rows.append((k, start // 4, len(cut) // 4, zlib.crc32(cut), cut))
                columns = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + keep_ids]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part].take(pa.array(own)), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names)

    chosen = docs.select(F.col(id_col), F.col(text_col))
    return chosen.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def fills(bins: list[list[int]], sizes: list[int]) -> list[int]:
    return [sum(map(sizes.__getitem__, b)) for b in bins]


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put each item into the fullest bin that still holds it, else into a new one."""
    bins = [] if bins is None else bins
    free = sorted((capacity - x, k) for k, x in enumerate(fills(bins, sizes)))
    for i in order:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, k = free.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        insort(free, (room - sizes[i], k))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins of uneven fill, which leave room that can be used."""
    return -len(bins), sum(x * x for x in fills(bins, sizes)) / capacity**2


def crossover(taker: list[list[int]], giver: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Whole well-filled bins of ``giver`` enter; bins of ``taker`` with any of their items go, and what they lose is best-fitted."""
    filled = [b for _, b in sorted(zip(fills(giver, sizes), giver), key=lambda x: -x[0])]
    pool = filled[: max(1, len(filled) // 2)]
    injected = rng.sample(pool, max(1, len(pool) // 2))
    there = set().union(*injected)
    kept, displaced = [], []
    for b in taker:
        if there.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in there]
    fill = fills(kept, sizes)
    loosest = sorted(range(len(kept)), key=fill.__getitem__)[:2]
    displaced += [i for k in loosest for i in kept[k]]
    kept = [list(b) for k, b in enumerate(kept) if k not in loosest]
    return best_fit(sorted(displaced, key=sizes.__getitem__, reverse=True), sizes, capacity, [list(b) for b in injected] + kept)


def decreasing(sizes: list[int]) -> list[int]:
    return sorted(range(len(sizes)), key=lambda i: -sizes[i])


def evolve(sizes: list[int], elite: list[list[int]], capacity: int, seed: int, population: int = POPULATION, crossovers: int = CROSSOVERS, keep: int = ELITE, heuristic: bool = False) -> tuple[list[list[int]], int]:
    """An epoch on one island: (solutions, crossovers that beat what they replaced).

    Solutions go in and out as the bin number of each item, the best first. An island starts
    from random-order groupings, one of them, if ``heuristic``, best-fit decreasing; every epoch
    runs all its crossovers. Parents are chosen among the fitter half twice as often; a child
    takes the place of the worst.
    """
    rng = random.Random(seed)
    solutions = []
    for assigned in elite:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(assigned):
            bins.setdefault(b, []).append(i)
        solutions.append(list(bins.values()))
    if heuristic and not elite:
        solutions.append(best_fit(decreasing(sizes), sizes, capacity))
    while len(solutions) < population:
        solutions.append(best_fit(rng.sample(range(len(sizes)), len(sizes)), sizes, capacity))
    scored = sorted(((fitness(b, sizes, capacity), b) for b in solutions), key=lambda x: x[0], reverse=True)
    better = 0
    for _ in range(crossovers if population > 1 else 0):
        half = -(-len(scored) // 2)
        taker = rng.randrange(half) if rng.random() < 0.5 else rng.randrange(len(scored))
        giver = (taker + rng.randrange(1, len(scored))) % len(scored)
        child = crossover(scored[taker][1], scored[giver][1], sizes, capacity, rng)
        found = fitness(child, sizes, capacity), child
        better += found[0] > scored[-1][0]
        scored[-1] = found
        scored.sort(key=lambda x: x[0], reverse=True)
    out = []
    for _, bins in scored[:keep]:
        assigned = [0] * len(sizes)
        for b, items in enumerate(bins):
            for i in items:
                assigned[i] = b
        out.append(assigned)
    return out, better


def _sharded(items: DataFrame, shard_size: int) -> tuple[DataFrame, int]:
    """((shard, items), shards): arrays of about ``shard_size`` pieces, dealt by a hash of their columns and their place, as rows may repeat."""
    shards = max(1, -(-items.count() // shard_size))
    shard = F.pmod(F.xxhash64(*items.columns, F.monotonically_increasing_id()), F.lit(shards))
    return items.withColumn("shard", shard).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(*items.columns))).alias("items")), shards


def evolved_shards(items: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(shard, items, bins, found, crossovers, better) with the best bins that any of the shard's islands found.

    ``found`` is their number; ``crossovers`` were made on all islands of the shard, and
    ``better`` of them beat what they replaced. Islands are dealt
    to tasks of their own, and their elites migrate by a join.
    """
    sharded, shards = _sharded(items, shard_size)
    shards_at = written(sharded, "packing-shards")
    tasks = min(TASKS, shards * islands)
    start = shards_at.select("shard", F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("elite"), F.lit(0).alias("better"))
    state = start
    for epoch in range(epochs):

        def run(frames: Iterator[pd.DataFrame], epoch=epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    sizes = [int(x) for x in row.sizes]
                    elite = [[int(b) for b in x] for x in row.elite]
                    out, better = evolve(sizes, elite, capacity, hash((int(row.shard), int(row.island), epoch)), heuristic=int(row.island) == 0)
                    yield pd.DataFrame({"shard": [row.shard], "sizes": [sizes], "island": [row.island], "elite": [out], "better": [row.better + better]})

        dealt = state.repartition(tasks, F.col("shard"), F.col("island"))
        state = written(dealt.mapInPandas(run, "shard long, sizes array<long>, island int, elite array<array<int>>, better int"), "packing-islands")
        if epoch < epochs - 1:  # the next island's best solution comes in first place
            guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elite", 1, 1).alias("guest"))
            state = state.join(guests, ["shard", "island"]).withColumn("elite", F.array_distinct(F.concat("guest", "elite"))).select("shard", "sizes", "island", "elite", "better")
    own = F.struct(F.array_max(F.col("elite")[0]).alias("most"), "island", F.col("elite")[0].alias("bins"))
    best = state.select("shard", own.alias("own"), "better").groupBy("shard").agg(F.min("own").alias("own"), F.sum("better").alias("better"))
    made = F.lit(epochs * islands * CROSSOVERS)
    return shards_at.join(best, "shard").select("shard", "items", F.col("own.bins").alias("bins"), (F.col("own.most") + 1).alias("found"), made.alias("crossovers"), "better")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The columns of ``items``, which has a ``length`` of at most ``capacity``, with sequence_id and offset.

    Shards of about ``shard_size`` pieces are problems of their own. Then the pieces of all
    loosely filled bins are dealt to new shards and packed once more, so that shards leave few
    open bins. Repeated rows are packed each for itself; an empty table gives no rows.
    """
    names, kept = items.columns, []
    for last in (False, True):
        packed = evolved_shards(items, capacity, shard_size, islands, epochs)
        rows = packed.select("shard", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("shard", F.col("x.bins").alias("bin"), F.col("x.items").alias("item"))
        bins = rows.groupBy("shard", "bin").agg(F.array_sort(F.collect_list("item")).alias("members"), F.sum("item.length").alias("fill"))
        bins = written(bins.withColumn("sequence_id", F.col("shard") * (1 << 24) + F.col("bin") * 2 + int(last)), "packing-bins")
        kept.append(bins if last else bins.filter(F.col("fill") >= LOOSE * capacity))
        items = bins.filter(F.col("fill") < LOOSE * capacity).select(F.explode("members").alias("m")).select("m.*")
    whole = kept[0].unionByName(kept[1])
    before = "aggregate(slice(members, 1, pos), 0L, (a, m) -> a + m.length)"
    return whole.selectExpr("sequence_id", "members", "posexplode(members) as (pos, m)").withColumn("offset", F.expr(before)).select(*[F.col(f"m.{c}") for c in names], "sequence_id", "offset")


def op10_ga_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; nulls, long texts and repeated rows as in ``pieces`` and ``pack``."""
    items = written(pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
