"""N-gram Jaccard join by signature trees.

Two sets of word shingles can be similar only if few shingles are in one and not in the other.
The shingles of a set are dealt by their hashes to parts, a few more of them than that
difference at most, so that similar sets agree in some whole parts: sets meet where a part of
theirs is the same. Sets that meet are the leaves of a signature tree, whose nodes hold
OR-combined bitmaps of shingles and size ranges; a traversal of pairs of nodes drops every pair
whose greatest possible overlap is too small, or whose sets are one component already. What is
left is verified on the words of both texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.graph import components
from macrotide.llm.store import discard, table, written
from macrotide.llm.text import Words, drawn_key, gram_hashes, joined, mixed, span_hashes, texts

#: Children of a tree node; sets of a group that one tree holds, beyond which it is a block beside others.
FANOUT, BLOCK = 8, 1024
#: Width of a range of set sizes, as a ratio.
RANGE = 1.3
#: Bits of a bitmap for each shingle of its set: a power of two from here on.
BITS = 8
#: Ids of up to so many rows (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Node pairs looked at in one numpy step, and those whose children are listed at once.
STEP, EXPANDED = 1 << 14, 1 << 11
_TOKEN = np.uint64((1 << 54) - 1)


def shingle_tokens(data: np.ndarray, offsets: np.ndarray, k: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, cuts): the distinct shingles of text i are tokens[cuts[i]:cuts[i + 1]], as 54-bit hashes in order.

    A text of fewer than k words is one shingle. There are fewer than 1,024 texts.
    """
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    hashes = words.hashes(0, key)
    whole = words.counts >= k
    count = np.where(whole, words.counts - k + 1, 0)
    doc = np.repeat(np.arange(n), count)
    start = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    token = gram_hashes(hashes, k)[start] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero(~whole & (words.counts > 0))
    if len(short):
        # all bytes of the text, white space made alike
        raw, cuts = words.normalized()
        token = np.concatenate([token, span_hashes(raw, cuts[short], cuts[short + 1], 1, key)])
        doc = np.concatenate([doc, short])
    held = np.sort(doc.astype(np.uint64) << np.uint64(54) | token & _TOKEN)
    if len(held):
        held = held[np.concatenate([[True], held[1:] != held[:-1]])]
    return held & _TOKEN, np.searchsorted(held >> np.uint64(54), np.arange(n + 1).astype(np.uint64))


def size_ranges(percent: int) -> np.ndarray:
    """The least set size of each range: widths grow by RANGE, or as much as similar sizes may differ if that is more."""
    ratio, out = max(RANGE, 100 / percent), [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


def part_signatures(tokens: np.ndarray, cuts: np.ndarray, percent: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The signatures of each set, and how many of even and of odd ranges any similar set shares with it (0: none are needed).

    A set is in the range of its size, and in the next one if similar sets are there. Sets of a
    range differ in at most ``apart`` shingles if they are similar; in apart + spare parts they
    then agree in ``spare`` at least. A signature is a hash of a range, a part and its shingles,
    and its lowest bit is that of the range. Parts without shingles have signatures only for
    sets with so many of them that their other parts may not do.
    """
    bounds = size_ranges(percent)
    size = np.diff(cuts)
    n = len(size)
    own = np.searchsorted(bounds, size, "right") - 1
    value = mixed(tokens)
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    need = np.zeros((n, 2), np.int64)
    for up in (0, 1):
        at = own + up
        held = (size > 0) & (bounds[np.maximum(at, 0)] * percent <= 100 * size)
        largest = bounds[np.minimum(at + 1, len(bounds) - 1)] - 1
        apart = 2 * largest * (100 - percent) // (100 + percent)
        spare = 2 + apart // 7
        parts = apart + spare
        doc = np.repeat(np.arange(n), np.where(held, size, 0))
        if not len(doc):
            continue
        chosen = np.repeat(held, size)
        part = ((tokens[chosen] >> np.uint64(22)) * parts[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = doc << 32 | part  # in order, as the tokens are
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sums = np.add.reduceat(value[chosen], heads)
        count = np.diff(np.append(heads, len(place))).astype(np.uint64)
        of, part = doc[heads], part[heads]
        where = mixed(at[of].astype(np.uint64) << np.uint64(32) | part.astype(np.uint64))
        signature = joined(where, joined(sums, count)) & ~np.uint64(1) | (at[of] & 1).astype(np.uint64)
        full = np.bincount(of, minlength=n)
        empty = parts - full
        ends = np.concatenate([[0], np.cumsum(full)])
        for i in np.flatnonzero(held):
            found[i].append(signature[ends[i] : ends[i + 1]])
            if empty[i] >= spare[i]:
                none = np.setdiff1d(np.arange(parts[i]), part[ends[i] : ends[i + 1]]).astype(np.uint64)
                found[i].append(mixed(mixed(np.uint64(at[i]) << np.uint64(32) | none)) & ~np.uint64(1) | np.uint64(at[i] & 1))
        need[np.arange(n), at & 1] = np.where(held, np.maximum(1, spare - empty), need[np.arange(n), at & 1])
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found], need


def bitmaps(tokens: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """A bitmap of each set: BITS bits for each token at least, a power of two of bits, and 64 at least."""
    size = np.diff(cuts)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(BITS * size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(base[-1], bool)
    bits[np.repeat(base[:-1], size) + (mixed(tokens) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64)] = True
    raw = np.packbits(bits, bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip(base[:-1] // 8, base[1:] // 8)]


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (n, 64-bit words) folded to fewer words."""
    return np.bitwise_or.reduce(rows.reshape(len(rows), -1, words), axis=1)


def _may_link(common, slack_a, slack_b, least_a, least_b, most_a, most_b, percent: int):
    """Whether sets of two nodes can be similar: sizes must overlap, and so must enough bits.

    A set has at most as many tokens in common with another as bits in common, and as many
    more as it has tokens beyond its bits (its slack).
    """
    overlap = common + np.minimum(slack_a, slack_b)
    return (np.maximum(least_a, least_b) * percent <= 100 * np.minimum(most_a, most_b)) & (overlap * (100 + percent) >= percent * (least_a + least_b))


class SignatureTree:
    """Levels of nodes over sets (size, bitmap, component), from the sets up to the root."""

    def __init__(self, size: np.ndarray, maps: np.ndarray, component: np.ndarray, percent: int):
        self.order = np.lexsort((size, component))
        size, maps, component = size[self.order], maps[self.order], component[self.order]
        self.percent = percent
        slack = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, slack, size, size, component, np.ones(len(size), bool))]
        while len(self.levels[-1][0]) > 1:
            maps, slack, least, most, component, one = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            low, high = np.minimum.reduceat(component, at), np.maximum.reduceat(component, at)
            bounds = np.maximum.reduceat(slack, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((np.bitwise_or.reduceat(maps, at), *bounds, low, np.logical_and.reduceat(one, at) & (low == high)))

    def _kept(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        maps, slack, least, most, component, one = self.levels[level]
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), STEP):
            a, b = i[at : at + STEP], j[at : at + STEP]
            common = np.bitwise_count(maps[a] & maps[b]).sum(1, dtype=np.int64)
            apart = ~(one[a] & one[b] & (component[a] == component[b]))
            out[at : at + STEP] = apart & _may_link(common, slack[a], slack[b], least[a], least[b], most[a], most[b], self.percent)
        return out

    def _below(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of some pairs of nodes that are kept."""
        nodes, down = len(self.levels[level - 1][0]), np.arange(FANOUT)
        i, j = (i[:, None, None] * FANOUT + down[:, None] + 0 * down).reshape(-1), (j[:, None, None] * FANOUT + 0 * down[:, None] + down).reshape(-1)
        held = (i <= j) & (j < nodes) & (i < nodes)
        i, j = i[held], j[held]
        kept = self._kept(level - 1, i, j)
        if level > 1:
            kept |= (i == j) & ~self.levels[level - 1][5][i]
        return i[kept], j[kept]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets of different components that may be similar."""
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            found = [self._below(level, i[at : at + EXPANDED], j[at : at + EXPANDED]) for at in range(0, len(i), EXPANDED)]
            i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        held = i != j
        return self.order[i[held]], self.order[j[held]]


def _small_pairs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of groups of FANOUT rows at most: trees of a single node."""
    left, right = [], []
    for m in range(2, FANOUT + 1):
        at = starts[counts == m]
        for d in range(m):
            for e in range(d + 1, m):
                left.append(at + d)
                right.append(at + e)
    return np.concatenate(left or [starts[:0]]), np.concatenate(right or [starts[:0]])


def _group_pairs(group: np.ndarray, block: np.ndarray, sid: np.ndarray, size: np.ndarray, maps: list[bytes], component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that the trees of the groups (runs of equal ``group``) let through.

    Where two blocks of a large group meet, pairs within one of them are left to the place where it is alone.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.append(starts, len(group)))
    a, b = _small_pairs(starts, counts)
    ok = (component[a] != component[b]) & (np.maximum(size[a], size[b]) * percent <= 100 * np.minimum(size[a], size[b]))
    a, b = a[ok], b[ok]
    words = np.array([len(m) // 8 for m in maps], np.int64)
    kept = np.zeros(len(a), bool)
    for wa, wb in {*zip(words[a].tolist(), words[b].tolist())}:
        at = np.flatnonzero((words[a] == wa) & (words[b] == wb))
        for part in np.array_split(at, max(1, len(at) * max(wa, wb) // (1 << 20))):
            x, y = (np.frombuffer(b"".join([maps[i] for i in rows]), np.uint64).reshape(len(part), -1) for rows in (a[part], b[part]))
            x, y = folded(x, min(wa, wb)), folded(y, min(wa, wb))
            bits = [size[rows] - np.bitwise_count(z).sum(1, dtype=np.int64) for z, rows in ((x, a[part]), (y, b[part]))]
            common = np.bitwise_count(x & y).sum(1, dtype=np.int64)
            kept[part] = _may_link(common, *bits, size[a[part]], size[b[part]], size[a[part]], size[b[part]], percent)
    left, right = [a[kept]], [b[kept]]
    for g in np.flatnonzero(counts > FANOUT):
        rows = np.arange(starts[g], starts[g] + counts[g])
        least = int(words[rows].min())
        packed = np.concatenate([folded(np.frombuffer(maps[i], np.uint64)[None], least) for i in rows])
        i, j = SignatureTree(size[rows], packed, component[rows], percent).pairs()
        if len(np.unique(block[rows])) > 1:
            across = block[rows[i]] != block[rows[j]]
            i, j = i[across], j[across]
        left.append(rows[i])
        right.append(rows[j])
    a, b = sid[np.concatenate(left)], sid[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b)


def tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate pairs from (group, block, sid, n, map, component), groups whole in a task and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            group, block, sid, n, component = (t.column(c).to_numpy() for c in ("group", "block", "sid", "n", "component"))
            a, b = _group_pairs(group, block, sid, n, t.column("map").to_pylist(), component, percent)
            both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            group = now.column("group").to_numpy()
            other = np.flatnonzero(group != group[-1]) if len(group) else group
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield work(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None and len(held):
            yield work(held)

    dealt = rows.select("group", "block", "sid", "n", "map", "component").repartition(F.col("group")).sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a long, b long").dropDuplicates()


def shingle_features(docs: DataFrame, k: int, percent: int, key: int) -> DataFrame:
    """(id, digest, n, signatures, need_even, need_odd) of every row of (id, text): digest is the whole text's SHA-256, n its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in texts(batch.column(1), 1000):
                tokens, cuts = shingle_tokens(data, offsets, k, key)
                found, need = part_signatures(tokens, cuts, percent)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                signatures = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [batch.column(0)[rows], pa.array(digests, pa.binary()), pa.array(np.diff(cuts)), signatures, pa.array(need[:, 0]), pa.array(need[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n", "signatures", "need_even", "need_odd"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, digest binary, n long, signatures array<long>, need_even long, need_odd long")


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def meetings(features: DataFrame, sets: DataFrame) -> DataFrame:
    """(signature, sid, count): where sets meet, without what no similar sets can have in common.

    A set that shares fewer signatures of a range than similar sets do has no similar one there.
    Of signatures that the same sets share, one is enough.
    """
    rows = sets.select("sid", F.explode("signatures").alias("signature"))
    shared = written(rows.groupBy("signature").count().filter("count > 1").select("signature"), "shared-signatures")
    met = written(rows.join(shared, "signature"), "shingle-meetings")
    odd = F.col("signature").bitwiseAND(1)
    have = met.groupBy("sid").agg(F.sum(1 - odd).alias("even"), F.sum(odd).alias("odd")).join(features.select(F.col("row").alias("sid"), "need_even", "need_odd"), "sid")
    enough = have.select("sid", (F.col("need_even").between(1, F.col("even"))).alias("in_even"), (F.col("need_odd").between(1, F.col("odd"))).alias("in_odd")).filter("in_even or in_odd")
    alive = met.join(enough, "sid").filter(F.when(odd == 1, F.col("in_odd")).otherwise(F.col("in_even"))).select("signature", "sid")
    alive = written(alive, "shingle-alive")
    print_of = [F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count("*").alias("count"), F.bit_xor(F.xxhash64("sid")).alias("print"), F.sum(F.shiftrightunsigned(F.xxhash64("sid", F.lit(1)), 32)).alias("sum")]
    groups = alive.groupBy("signature").agg(*print_of).filter("count > 1").groupBy("lo", "hi", "count", "print", "sum").agg(F.min("signature").alias("signature"))
    out = written(alive.join(groups.select("signature", "count"), "signature"), "shingle-groups")
    discard(shared, met, alive)
    return out


def hub_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): each set with the most central set of the largest of its groups that has another one."""
    central = groups.groupBy("sid").agg(F.sum("count").alias("central"))
    hubs = groups.join(central, "sid").groupBy("signature").agg(F.max_by("sid", F.struct("central", "sid")).alias("hub"))
    best = groups.join(hubs, "signature").filter("sid <> hub").groupBy("sid").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    return best.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).dropDuplicates()


def apart_rows(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(group, block, sid, component): members of groups that hold several components.

    A group's sets are those of its main component and others. Blocks of either kind meet blocks
    of others only, so that a large component costs no more than its rows.
    """
    rows = groups.join(roots, F.col("sid") == F.col("node"), "left").select("signature", "sid", F.coalesce("root", "sid").alias("component"))
    by_component = rows.groupBy("signature", "component").agg(F.count("*").alias("own"))
    sizes = by_component.groupBy("signature").agg(F.max(F.struct("own", "component")).alias("main"), F.sum("own").alias("count"), F.count("*").alias("components")).filter("components > 1")
    rows = rows.join(written(sizes.select("signature", F.col("main.component").alias("main"), F.col("main.own").alias("own"), "count"), "apart-groups"), "signature")
    mains, others = F.ceil(F.col("own") / BLOCK), F.ceil((F.col("count") - F.col("own")) / BLOCK)
    blocks = F.when(F.col("count") <= BLOCK, 1).otherwise(mains + others)
    in_main = F.col("component") == F.col("main")
    dealt = F.when(F.col("count") <= BLOCK, 0).when(in_main, F.pmod(F.xxhash64("sid"), mains)).otherwise(mains + F.pmod(F.xxhash64("sid"), others))
    rows = rows.withColumns({"blocks": blocks.cast("long"), "mains": mains.cast("long"), "in_main": in_main, "block": dealt.cast("long")})
    meets = F.when(F.col("blocks") == 1, F.array(F.col("block"))).when(F.col("in_main"), F.sequence(F.col("mains"), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("with", F.explode(meets))
    place = F.least("block", "with") * F.col("blocks") + F.greatest("block", "with")
    group = F.when(F.col("blocks") > 1, F.xxhash64("signature", place)).otherwise(F.col("signature"))
    return rows.select(group.alias("group"), "block", "sid", "component")


def whole_texts(docs: DataFrame, features: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, n, text) of the sets in (sid)."""
    wanted = features.select(F.col("row").alias("sid"), F.col("id").alias("own"), "n", F.col("digest").alias("of")).join(_bounded(ids), "sid")
    wanted = written(wanted, "wanted-texts")
    found = docs.withColumn("digest", F.unhex(F.sha2("text", 256))).join(_bounded(wanted), (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("own")))
    kept = written(found.select("sid", "n", "text"), "set-texts")
    return kept if kept.count() == wanted.count() else written(kept.dropDuplicates(["sid"]), "set-texts")  # rows may repeat


def set_maps(kept: DataFrame, k: int, key: int) -> DataFrame:
    """(sid, n, map) from (sid, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in texts(batch.column(2), 1000):
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array(bitmaps(*shingle_tokens(data, offsets, k, key)), pa.binary())], ["sid", "n", "map"])

    return kept.mapInArrow(run, "sid long, n long, map binary")


def _shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    return set(zip(*[words[i:] for i in range(k)])) if len(words) >= k else {tuple(words)}


def verified(pairs: DataFrame, kept: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles, compared word by word, link: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            linked = []
            for a, x, y in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)]):
                if a != last[0]:
                    last = a, _shingles(x.encode(), k)
                own = _shingles(y.encode(), k)
                common = len(last[1] & own)
                linked.append(100 * common >= percent * (len(last[1]) + len(own) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).dropDuplicates(), "pair-sets")
    kept = kept.join(_bounded(ids), "sid", "left_semi")
    left = pairs.join(kept.select(F.col("sid").alias("b"), F.col("text").alias("t")), "b")
    both = left.join(kept.select(F.col("sid").alias("a"), F.col("text").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(id, row, n, root) for every row of (id, text): its number, its set's size, and the least row of its component.

    Texts of fewer than k words are one shingle; a null or empty text has no set (n = 0) and no
    links. Equal texts are one set from the start, so that copies cost nothing. Sets that meet
    are first compared with the most central set of their largest group; then signature trees
    give the pairs of those that are still apart. Rows that repeat come out again.
    """
    key = drawn_key()
    features = written(shingle_features(docs, k, percent, key).withColumn("row", F.monotonically_increasing_id()), "shingle-features")
    held = features.filter("n > 0").select("row", "digest")
    copies = held.groupBy("digest").agg(F.min("row").alias("sid"), F.count("*").alias("n")).filter("n > 1").select("digest", "sid")
    copies = written(held.join(written(copies, "copied-texts"), "digest").filter("row <> sid").select("row", "sid"), "copies")
    sets = features.filter("n > 0").join(_bounded(copies.select("row")), "row", "left_anti").select(F.col("row").alias("sid"), "signatures")
    groups = meetings(features, sets)
    kept = whole_texts(docs, features, groups.select("sid").dropDuplicates())
    links = written(verified(written(hub_pairs(groups), "hub-pairs"), kept, k, percent), "shingle-links")
    roots = components(links)
    rows = apart_rows(groups, roots)
    rows = written(rows, "apart-rows")
    maps = set_maps(kept.join(_bounded(rows.select("sid").dropDuplicates()), "sid", "left_semi"), k, key)
    pairs = written(tree_pairs(rows.join(maps, "sid"), percent), "shingle-pairs")
    more = written(verified(pairs, kept, k, percent), "shingle-links")
    roots = components(links.unionByName(more))
    discard(groups, kept, pairs)
    known = features.select("id", "row", "n").join(copies.withColumnRenamed("row", "copy"), F.col("row") == F.col("copy"), "left").select("id", "row", "n", F.coalesce("sid", "row").alias("sid"))
    return known.join(roots, F.col("sid") == F.col("node"), "left").select("id", "row", "n", F.coalesce("root", "sid").alias("root"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): the least id that links reach, for every row of ``docs``.

    A row without text is a component of its own, however often its id comes. A null id is left
    out of the least ids, and a component of null ids only has none. Rows that repeat come out
    alike, very long texts are compared whole, and other columns of ``docs`` play no part.
    """
    classes = written(jaccard_classes(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), k, percent), "shingle-classes")
    least = classes.filter("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    with_text = classes.filter("n > 0").join(least, "root").select("id", F.col("n").alias("n_shingles"), "component_id")
    return with_text.unionByName(classes.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the least id of their component, with all columns of ``docs``.

    Rows without text stay; repeated rows with a kept id stay as often as they come.
    """
    found = jaccard_components(docs, k, percent, id_col, text_col)
    dropped = _bounded(written(found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id").dropDuplicates(), "near-copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("own_id"))
    return rows.join(dropped, F.col("own_id") == F.col("id"), "left_anti").select("doc.*")


def op6_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of every row of ``documents``; nulls, repeats and the like as in ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90).withColumnRenamed("id", "doc_id")
