"""Words that are made to collide without a key: results stay right."""

import zlib

import numpy as np
import pytest

from macrotide.llm import hmm, ngram_join, packing, substring_dedup
from macrotide.llm.text import _ODD, Words, mixed, span_hashes




def hashes(words, family=0, key=0):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(data, ends - [len(w) for w in words], ends, family, key)


def colliding(family, seed):
    """Two words of 16 lower-case letters and digits with equal hashes of a family, as long as no key is used: three halves are drawn, the fourth is solved for."""
    rng = np.random.default_rng(seed)
    begin = mixed(np.array([16], np.uint64) * _ODD + np.uint64(family))
    spread = lambda x: (x ^ (x >> np.uint64(29))) * _ODD
    while True:
        halves = rng.integers(97, 123, (1 << 16, 3, 8)).astype(np.uint8).view("<u8")[:, :, 0]
        one, other = (mixed(spread(begin) + halves[:, i]) for i in (0, 1))
        fourth = spread(one) + halves[:, 2] - spread(other)
        raw = np.ascontiguousarray(fourth).view(np.uint8).reshape(-1, 8)
        good = np.flatnonzero((((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))).all(1))
        if len(good):
            g = good[0]
            a = halves[g, 0].tobytes() + halves[g, 2].tobytes()
            b = halves[g, 1].tobytes() + fourth[g].tobytes()
            if a != b:
                return a, b


@pytest.fixture(scope="module")
def pair():
    return colliding(0, 1), colliding(1, 2)


def test_pairs_collide_without_a_key_only(pair):
    for family, (a, b) in enumerate(pair):
        x, y = hashes([a, b], family)
        assert x == y and a != b
        assert len({int(v) for key in range(1, 50) for v in hashes([a, b], family, key)}) == 98
    long = [b"x" * 100, b"x" * 99 + b"y"]
    assert len({int(v) for key in (0, 1, 2) for v in hashes(long, 0, key)}) == 6


def test_substring_dedup_keeps_links(spark, pair):
    x, y = (w.decode() for w in pair[1])
    words = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{words} {x}"), (2, f"{words} {y}"), (3, f"{words} {y}")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: r.n_removed for r in got.collect()} == {1: 0, 2: 0, 3: 20}
    with pytest.raises(ValueError):
        substring_dedup.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], 300, 10)


def test_shingles_are_counted_apart(spark, pair):
    x, y = (w.decode() for w in pair[0])
    text = f"a b {x} c d a b {y} c d"
    want = len({tuple(text.split()[i : i + 3]) for i in range(8)})
    got = ngram_join.jaccard_components(spark.createDataFrame([(1, text)], "doc_id long, text string"), 3, 90).first()
    assert got.n_shingles == want


def test_packing_encodes_colliding_words(pair, monkeypatch):
    encode = packing.WordIds(packing.tokenizer_path())
    a, b = pair[0]
    text = b" ".join([a, b, b"plain"])
    want = encode.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert encode(np.frombuffer(text, np.uint8), np.array([0, len(text)])) == [np.array(want, "<u4").tobytes()]
    keys = iter([0, 77])
    monkeypatch.setattr(packing, "drawn_key", lambda: next(keys))  # the worst key first: the words clash and are told apart by the next
    encode._forget()
    assert encode(np.frombuffer(text, np.uint8), np.array([0, len(text)])) == [np.array(want, "<u4").tobytes()] and encode.key == 77
    assert zlib.crc32(np.array(want, "<u4").tobytes()) == zlib.crc32(encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def test_language_model_knows_what_it_has_seen(spark, pair):
    a, b = (w.decode() for w in pair[0])
    docs = [(1, False, f"{a} word"), (2, True, f"{b} word"), (3, False, None)]
    frame = spark.createDataFrame(docs, "id long, held_out boolean, text string")
    got = {r.id: r for r in hmm.hmm_scores(frame, states=2, passes=1).collect()}
    assert got[1].n_known == 3 and got[2].n_known == (3 if a.lower() == b.lower() else 2)
    assert hmm.corpus_key(frame) == hmm.corpus_key(frame.orderBy("id", ascending=False)) != hmm.corpus_key(frame.filter("id < 3"))


def test_words_hash_by_key():
    words = Words(np.frombuffer(b"one two", np.uint8), np.array([0, 7]))
    assert not np.array_equal(words.hashes(0, 5), words.hashes(0, 6)) and np.array_equal(words.hashes(0, 5), words.hashes(0, 5))
