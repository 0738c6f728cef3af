"""The classifier, the language model, the mix, URL rules and the pipeline."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from macrotide.llm import hmm, mixing, packing, quality, url_filter
from macrotide.llm.text import texts


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    row, index, value = rng.integers(0, 20, 200), rng.integers(0, 10, 200), rng.random(200)
    grade, w, t = rng.integers(0, 3, 20), rng.normal(size=10), np.array([-0.5, 0.7])
    gw, gt, at = quality.gradient(row, index, value, grade, w, t)
    for i in range(10):
        step = np.eye(10)[i] * 1e-6
        assert abs((quality.gradient(row, index, value, grade, w + step, t)[2] - at) / 1e-6 - gw[i]) < 1e-3
    for i in range(2):
        step = np.eye(2)[i] * 1e-6
        assert abs((quality.gradient(row, index, value, grade, w, t + step)[2] - at) / 1e-6 - gt[i]) < 1e-3


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(0)
    plain = [f"word{i}" for i in range(200)]

    def text(grade):
        w = [rng.choice(plain) for _ in range(40)]
        return " ".join(w + ["rubbish", "###"][: 2 - grade])

    rows = [(i, text(i % 3), i % 3, "clash") for i in range(2600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, grade int, id string")
    model = quality.fit(frame.filter("doc_id < 2400"), dimensions=1 << 12, steps=25)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.id: r for r in quality.judge(frame.filter("doc_id >= 2400"), model).collect()}
    right = [got[i].selected == (g == 2) for i, _, g, _ in rows if i >= 2400]
    assert len(got) == 200 and sum(right) / len(right) >= 0.95
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "word1 " * 50_000)], "doc_id long, text string")
    assert quality.judge(odd, model).count() == 4
    assert quality.select_documents(frame, model).columns == frame.columns
    assert quality.judge(odd.limit(0), model).count() == 0
    assert quality.fit(frame.limit(0), dimensions=64).weights.any() == False  # noqa: E712


def test_forward_and_baum_welch_equal_enumeration():
    rng = np.random.default_rng(0)
    k, s = 3, 5
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T.copy())
    sequences = [rng.integers(0, s, n) for n in (4, 1, 5, 4)]
    start, move, emit, logs = np.zeros(k), np.zeros((k, k)), np.zeros((s, k)), []
    for x in sequences:
        paths = np.stack(np.meshgrid(*[range(k)] * len(x), indexing="ij"), -1).reshape(-1, len(x))
        p = m.start[paths[:, 0]] * m.emit[x[0], paths[:, 0]]
        for t in range(1, len(x)):
            p = p * m.move[paths[:, t - 1], paths[:, t]] * m.emit[x[t], paths[:, t]]
        logs.append(math.log10(p.sum()))
        p /= p.sum()
        np.add.at(start, paths[:, 0], p)
        for t in range(len(x)):
            np.add.at(emit, (x[t], paths[:, t]), p)
            if t:
                np.add.at(move, (paths[:, t - 1], paths[:, t]), p)
    assert np.allclose(m.log_likelihoods(sequences), logs)
    for got, want in zip(m.expected(sequences), (start, move, emit)):
        assert np.allclose(got, want)


def test_language_model_scores(spark):
    rng = random.Random(1)
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(i, i % 7 == 2, " ".join(rng.choice((one, two)[i % 2]) for _ in range(rng.randrange(5, 60)))) for i in range(300)]
    rows += [(400, False, None), (401, True, ""), (402, None, "Only once here"), (403, True, "never seen before a1"), (403, True, "never seen before a1"), (None, True, "a1 " * 5000)]
    got = hmm.hmm_scores(spark.createDataFrame(rows, "id long, held_out boolean, text string"), states=2, passes=4, frequent=50, tabled=100, classes=8).collect()
    assert len(got) == len(rows)
    lower = [(i, bool(h), [*(t or "").lower().split(), "</s>"]) for i, h, t in rows]
    count = {}
    for _, h, w in lower:
        for x in [] if h else w:
            count[x] = count.get(x, 0) + 1
    total, types = sum(count.values()), len(count)
    want = sorted((str(i), h, len(w), sum(x in count for x in w), total, round(sum(math.log10((count.get(x, 0) + 1) / (total + types + 1)) for x in w), 5)) for i, h, w in lower)
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    held = [r for r in got if r.held_out and r.id is not None and r.id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.hmm_scores(spark.createDataFrame([], "id long, held_out boolean, text string"), states=2, passes=1).count() == 0


def test_probabilities_of_a_class_of_words_sum_to_one():
    top = pa.table({"word": pa.array([1, 2, 3, 4]), "n": pa.array([9, 5, 2, 1]), "class": pa.array([0, 1, 0, 0])})
    v = hmm.Vocabulary(top, 3, 4, 17, {0: 15, 1: 6}, 2, 2)
    shares = [(2 + 1) / 10 ** v.class_log[0], (1 + 1) / 10 ** v.class_log[0], 1 / 10 ** v.class_log[0]]
    assert math.isclose(sum(shares), 1) and math.isclose(10 ** v.class_log[1], 1)
    assert (v.tokens, v.types) == (20, 5)


def test_mix(spark):
    rows = [(i, "w " * (i % 5), f"s{i % 4}" if i % 9 else None, 1, 2) for i in range(400)] + [(1, "w", "s1", 1, 2)] * 2 + [(None, None, "empty", 1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies long")
    plan = mixing.plan_mix(frame).collect()
    assert len(plan) == len(rows) and {p.doc.asDict().keys() == set(frame.columns) for p in plan} == {True}
    sizes, targets, taken = {}, {}, {}
    for p in plan:
        s = p.doc.source
        sizes[s], targets[s] = p.source_size, p.target
        taken[s] = taken.get(s, 0) + p.size * p.copies
        assert p.copies <= 3
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, level, capped = sum(sizes.values()), 0.0, set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weights[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weights[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in order:
        want = 3 * sizes[s] if s in capped else level * weights[s]
        assert math.isclose(targets[s], want, rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - want) <= 0.25 * want + 12
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(p.copies for p in plan)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_first_states_come_from_all_texts_and_starts_from_their_starts(spark):
    # Two kinds of text, many copies of one of them, and kinds told apart only after 4,096 words.
    rng = np.random.default_rng(5)
    same = rng.integers(0, 10, 4096)
    late = [np.concatenate([same, rng.integers(lo, lo + 10, 6000)]) for lo in (10, 20) for _ in range(6)]
    texts = late + [late[0]] * 200
    top = pa.table({"word": pa.array(range(30), pa.int64()), "n": pa.array([1] * 30, pa.int64()), "class": pa.array([0] * 30, pa.int64())})
    v = hmm.Vocabulary(top, len(texts), 30, sum(map(len, texts)), {0: 60}, 30, 1)
    coded = spark.createDataFrame([(False, x.astype("<u2").tobytes()) for x in texts], "held_out boolean, symbols binary")
    first = hmm.train(coded, v, states=2, passes=0)
    lows, highs = first.emit[10:20].sum(0), first.emit[20:30].sum(0)
    assert (lows > highs).any() and (highs > lows).any()
    # Whole texts: every one of them starts once, however long it is.
    starts = []
    expected = hmm.Model.expected
    model = hmm.Model(first.start, first.move, first.emit)
    column = pa.array([x.astype("<u2").tobytes() for x in late], pa.binary())
    for _, found in hmm._sequences(column, "<u2"):
        starts.append(expected(model, found)[0].sum())
    assert abs(sum(starts) - len(late)) < 1e-6


def test_urls(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q#f", "http://x.com/en/1", "http://com/en/", "http://b.net/de/1", "http://example.net/de/8?", "http://z.org/es/", "no scheme", None, "", "http://notexample.com#/en/7", "x://h"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "id long, blocked boolean")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, none).collect()}
    assert got == {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("x.com", "/en/1", "com/en/", "block"), 2: ("com", "/en/", "com/en/", "block"), 3: ("b.net", "/de/1", "net/de/", "allow"),
        4: ("example.net", "/de/8", "example.net/de/8", "block"), 5: ("z.org", "/es/", "org/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("notexample.com", "", None, "allow"), 10: ("h", "", None, "allow"),
    }
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_mined_url_rules_block(spark):
    urls = [(i, f"http://{'casino-win' if i % 4 == 0 else 'good' + str(i % 3)}.test/a{i % 5}/") for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 200, 2)], "id long, blocked boolean")
    got = {r.id: r.verdict for r in url_filter.judge_urls(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i, _ in urls)


def test_url_rules_learn_from_the_document_that_a_page_shows(spark):
    # Page i shows document 1000 + i; the labels of documents 0..299 are the opposite of those of the pages' own.
    urls = [(i, f"http://{'casino-win' if i % 4 == 0 else 'good' + str(i % 3)}.test/en/{1000 + i}{('', '/', '.html', '?a=1', '#top')[i % 5]}") for i in range(300)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(1000 + i, i % 4 == 0) for i in range(0, 300, 2)] + [(i, i % 4 != 0) for i in range(300)], "id long, blocked boolean")
    got = {r.id: r.verdict for r in url_filter.judge_urls(pages, labels, by_document=True, rules=()).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i, _ in urls)


def test_mined_rules_equal_brute_force(spark):
    """All token combinations, counted one by one; a rule that a shorter, surer one covers goes."""
    from itertools import combinations

    rng = random.Random(2)
    rows = [(sorted({f"t{rng.randrange(6)}" for _ in range(4)}), rng.random() < 0.3) for _ in range(300)]
    rows = [(t, b or ("t0" in t and "t1" in t and rng.random() < 0.8)) for t, b in rows]
    base = sum(b for _, b in rows) / len(rows)
    sure = {}
    for size in (1, 2, 3):
        for c in combinations([f"t{i}" for i in range(6)], size):
            met = [b for t, b in rows if set(c) <= set(t)]
            if sum(met) >= 20 and sum(met) / len(met) >= 0.4 and sum(met) / len(met) / base >= 1.2:
                sure[c] = sum(met) / len(met)
    want = {c: p for c, p in sure.items() if not any(set(x) < set(c) and sure[x] >= p for x in sure)}
    frame = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules = url_filter.mine_rules(frame, min_lift=1.2)
    got = {tuple(r.tokens): r.confidence for r in rules.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c]) for c in want) and want
    matched = {tuple(r.tokens): (r.n_rules, r.confidence) for r in url_filter.match_rules(frame.select("tokens").dropDuplicates(), rules).collect()}
    held = {tuple(t): [p for c, p in want.items() if set(c) <= set(t)] for t, _ in rows}
    assert matched.keys() == {t for t, x in held.items() if x} and all(matched[t][0] == len(held[t]) and math.isclose(matched[t][1], max(held[t])) for t in matched)


def test_held_out_pages_set_the_confidence(spark):
    rules = spark.createDataFrame([(["a"], 0.9, "a"), (["b"], 0.5, "b"), (["c"], 0.41, "c")], "tokens array<string>, confidence double, token string")
    rows = [(["a"], True)] * 4 + [(["b"], True), (["b"], False)] + [(["c"], False)] * 9 + [(["d"], True)] * 5
    found = url_filter.least_confidence(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), rules)
    assert found == {"confidence": 0.5, "precision": 5 / 6, "recall": 0.5, "pages": 20, "bad": 10}
    found = url_filter.least_confidence(spark.createDataFrame(rows[6:], "tokens array<string>, blocked boolean"), rules)
    assert found["confidence"] is None and found["precision"] == 0


def test_support_floor_does_not_rise_with_the_table(spark):
    rows = [(["host=bad", "depth=3"], True)] * 24 + [(["host=good", "depth=3"], False)] * 20_000
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()
    assert ["host=bad"] in [r.tokens for r in rules]


def test_chunks_of_texts_are_whole():
    rows = ["a b", None, "", "é" * 700_000, "x" * 700_000, "end"]
    seen = []
    for where, data, offsets in texts(pa.array(rows)):
        seen += [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert seen == [r or "" for r in rows]


def brute_pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out += [(i, k, s, len(ids[s : s + 4096]), np.array(ids[s : s + 4096], "<u4").tobytes()) for k, s in enumerate(range(0, len(ids), 4096))]
    return out


def test_packing(spark):
    import zlib

    rng = random.Random(0)
    odd = ["a<|endoftext|>b c", "É İstanbul ΑΣ don't I'LL 12a3\x1cz", "", None, "  ", "\x85a b\xa0c", "ﬁ ½ ² ³a", "word! " * 9000]
    rows = [(i, x) for i, x in enumerate(odd)] + [(100 + i, " ".join(rng.choice("alpha beta *** gamma, delta!! x9".split()) + str(rng.randrange(99)) for _ in range(rng.randrange(1, 900)))) for i in range(150)] + [(100, "again"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = packing.pieces(frame, keep_ids=True)
    want = sorted(brute_pieces(rows), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in items.collect()), key=str) == want
    out = packing.pack(packing.pieces(frame), shard_size=64).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in out) == sorted((str(i), k, zlib.crc32(b)) for i, k, _, _, b in want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r.length for r in out) // 4096)
    assert len(bins) <= least * 1.05 + 2
    assert packing.pack(packing.pieces(frame.limit(0))).count() == 0


def test_crossover_keeps_every_item_once():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 60) for _ in range(200)]
    a, b = (packing.best_fit(rng.sample(range(200), 200), sizes, 100) for _ in range(2))
    child = packing.crossover(a, b, sizes, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 100 for x in child)
    (best, *_), _ = packing.evolve(sizes, [], 100, 1, heuristic=True)
    assert max(best) + 1 <= len(packing.best_fit(sorted(range(200), key=lambda i: -sizes[i]), sizes, 100))


def test_islands_evolve_real_lengths(spark):
    """Lengths of a corpus: mostly short, some cut at the capacity; crossovers gain on islands that start from random orders."""
    rng = random.Random(4)
    lengths = [min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(900)]
    random_first, better = packing.evolve(lengths, [], 4096, 7)
    start = min(len(packing.best_fit(rng.sample(range(900), 900), lengths, 4096)) for _ in range(5))
    assert better > 0 and max(random_first[0]) + 1 <= start
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    for r in packing.evolved_shards(items, shard_size=450).collect():
        sizes = [x.length for x in r["items"]]
        fill = [0] * r.found
        for n, b in zip(sizes, r.bins):
            fill[b] += n
        assert max(fill) <= 4096 and min(fill) > 0 and r.better > 0 and r.crossovers == packing.EPOCHS * packing.ISLANDS * packing.CROSSOVERS
        assert r.found <= len(packing.best_fit(packing.decreasing(sizes), sizes, 4096))


def test_words_are_forgotten_and_cut_as_the_tokenizer_does(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 6)
    encode, plain = packing.WordIds(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    odd = ["a b c d", "a e f g h", "a b i j k l", "a b c", "", "a\u2014. b", "\u00e9. x", "don't. it's! '' 's", "x.'s", "<|endoftext|>. a", "b<|ENDOFTEXT|>", "3.5,6 a_b -- c.", ".c", "c..", "\ufb01. \u00bd. a\u00bd.", "a.\u0301 b", "foo@mail0.example.com", "!!! ??", "x...\u2026", "A.b\u0130.", "a.\x1cb", "a.\x85b", "ab.\u200bcd", "x" * 5000 + "."]
    for together in (1, 3, len(odd)):
        for at in range(0, len(odd), together):
            for _, data, offsets in texts(pa.array(odd[at : at + together])):
                want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd[at : at + together]]
                assert encode(data, offsets) == want
