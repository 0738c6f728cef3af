"""Exact, near and substring deduplication against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re

from macrotide.llm import exact_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, source string, id long, size long, doc string, sid long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 7, 8, "clash", 9) for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(35)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.25:
            t = out[rng.randrange(len(out))][1]
        elif out and kind < 0.5:
            w = words(out[rng.randrange(len(out))][1])
            for _ in range(rng.randrange(1, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage[rng.randrange(0, 10) :]
            t = ("\n" if rng.random() < 0.2 else " ").join(w)
        out.append((i * 3, t))
    out += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "x " * 30000), (1007, "x " * 30001)]
    rng.shuffle(out)
    return out


def brute_components(rows, k, percent):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_equal_brute_force(spark):
    for seed, k, percent in ((1, 3, 90), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed)
        got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows), k, percent).collect()}
        assert got == brute_components(rows, k, percent)


def test_dense_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)


def test_near_copies_leave_one_of_each_group_and_all_columns(spark):
    rows = corpus(4)
    table = docs(spark, [*rows, (None, "null id"), (1003, "one")])
    out = ngram_join.drop_near_copies(table)
    want = brute_components(rows, 5, 80)
    assert out.columns == table.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert kept == sorted([i for i, (_, c) in want.items() if i == c] + [1003])
    assert out.filter("doc_id is null").count() == 1
    assert ngram_join.drop_near_copies(docs(spark, [])).count() == 0


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (5, "a"), (5, "a"), (3, None), (4, ""), (6, "A"), (7, "x" * 200_000), (8, "x" * 200_000), (None, "a"), (None, "n")]
    got = sorted(((r.id, r.largest, r.n) for r in exact_dedup.exact_groups(docs(spark, rows)).collect()), key=str)
    want = [(1, 5, 5), (2, 5, 5), (5, 5, 5), (5, 5, 5), (None, 5, 5), (3, 4, 2), (4, 4, 2), (6, 6, 1), (7, 8, 2), (8, 8, 2), (None, None, 1)]
    assert got == sorted(want, key=str)
    out = exact_dedup.drop_copies(docs(spark, rows))
    assert out.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([5, 4, 6, 8, None], key=str)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0 == exact_dedup.drop_copies(docs(spark, [])).count()


def test_digest_log_probes_older_runs_and_compacts(spark, monkeypatch):
    log = exact_dedup.DigestLog(spark)
    batches = [[(1, b"p"), (2, b"q")], [(3, b"p"), (0, b"r"), (9, b"r")], [(4, b"s")], [(5, b"q"), (None, b"s")]]
    hits = [{bytes(r.digest) for r in log.flush(spark.createDataFrame(part, "id long, digest binary")).collect()} for part in batches]
    assert hits == [set(), {b"p", b"r"}, set(), {b"q", b"s"}]
    assert [level for level, _, _ in log.runs] == [1, 0] and all(found for _, _, found in log.runs)
    got = {bytes(r.digest): (r.smallest, r.largest, r.n) for r in log.lookup().collect()}
    assert got == {b"p": (1, 3, 2), b"q": (2, 5, 2), b"r": (0, 9, 2), b"s": (4, 4, 2)}
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 0)
    assert exact_dedup.digest_filter(spark.createDataFrame([(b"p",)], "digest binary"), 1) is None
    assert exact_dedup.exact_groups(docs(spark, [(1, "a"), (2, "a")])).filter("largest = 2 and n = 2").count() == 2


def test_exact_dedup_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "a"), (5, "a"), (5, "a"), (3, None), (4, ""), (None, "a"), (None, "n"), (None, "n"), (7, "é" * 100_000)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in exact_dedup.op4_exact_dedup(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(exact_dedup.OP4_SQL).fetchall(), key=str)


def brute_removed(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            run = tuple(w[j : j + window])
            if run in seen:
                gone[j : j + window] = [True] * window
            seen.add(run)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_repeats_equal_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
        assert got == brute_removed(rows)


def test_repeats_with_odd_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (3, long), (3, long), (4, "a " + long), (4, "short"), (5, None)]
    got = sorted(((r.id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 50, 0), (3, 50, 50), (3, 50, 50), (4, 51, 50), (4, 1, 0), (5, 0, 0)], key=str)
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_maximal_repeats_are_spans_of_words(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, "x y " + a + " z")]
    row = substring_dedup.remove_repeats(docs(spark, rows)).filter("id = 2").first()
    assert (row.starts, row.ends, row.kept) == ([2], [62], "x y z")


def thue_morse(n):
    """Two words that differ in every letter but have equal polynomial hashes modulo powers of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate({97: 98, 98: 97})


def test_words_that_collide_modulo_powers_of_two(spark):
    x, y = thue_morse(1024)
    lead = [f"w{i}" for i in range(19)]
    table = docs(spark, [(1, " ".join([*lead, x])), (2, " ".join([*lead, y]))])
    assert {r.id: r.n_removed for r in substring_dedup.remove_repeats(table).collect()} == {1: 0, 2: 0}
    table = docs(spark, [(1, f"a b {x}"), (2, f"a b {y}"), (3, x), (4, y)])
    assert {r.id: r.component_id for r in ngram_join.jaccard_components(table, 3, 90).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_matches_are_compared_and_extended_by_words():
    x, y = [b"a", b"b", b"c", b"d", b"e", b"f"], [b"z", b"b", b"c", b"d", b"e", b"g"]
    assert substring_dedup.agreed(x, y, 2, 2, 2) == [(1, 5)]
    assert substring_dedup.agreed(x, y, 0, 6, 3) == [(1, 5)] and substring_dedup.agreed(x, y, 0, 6, 5) == []


def test_periodic_texts_chain(spark):
    rows = [(1, "a b c " * 5000), (2, "b c a " * 300 + "end"), (3, "q " * 40)]
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()} == brute_removed(rows)
    table = docs(spark, rows).selectExpr("doc_id as own", "text")
    matches = substring_dedup.repeated_windows(table, ["own"])
    assert matches.count() > 5_000 > 20 > substring_dedup.chains(matches, ["own"], 20).count()


def test_parts_that_similar_sets_agree_in():
    rng = random.Random(3)
    import numpy as np

    for percent in (60, 80, 90, 100):
        for n in (1, 2, 3, 7, 20, 60, 300):
            for _ in range(6):
                a = {rng.randrange(1 << 54) for _ in range(n)}
                b = set(a)
                for _ in range(rng.randrange(0, 1 + n * (100 - percent) // 150)):
                    if rng.random() < 0.5 and len(b) > 1:
                        b.discard(rng.choice(sorted(b)))
                    if rng.random() < 0.5:
                        b.add(rng.randrange(1 << 54))
                if 100 * len(a & b) < percent * len(a | b):
                    continue
                tokens = np.array([*sorted(a), *sorted(b)], np.uint64)
                (x, y), need = ngram_join.part_signatures(tokens, np.array([0, len(a), len(a) + len(b)]), percent)
                common = set(x.tolist()) & set(y.tolist())
                for parity in (0, 1):
                    met = sum(1 for s in common if s % 2 == parity)
                    if need[0, parity] and need[1, parity] and met:
                        assert any(sum(1 for s in common if s % 2 == p) >= need[i, p] > 0 for p in (0, 1) for i in (0, 1))
                assert any(0 < need[0, p] <= sum(1 for s in common if s % 2 == p) >= need[1, p] > 0 for p in (0, 1)), (percent, n)
