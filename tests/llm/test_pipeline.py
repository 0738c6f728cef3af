"""Every stage of the pipeline against brute force on what its predecessor kept."""

import importlib.util
import random
import zlib

import pytest

import __spark_entry__

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline
from macrotide.llm import mixing, packing, quality

from .test_dedup import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long"


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out, labels = [], []
    for i in range(260):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        bad = i % 5 == 0
        if bad:
            w[3:3] = ["rubbish", "###"]
        elif i > 40 and i % 7 == 0:
            w = out[rng.choice([j for j in range(i) if j % 5])][1].split()
            if i % 2:
                w[rng.randrange(len(w))] = "edited"
        out.append((i, " ".join(w)))
        if bad and i % 10:
            labels.append((i, 0, i % 3 % 2))
        elif i % 2:
            labels.append((i, 1, 0))
    out += [(500, None), (501, ""), (502, "w1"), (None, "w5 w6 w7"), (3, out[3][1])]
    return [(i, t, "en", f"s{(i or 0) % 4}" if i != 9 else None, len(t or ""), 1, 2) for i, t in out], labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = rows_of(1)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    out = [at]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, folder).write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        out.append(at)
    return folder, out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    _, tables = stages
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_quality_keeps_clean_documents(spark, stages):
    folder, tables = stages
    judged = quality.judge(tables[0], quality.fitted(spark, folder))
    assert sorted((r.doc_id for r in tables[1].collect()), key=str) == sorted((r.id for r in judged.filter("selected").collect()), key=str)
    kept = {r.doc_id for r in tables[1].collect()}
    clean = {i for i in range(260) if i % 5}
    assert len(clean & kept) >= 0.95 * len(clean) and len({i for i in range(0, 260, 5)} & kept) <= 8


def test_exact_dedup(stages):
    _, tables = stages
    last = {}
    for r in tables[1].collect():
        last[r.text or ""] = max(last.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in tables[2].collect()) == sorted((i, t) for t, i in last.items())


def test_near_dedup(stages):
    _, tables = stages
    rows = [(r.doc_id, r.text) for r in tables[2].collect() if r.doc_id is not None]
    want = [i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c]
    assert sorted(r.doc_id for r in tables[3].collect() if r.doc_id is not None) == sorted(want)


def test_mixing_and_packing(stages):
    _, tables = stages
    plan = {r.doc.doc_id: r.copies for r in mixing.plan_mix(tables[3]).collect()}
    seen = {}
    for r in tables[4].collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: c for i, c in plan.items() if c}
    from .test_models import brute_pieces

    want = sorted((str(i), k, zlib.crc32(b)) for i, k, _, _, b in brute_pieces([(r.doc_id, r.text) for r in tables[4].collect()]))
    got = tables[5].collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= packing.CAPACITY and len(bins) <= -(-sum(bins.values()) // packing.CAPACITY) + 2


def test_stages_on_empty_tables(spark, stages):
    folder, tables = stages
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, tables[0].limit(0), folder).count() == 0, name
