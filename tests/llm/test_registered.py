"""Registered queries on small tables with planted cases, against what was planted and against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from macrotide.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, id long, sequence_id int"
PAGES = "page_id long, url string, html string, host string, tokens string"


def documents(n=420):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(120)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = ["spam", "###", "spam"]
        out.append((i, " ".join(w)))
    out += [(900, None), (901, ""), (902, "Word1 'll don't 漢字 " * 3000), (903, "x"), (903, "x"), (None, "spam ###")]
    return [(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(0, 420) if i % 7] + [(6, 1, 0), (None, 1, 0), (8, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = []
    for i in range(420):
        bad = i % 3 == 0
        host = f"cheap-deals{i % 4}.shop" if bad else ["news.example.org", "blog.site.net", "www.school.edu"][i % 3]
        pages.append((i, f"https://{host}/en/{i}", "<p>x</p>", "clash", "clash"))
    pages += [(800, "https://CHEAP-deals1.shop/en/77777", None, None, None), (801, None, None, None, None), (802, "nothing", None, None, None), (803, "http://a.example.com/en/71", None, None, None), (804, "http://www.com/en/1", None, None, None)]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{path}/pages.parquet")
    return path


def test_mined_rules_block_planted_hosts(spark, folder):
    got = {r.page_id: r for r in __spark_entry__.queries()["op5_url_filter"](spark, folder).collect()}
    assert len(got) == 425
    verdicts = [got[i].verdict for i in range(420)]
    planted = [i for i in range(420) if i % 3 == 0]
    assert all(verdicts[i] == "block" and got[i].n_rules > 0 and got[i].rule is None for i in planted)
    assert all(verdicts[i] == "allow" for i in range(420) if i % 3)
    assert got[800].verdict == "block" and got[800].host == "cheap-deals1.shop"  # no label of its own
    assert (got[801].host, got[801].path, got[801].verdict) == ("", "", "allow") and got[802].verdict == "allow"
    assert (got[803].rule, got[803].verdict) == ("example.com/en/7", "allow") and (got[804].rule, got[804].verdict) == ("com/en/", "block")


def test_classifier_selects_planted_grades(spark, folder):
    got = __spark_entry__.queries()["op2_quality_classifier"](spark, folder)
    rows = got.collect()
    assert got.columns[0] == "doc_id" and len(rows) == len(documents())
    selected = {r.doc_id: r.selected for r in rows if r.doc_id is not None and r.doc_id < 420}
    wrong = [i for i, s in selected.items() if s != (i % 3 != 0)]
    assert len(wrong) <= 4, wrong


def test_packing_places_every_piece(spark, folder):
    rows = __spark_entry__.queries()["op10_ga_packing"](spark, folder).collect()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text, *_ in documents():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            want.append((i, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 4096
    least = -(-sum(w[3] for w in want) // 4096)
    assert least <= len(bins) <= least + 1
