"""Telephony audio round trips, and main text of pages."""

import hashlib
import random
import zlib

import numpy as np

from macrotide.llm import audio, html


def test_law_tables():
    assert list(audio.TABLES["mulaw"][[0, 0x7F, 0x80, 0xFF]]) == [-32124, 0, 32124, 0]
    assert list(audio.TABLES["alaw"][[0x55, 0xD5, 0xAA, 0x2A]]) == [-8, 8, 32256, -32256]


def ima_by_steps(block):
    sample, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(88, block[2])
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + int(audio.INDEX_MOVES[code & 7])))
            out.append(sample)
    return out


def test_adpcm_blocks_equal_a_decoder_by_steps():
    blocks = np.random.default_rng(0).integers(0, 256, (17, 64)).astype(np.uint8)
    assert audio.decode_ima(blocks).tolist() == [ima_by_steps(b.tolist()) for b in blocks]
    assert audio.decode_ima(blocks[:0]).shape == (0, 121)


def test_wave_round_trip_of_every_codec():
    payload = bytes(range(256))
    for codec in audio.TAGS:
        assert audio.read_wave(audio.wave(payload, codec)) == (codec, 8000, payload)
    assert len(audio.decode(audio.wave(payload, "mulaw"))) == 512 and len(audio.decode(audio.wave(payload, "ima_adpcm"))) == 2 * 4 * 121


def test_resample_holds_the_samples():
    pcm = np.array([0, 10, -4, 7], np.int16)
    assert audio.resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 3, -4, 1, 7, 7]
    assert len(audio.resample(pcm, 8000, 12000)) == 6


def test_audio_of_texts(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 100_000), (5, "x" * 64), (5, "x" * 64)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = sorted((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in audio.describe_audio(audio.store_audio(frame)).collect())
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = audio.padded(raw)
        assert len(p) % 64 == 0 and p.startswith(raw) and len(p) > 0
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    assert audio.describe_audio(audio.store_audio(frame.limit(0))).count() == 0


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body>{extra}{body}</body></html>"


def test_main_text_of_a_host(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for i in range(30):
        said = [" ".join(f"w{rng.randrange(999)}" for _ in range(20)) for _ in range(3)]
        body = f"<nav><a href=/>home {i}</a></nav><div class='ad'>buy {i}</div><article><h1>Title {i} &amp; more</h1><p><b>{said[0]}<br>x</b><p>{said[1]}\n  end</p><div class='comments'>nice {i}</div><form>mail {i}</form></article><footer>&copy; {i}</footer>"
        rows.append((i, f"http://h{i % 2}.test/{i}", page(body)))
        want[i] = f"Title {i} & more {said[0]} x {said[1]} end"
    rows += [(100, "http://h0.test/e", None), (101, None, ""), (102, "http://single.test/", page("<div id=main-text><p>only   page</p></div><aside>side</aside>")), (103, "http://h1.test/", "just text &lt;b&gt; <i>it</i>")]
    want |= {100: "", 101: "", 102: "only page"}
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.id: r.text for r in html.extract(frame).collect()}
    assert len(got) == len(rows)
    assert {k: got[k] for k in want} == want
    assert html.extract(frame.limit(0)).count() == 0


def test_template_inside_divs_is_told_by_what_stays_the_same(spark):
    rows = [(i, f"http://d.test/{i}", page(f"<div class=top><p>Our site</p></div><div class=story><h2>Read on</h2><p>story number {i} with many words that differ {i * 7}</p></div><div class=bottom>All rights</div>")) for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in html.extract(frame).collect()}
    assert got == {i: f"story number {i} with many words that differ {i * 7}" for i in range(12)}


def test_simple_tree_matching():
    a = html.Shape(html.parse("<body><div><p>x</p></div><ul><li>1</li></ul></body>")).structure()
    b = html.Shape(html.parse("<body><h1>t</h1><div><p>y</p><span>z</span></div><ul><li>2</li></ul></body>")).structure()
    import json

    names = [x[1] for x in json.loads(a)]
    other = [x[1] for x in json.loads(b)]
    assert all(k >= 0 and names[i] == other[k] for i, k in enumerate(html.align(a, b)))


def test_broken_markup_does_not_fail():
    rng = random.Random(1)
    bits = ["<p", "<div class='a", ">", "</p>", "<!--", "-->", "<script>", "</", "text & &am &#x41;", "<article>", "\"", "'", "<br/>", "<![CDATA[", "]]>"]
    for _ in range(300):
        html.Shape(html.parse("".join(rng.choice(bits) for _ in range(40))))


def texts_of(spark, rows):
    return {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_pages_with_names_of_their_own_and_hosts_with_layouts_keep_their_text(spark):
    said = {i: " ".join(f"word{i * 31 + k}" for k in range(30)) for i in range(36)}
    rows = [(i, f"http://own.test/{i}", page(f"<nav>home</nav><article id='post-{i}' class='post-{i} slug{i}'><p>{said[i]}</p></article>").replace("<body>", f"<body class='postid-{i} has-sidebar'>")) for i in range(12)]
    rows += [(i, f"http://two.test/{i}", page(f"<article><p>{said[i]}</p></article>" if i % 3 else f"<div class=content><p>{said[i]}</p></div><div class=low><span>same</span></div>")) for i in range(12, 24)]
    rows += [(i, None if i % 2 else "no host", page(f"<div class={'content' if i % 3 else 'post'}><p>{said[i]}</p></div>")) for i in range(24, 36)]
    assert texts_of(spark, rows) == said


def test_copies_keep_their_text_and_a_repeated_notice_goes(spark):
    story = "the whole story that all copies share " * 4
    rows = [(i, f"http://copy.test/{i}", page(f"<nav>menu</nav><article><h1>News</h1><p>{story}</p></article>", f"<script>track({i})</script><div class=ad>buy {i}</div>")) for i in range(5)]
    said = {i: " ".join(f"word{i * 31 + k}" for k in range(20)) for i in range(10, 16)}
    rows += [(i, f"http://note.test/{i}", page(f"<div class='with sidebar has-nav'><p>{said[i]}</p>" + f"<p>more of {i}</p>" * (i % 3) + "<p>Read our <b>notice</b>.</p></div>")) for i in said]
    want = {i: f"News {story.strip()}" for i in range(5)} | {i: " ".join([said[i]] + [f"more of {i}"] * (i % 3)) for i in said}
    assert texts_of(spark, rows) == want


def test_every_codec_is_stored_and_decoded_whole(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000 + "end"), (5, "x" * 64), (5, "x" * 64), (6, "".join(chr(33 + i * 7 % 90) for i in range(3000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in audio.describe_all(audio.store_all(frame)).collect():
        payload = audio.padded((dict(rows)[r.id] or "").encode())
        for pcm, codec in zip(r.pcm, audio.TAGS):
            want = audio.decode(audio.wave(payload, codec))
            assert pcm == want.astype("<i2").tobytes() and r[f"feature_{codec}"] == audio.features(want)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(audio.op8_telephony_audio(spark, str(tmp_path)).collect())
    old = audio.describe_audio(audio.store_audio(frame), keep_pcm=False).drop("pcm").select("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "adpcm_tail_feature")
    assert [tuple(r)[:9] for r in got] == sorted(tuple(r) for r in old.collect())
    payload = audio.padded(rows[3][1].encode())
    assert {r.adpcm_feature for r in got if r.doc_id == 4} == {audio.features(audio.decode(audio.wave(payload, "ima_adpcm")))}
    assert audio.describe_all(audio.store_all(frame.limit(0))).count() == 0


def test_deep_and_broken_pages_take_linear_time(spark):
    import time

    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    broken = ["<a " * 350_000, "<a \"'" * 250_000, '<a ">"' * 170_000, "<i>" * 5000 + "<hr>" * 100_000, "<b><div>" + "<i>" * 5000 + "</b>" * 100_000, "</x>" * 250_000, "<!--" * 250_000, "<![CDATA[" * 100_000]
    for text in [deep, *broken]:
        began = time.time()
        html.Shape(html.parse(text))
        assert time.time() - began < 2, text[:20]
    began = time.time()
    shape = html.Shape(html.parse(deep)).structure()
    assert min(html.align(shape, html.Shape(html.parse(deep + "<p>x")).structure())) >= 0 and time.time() - began < 2
    wide = ["".join(f"<div class=c{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}q{'xyz'[i // 600 % 3]}>t</div>" for i in range(k, 1500)) for k in (0, 1)]
    began = time.time()
    html.align(*[html.Shape(html.parse(x)).structure() for x in wide])
    assert time.time() - began < 2
    frame = spark.createDataFrame([(i, "http://h.test/", deep) for i in range(2)] + [(2, "http://h.test/", broken[0])], "page_id long, url string, html string")
    got = {r.id: r.text for r in html.extract(frame).collect()}
    assert got[0] == got[1] == "deep text" and len(got) == 3


def test_alignment_equals_simple_tree_matching_by_recursion():
    rng = random.Random(3)

    def tree(depth):
        tag = rng.choice(["div", "p", "ul", "section"])
        return f"<{tag} class={rng.choice('abc')}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(3) if depth else 0)) + f"</{tag}>"

    def best(a, b, kids_a, kids_b, x, y):
        u, v = a[x][1], b[y][1]
        own = 4 if u == v else int(u.partition(".")[0] == v.partition(".")[0])
        if not own:
            return 0
        left, right = kids_a[x], kids_b[y]
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best(a, b, kids_a, kids_b, p, q))
        return own + table[-1][-1]

    for _ in range(40):
        pages = ["".join(tree(3) for _ in range(3)) for _ in range(2)]
        shapes = [html.Shape(html.parse(x)) for x in pages]
        a, b = (s.paths for s in shapes)
        kids = [[[k for k, (parent, _) in enumerate(paths) if parent == x] for x in range(len(paths))] for paths in (a, b)]
        partner = html.align(*[s.structure() for s in shapes])
        got = sum(4 if a[x][1] == b[y][1] else 1 for x, y in enumerate(partner) if y >= 0)
        assert got == best(a, b, *kids, 0, 0)
        assert all(partner[a[x][0]] == b[y][0] for x, y in enumerate(partner) if y > 0)
