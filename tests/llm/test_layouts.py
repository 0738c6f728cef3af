"""Layouts of hosts and alignment of wide nodes, as many and as wide as they are."""

import json
import random

from macrotide.llm import html

TAGS = "div section table ul ol dl blockquote pre center address".split()


def page(body):
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


def of_layout(n, i):
    """Page i of layout n: the text under tags of its own, and a heading that all pages of the layout share."""
    a, b, c = TAGS[n % 10], TAGS[n // 10 % 10], "figure" if n // 100 else "fieldset"
    said = " ".join(f"word{n}x{i}x{k}" for k in range(30))
    return page(f"<{a}><{b}><{c}><h2>Heading of {n}</h2><p>{said}</p></{c}></{b}></{a}>"), said


def texts_of(spark, rows):
    return {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_a_host_has_as_many_layouts_as_its_pages_need(spark):
    """12 and 40 layouts, of 3 to 5 pages each: no shared heading stays."""
    rows, want = [], {}
    for host, layouts in (("twelve", 12), ("forty", 40)):
        for n in range(layouts):
            for i in range(3 + n % 3):
                text, said = of_layout(n, i)
                want[len(rows)] = said
                rows.append((len(rows), f"http://{host}.test/{i}", text))
    assert texts_of(spark, rows) == want


def test_layouts_beyond_the_commonest_trees_are_found(spark):
    """70 trees of one layout, two pages each, come before three trees of another, one page each."""
    rows, want = [], {}
    for k in range(70):
        for i in range(2):
            said = " ".join(f"word{k}x{i}x{j}" for j in range(30))
            marks = "".join(f"<{t}>z</{t}>" for b, t in enumerate("h3 h4 h5 h6 dl ol pre".split()) if (k + 1) >> b & 1)
            want[len(rows)] = f"{said} " + " ".join("z" for _ in range(bin(k + 1).count("1")))
            rows.append((len(rows), f"http://many.test/{k}", page(f"<article><p>{said}</p>{marks}</article>")))
    for i in range(3):
        said = " ".join(f"other{i}x{j}" for j in range(30))
        want[len(rows)] = f"{said}{' q' * i}"
        rows.append((len(rows), f"http://many.test/o{i}", page(f"<table><tr><td><h2>Always here</h2><p>{said}</p>" + "".join(f"<{t}>q</{t}>" for t in ("h4", "h5")[:i]) + "</td></tr></table>")))
    assert texts_of(spark, rows) == want


def random_tree(rng, depth):
    tag = rng.choice(["div", "ul", "section", "h2"])
    return f"<{tag} class={rng.choice('abc')}>" + " ".join("word" for _ in range(rng.randrange(4))) + "".join(random_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"


def test_layouts_in_rounds_equal_those_of_all_trees_at_once(spark, monkeypatch):
    rng = random.Random(5)
    trees = {}
    for k in range(90):
        shape = html.Shape(html.parse(page("".join(random_tree(rng, 3) for _ in range(2)))))
        trees.setdefault((f"h{k % 2}", shape.structure()), shape.length)
    rows = [(h, html.tree_of(s), s, rng.randrange(1, 4), n) for (h, s), n in trees.items()]
    want, seeds_of = {}, {}
    for host in ("h0", "h1"):
        mine = sorted((r for r in rows if r[0] == host), key=lambda r: (-r[3], r[2]))
        seeds = []
        for _, _, structure, _, length in mine:
            if not any(fits(structure, length, s)[0] for s in seeds):
                seeds.append(structure)
        seeds_of[host] = seeds
        for _, tree, structure, _, length in mine:
            held = [fits(structure, length, s) for s in seeds]
            want[host, tree] = seeds[max((i for i, x in enumerate(held) if x[0]), key=lambda i: (held[i][1], -i))]
    assert min(map(len, seeds_of.values())) > 8
    frame = spark.createDataFrame(rows, "host string, tree string, structure string, pages long, length array<long>")
    for layouts, candidates, size in ((8, 64, 1 << 20), (3, 5, 2000)):
        for name, value in (("LAYOUTS", layouts), ("CANDIDATES", candidates), ("BATCH_BYTES", size)):
            monkeypatch.setattr(html, name, value)
        seeds, belongs = html.group_layouts(frame)
        named = {(r.host, r.layout): r.seed for r in seeds.collect()}
        assert {h: [s for (g, _), s in sorted(named.items()) if g == h] for h in seeds_of} == seeds_of
        got = [(r.host, r.tree, named[r.host, r.layout]) for r in belongs.collect()]
        assert sorted(got) == sorted((h, t, s) for (h, t), s in want.items())


def fits(structure, length, seed):
    free = html.free_nodes(json.loads(structure), length)
    mass = [n if f else 0 for n, f in zip(length, free)]
    held = sum(n for n, k in zip(mass, html.align(structure, seed)) if k >= 0)
    return held >= html.COVERED * sum(mass), held


def wide(rng, n):
    """A node with n children, most with names that a few others share, some with children of their own."""
    words = ["".join(rng.choice("bcdfgh") for _ in range(4)) for _ in range(n)]
    return page("".join(f"<{rng.choice(['div', 'section'])} class={w}>t{rng.choice(['', '<ul><li>x</ul>', '<ul></ul><p>y</p>'])}</div></section>" for w in words))


def total(a, b, partner):
    assert all(partner[a[x][0]] == b[y][0] for x, y in enumerate(partner) if y > 0)
    return sum(4 if a[x][1] == b[y][1] else 1 for x, y in enumerate(partner) if y >= 0)


def greatest(a, b, x, y):
    u, v = a[x][1], b[y][1]
    own = 4 if u == v else int(u.partition(".")[0] == v.partition(".")[0])
    if not own:
        return 0
    left, right = ([k for k, (parent, _) in enumerate(paths) if parent == z] for paths, z in ((a, x), (b, y)))
    row = [0] * (len(right) + 1)
    for p in left:
        after = [0]
        for j, q in enumerate(right):
            after.append(max(row[j + 1], after[j], row[j] + (MEMO.get((p, q)) or MEMO.setdefault((p, q), greatest(a, b, p, q)))))
        row = after
    return own + row[-1]


MEMO = {}


def test_wide_nodes_are_aligned_by_the_greatest_sum():
    rng = random.Random(2)
    for n, m in ((262, 260), (40, 1700)):
        a, b = (html.Shape(html.parse(wide(rng, k))).structure() for k in (n, m))
        MEMO.clear()
        assert total(json.loads(a), json.loads(b), html.align(a, b)) == greatest(json.loads(a), json.loads(b), 0, 0)


def test_wide_and_narrow_ways_of_aligning_agree(monkeypatch):
    rng = random.Random(4)
    for n, m in ((30, 45), (60, 7), (1, 80)):
        a, b = (html.Shape(html.parse(wide(rng, k))).structure() for k in (n, m))
        found = []
        for most in (0, 1 << 30):
            monkeypatch.setattr(html, "ALIGNED", most)
            html.align.cache_clear()
            found.append(html.align(a, b))
        assert found[0] == found[1]
    html.align.cache_clear()
