"""Main text of pages by wrapper induction: align DOM trees of same-host pages, and keep what varies."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from macrotide.llm.store import table, written
from macrotide.llm.url_filter import url_host

#: A node is template if its text is the same on all of at least so many pages of a host.
MIN_PAGES = 3
#: Tables of seeds, layouts and wrappers of up to so many bytes (as JSON) are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Lists of children with more pairs than this are aligned row by row in numpy, in space that is not their product; the result is the same.
ALIGNED = 1 << 10
#: A page belongs to a layout if this share of its text has a partner there.
COVERED = 0.8
#: Layouts that a host gets in the first round, of so many trees and bytes of trees; later rounds, until every tree has its layout, take up to 8 times as many. The result does not depend on these.
LAYOUTS, CANDIDATES, BATCH_BYTES = 8, 64, 1 << 20
#: Text blocks that a task holds before it hands its sums on.
HELD = 1 << 18

_MARK = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_CLASS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head title script style noscript template iframe nav header footer aside form button select option textarea input dialog menu svg canvas object audio video".split())
_ASIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
#: An opening tag closes these open ones first.
_CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
_FLOWING = _INLINE | {"p"}
_HOLDS = frozenset("article aside div main nav section table ul ol dl body header footer form blockquote td".split())


class Node:
    __slots__ = ("label", "tag", "parts", "parent")

    def __init__(self, label: str, tag: str, parent: Node | None):
        self.label, self.tag, self.parent, self.parts = label, tag, parent, []


@lru_cache(maxsize=65536)
def _label(tag: str, attributes: str) -> str:
    """A tag and the names that pages share, with a final ``!`` if a name is that of what is beside the main text.

    Names with digits (post-123) and ids of more than two words (the-title-of-a-page) are a
    page's own; html and body go without names.
    """
    if tag in ("html", "body"):
        return tag
    names = {(kind.lower() == "id", w.lower()) for kind, *values in _CLASS.findall(attributes) for w in next(filter(None, values), "").split()}
    stable = sorted({w.replace(".", "_").rstrip("!") for is_id, w in names if not re.search(r"\d", w) and not (is_id and len(re.split(r"[_-]+", w)) > 2)})
    return ".".join([tag, *stable]) + ("!" if any(_ASIDE.search(re.sub(r"\d+", "", w)) for _, w in names) else "")


class _Tags:
    """Ends of a page's tags, in time that is linear in the page."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in "<>\"'"}

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose name ends at ``at``, or -1. Quoted ones do not count, unless no other is left."""
        if at > self.last[">"]:
            return -1
        here = at
        while self.quotes:
            mark = _STOP.search(self.page, here)
            if not mark:
                self.quotes = False  # read on without quotes, here and in the rest of the page
                break
            if mark[0] == ">":
                return mark.start()
            here = mark.end()
            if here <= self.last[mark[0]]:
                here = self.page.find(mark[0], here) + 1
        return self.page.find(">", at)


class _Open:
    """The open elements, from the root down, and where those of a tag are."""

    def __init__(self, root: Node):
        self.nodes, self.of, self.holds = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.of.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _HOLDS:
            self.holds.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.of[tag].pop()
            if tag in _HOLDS:
                self.holds.pop()

    def deepest(self, tags) -> int:
        """Depth of the deepest open element with one of these tags, or 0."""
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)


def parse(page: str) -> Node:
    """The DOM of a page, however broken; parts are texts (decoded) and nodes, in order."""
    root = Node("", "", None)
    tags, still = _Tags(page), _Open(root)
    at, n = 0, len(page)
    while at < n:
        mark = _MARK.search(page, at)
        end = mark.start() if mark else n
        stop = tags.end(mark.end()) if mark and mark[2] else 0
        if stop < 0:  # no tag ends from here on
            end, mark = n, None
        if end > at:
            still.nodes[-1].parts.append(entities.unescape(page[at:end]))
        if not mark:
            break
        if not mark[2]:
            kind = mark[0]
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(kind, ">")
            stop = page.find(close, mark.end())
            if kind == "<![CDATA[":
                still.nodes[-1].parts.append(page[mark.end() : stop if stop >= 0 else n])
            at = stop + len(close) if stop >= 0 else n
            continue
        at, tag, attributes = stop + 1, mark[2].lower(), page[mark.end() : stop]
        if mark[1]:
            depth = still.deepest((tag,))
            if depth and not (tag in _FLOWING and still.holds[-1] > depth):
                still.close(depth)
            continue
        while (depth := still.deepest(_CLOSES.get(tag, ()))) and depth >= still.holds[-1]:
            still.close(depth)
        child = Node(_label(tag, attributes), tag, still.nodes[-1])
        still.nodes[-1].parts.append(child)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            end = close.start() if close else n
            child.parts.append(page[at:end])
            stop = page.find(">", end)
            at = n if stop < 0 else stop + 1
        elif tag not in _VOID and not attributes.endswith("/"):
            still.push(child)
    return root


class Shape:
    """A page's compact tree: children with the same label under the same node are one node.

    paths[k] = (parent, label); blocks[k] holds (checksum, length) of the texts of each of the
    nodes merged into it, one by one. An inline element's text is part of the block it is in.
    """

    def __init__(self, root: Node):
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.of, self.block = {id(root): 0}, {}
        self.blocks: list[dict[int, int]] = [{}]
        known: dict[tuple[int, str], int] = {}
        sums: dict[int, list[int]] = {id(root): [0, 0, 0]}
        stack: list[tuple[Node | str, int]] = [(root, id(root))]
        while stack:
            node, block = stack.pop()
            if isinstance(node, str):
                words = node.split()
                if words:
                    # Word by word, so that a text's checksum does not depend on where markup cuts it.
                    raw = (" ".join(words) + " ").encode("utf-8", "surrogatepass")
                    sums[block][0] = zlib.crc32(raw, sums[block][0])
                    sums[block][1] = zlib.adler32(raw, sums[block][1])
                    sums[block][2] += len(raw)
                continue
            k = self.of[id(node)]
            for part in node.parts:
                if isinstance(part, Node):
                    key = (k, part.label)
                    if key not in known:
                        known[key] = len(self.paths)
                        self.paths.append(key)
                        self.blocks.append({})
                    self.of[id(part)] = known[key]
                    if part.tag not in _INLINE or node is root:
                        sums[id(part)] = [0, 0, 0]
                        self.block[id(part)] = id(part)
                    else:
                        self.block[id(part)] = block
            stack.extend((x, block if isinstance(x, str) else self.block[id(x)]) for x in reversed(node.parts))
        self.sums = {x: (crc << 31 ^ adler, n) for x, (crc, adler, n) in sums.items()}
        for x, (crc, n) in self.sums.items():
            if n:
                self.blocks[self.of[x]][crc] = n
        self.length = [sum(x.values()) for x in self.blocks]

    def structure(self) -> str:
        return json.dumps(self.paths, separators=(",", ":"))


@lru_cache(maxsize=65536)
def _kind(label: str) -> str:
    """Labels match if this is the same: the tag, or all of a label that names what is beside the main text."""
    return "!" + label if _beside(label) else label.partition(".")[0]


def _grown(row: list[int], line: list[int]) -> list[int]:
    """Greatest sums of matches with one more child on the left, whose scores are ``line``."""
    out, top = [0], 0
    for j, x in enumerate(line):
        top = max(top, row[j + 1], row[j] + x)
        out.append(top)
    return out


def _grown_wide(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    np.maximum(row[1:], row[:-1] + line, out=out[1:])
    return np.maximum.accumulate(out)


class _Lists:
    """Lists of children of two compact trees; those that are equal, with all that is below, have one number. 0 is the empty one.

    The score of two lists is the greatest sum of matches of their children in order, where two
    children match by 4 for the same label or 1 for the same kind, and by their own lists' score.
    """

    def __init__(self):
        self.items: list[tuple[tuple[str, int], ...]] = [()]
        self.numbers, self.sizes, self.below = {(): 0}, [0], [{}]
        self.scores: dict[int, dict[int, int]] = {}
        self.arrays: dict[int, tuple] = {}
        self.names: dict[str, int] = {}

    def number(self, paths: list) -> tuple[list[list[int]], list[int]]:
        """Children of each node, and the number of their list."""
        kids: list[list[int]] = [[] for _ in paths]
        for k, (parent, _) in enumerate(paths):
            if parent >= 0:
                kids[parent].append(k)
        numbers = [0] * len(paths)
        for k in range(len(paths) - 1, -1, -1):
            if kids[k]:
                key = tuple((paths[c][1], numbers[c]) for c in kids[k])
                if key not in self.numbers:
                    self.numbers[key] = len(self.items)
                    self.items.append(key)
                    self.sizes.append(sum(1 + self.sizes[f] for _, f in key))
                    kinds: dict[str, set[int]] = {}
                    for label, f in key:
                        if f:
                            kinds.setdefault(_kind(label), set()).add(f)
                    self.below.append(kinds)
                numbers[k] = self.numbers[key]
        return kids, numbers

    def known(self, f: int) -> dict[int, int]:
        """Scores of a list with others; with itself every node has its like as partner, which nothing exceeds."""
        return self.scores.setdefault(f, {0: 0, f: 4 * self.sizes[f]})

    def missing(self, f: int, g: int) -> list[tuple[int, int]]:
        left, right = self.below[f], self.below[g]
        return [(p, q) for kind in left if kind in right for p in left[kind] for q in right[kind] if q not in self.known(p)]

    def score(self, f: int, g: int) -> int:
        """Children before their parents, without recursion."""
        stack = [(f, g)]
        while stack:
            p, q = stack[-1]
            if not p or q in self.known(p):
                stack.pop()
            elif missing := self.missing(p, q):
                stack += missing
            else:
                self.known(p)[q] = int(self.rows(p, q, 0, len(self.items[p]), self.first(p, q))[-1][-1])
                stack.pop()
        return self.known(f)[g] if f else 0

    def wide(self, f: int, g: int) -> bool:
        return len(self.items[f]) * len(self.items[g]) > ALIGNED

    def first(self, f: int, g: int):
        n = len(self.items[g]) + 1
        return np.zeros(n, np.int64) if self.wide(f, g) else [0] * n

    def line(self, label: str, below: int, g: int) -> list[int]:
        kind, known = _kind(label), self.known(below) if below else {}
        return [(4 if v == label else 1) + known.get(h, 0) if _kind(v) == kind else 0 for v, h in self.items[g]]

    def name(self, x: str) -> int:
        return self.names.setdefault(x, len(self.names))

    def line_wide(self, label: str, below: int, g: int) -> np.ndarray:
        if g not in self.arrays:
            self.arrays[g] = tuple(np.array(x) for x in zip(*((self.name(v), self.name("kind " + _kind(v)), h) for v, h in self.items[g])))
        labels, kinds, lists = self.arrays[g]
        alike = kinds == self.name("kind " + _kind(label))
        out = alike + 3 * (labels == self.name(label))
        if below:
            known, places = self.known(below), np.flatnonzero(alike & (lists > 0))
            out[places] += np.array([known[h] for h in lists[places].tolist()], np.int64)
        return out

    def rows(self, f: int, g: int, start: int, end: int, row, all_rows: bool = False) -> list:
        """Greatest sums after each of some children of f (or after the last one alone), from the row before them."""
        line, grown = (self.line_wide, _grown_wide) if self.wide(f, g) else (self.line, _grown)
        out = [row]
        for label, below in self.items[f][start:end]:
            row = grown(row, line(label, below, g))
            if all_rows:
                out.append(row)
            else:
                out[0] = row
        return out

    def pairs(self, f: int, g: int) -> list[tuple[int, int]]:
        """Places of the children that the best alignment of two lists pairs; of equal ones that with the last children unpaired.

        Of a wide table only one row in many is held; those between are worked out once more on the way back.
        """
        n, m = len(self.items[f]), len(self.items[g])
        if f == g:
            return [(i, i) for i in range(n)]
        stride = isqrt(n) + 1 if self.wide(f, g) else n
        marks = [self.first(f, g)]
        for start in range(0, n - stride, stride):
            marks.append(self.rows(f, g, start, start + stride, marks[-1])[-1])
        out, i, j, rows, block = [], n, m, [], -1
        while i and j:
            if (i - 1) // stride != block:
                block = (i - 1) // stride
                rows = self.rows(f, g, block * stride, min(n, (block + 1) * stride), marks[block], True)
            here, above = rows[i - block * stride], rows[i - block * stride - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out


@lru_cache(maxsize=4096)
def align(structure: str, seed: str) -> tuple[int, ...]:
    """For each node of a compact tree its partner in ``seed``, or -1, by simple tree matching.

    Two trees match if their roots' labels do, or, for less, if only their tags do and neither
    is beside the main text; the children are then aligned in order so that the sum of their
    matches is the greatest, however many they are.
    """
    a, b, lists = json.loads(structure), json.loads(seed), _Lists()
    (kids_a, below_a), (kids_b, below_b) = lists.number(a), lists.number(b)
    out = [-1] * len(a)
    if _kind(a[0][1]) != _kind(b[0][1]):
        return tuple(out)
    lists.score(below_a[0], below_b[0])
    todo, found = [(0, 0)], {}
    while todo:
        x, y = todo.pop()
        out[x] = y
        both = below_a[x], below_b[y]
        if all(both):
            if both not in found:
                found[both] = lists.pairs(*both)
            todo += [(kids_a[x][i], kids_b[y][j]) for i, j in found[both]]
    return tuple(out)


def _beside(label: str) -> bool:
    """Whether a label names what is never main text."""
    return label.endswith("!") or label.partition(".")[0] in _NEVER


def _masses(paths: list, lengths: list[int]) -> list[int]:
    """Length of the text in and below each node."""
    mass = list(lengths)
    for k in range(len(paths) - 1, 0, -1):
        mass[paths[k][0]] += mass[k]
    return mass


def free_nodes(paths: list, lengths: list[int]) -> list[bool]:
    """Nodes that are not beside the main text; a name does not put a node there that holds most of the text."""
    free = [True] * len(paths)
    for k, (parent, label) in enumerate(paths):
        free[k] = (parent < 0 or free[parent]) and label.rstrip("!").partition(".")[0] not in _NEVER
    mass = _masses(paths, [n if f else 0 for n, f in zip(lengths, free)])
    for k, (parent, label) in enumerate(paths):
        free[k] = free[k] and (parent < 0 or free[parent]) and not (label.endswith("!") and 2 * mass[k] <= mass[0])
    return free


def content_roots(paths: list, lengths: list[int], free: list[bool]) -> set[int]:
    """Articles that hold text, or main elements; else the deepest node that holds at least 60 % of the free text."""
    mass = _masses(paths, [n if f else 0 for n, f in zip(lengths, free)])
    named = [k for k, (_, label) in enumerate(paths) if free[k] and mass[k] and label.partition(".")[0] in ("article", "main")]
    if articles := [k for k in named if paths[k][1].partition(".")[0] == "article"] or named:
        return set(articles)
    root = 0
    while heavy := [k for k in range(root + 1, len(paths)) if paths[k][0] == root and mass[k] >= 0.6 * mass[0] > 0 and paths[k][1].partition(".")[0].rstrip("!") not in _INLINE | {"p"}]:
        root = heavy[0]
    return {root}


def _inside(paths: list, roots: set[int]) -> list[bool]:
    inside = [False] * len(paths)
    for k, (parent, _) in enumerate(paths):
        inside[k] = k in roots or parent >= 0 and inside[parent]
    return inside


@lru_cache(maxsize=256)
def _ways(seed: str) -> dict[tuple[int, str], int]:
    """The ways down from a seed's root, as kinds of nodes: (way to the parent, kind) -> way."""
    ways: dict[tuple[int, str], int] = {}
    to = []
    for parent, label in json.loads(seed):
        to.append(0 if parent < 0 else ways.setdefault((to[parent], _kind(label)), len(ways) + 1))
    return ways


def _at_most(paths: list, mass: list[int], seed: str) -> int:
    """No alignment with a seed holds more: the text of nodes to which there is a way of the same kinds in the seed."""
    ways, to, held = _ways(seed), [], 0
    for (parent, label), n in zip(paths, mass):
        to.append(0 if parent < 0 else ways.get((to[parent], _kind(label)), -1) if to[parent] >= 0 else -1)
        if to[-1] >= 0:
            held += n
    return held


def layout(structure: str, lengths: list[int], seeds: list[str]) -> tuple[int, int, int]:
    """The first seed with the most of a tree's free text in partners, if that is COVERED of it, else -1; the text it holds; and all free text.

    Seeds that cannot hold more than another are passed over without aligning them.
    """
    paths = json.loads(structure)
    mass = [n if f else 0 for n, f in zip(lengths, free_nodes(paths, lengths))]
    total, best, found = sum(mass), -1, -1
    for i, seed in enumerate(seeds):
        if best == total:
            break
        most = _at_most(paths, mass, seed)
        if most <= best or most < COVERED * total:
            continue
        # an inline node's text is counted with its block, so that every mass is a block's
        held = sum(n for n, k in zip(mass, align(structure, seed)) if k >= 0)
        if held > best and held >= COVERED * total:
            best, found = held, i
    return found, best, total


class Wrapper:
    """A layout's seed, its content roots and nodes, and the blocks (node, checksum) that are template.

    Blocks inside the content roots are template only if they are the lesser part of the text
    there: pages that are copies of each other keep their text.
    """

    def __init__(self, seed: str, template: list[tuple[int, int, int]], weights: list[tuple[int, int]], pages: int):
        paths = json.loads(seed)
        lengths, varying = [0] * len(paths), [0] * len(paths)
        for k, n in weights:
            lengths[k] = varying[k] = n
        for k, _, n in template:
            varying[k] -= n * pages
        if not any(varying):
            varying = lengths
        free = free_nodes(paths, lengths)
        roots = content_roots(paths, varying, free)
        inside = _inside(paths, roots)
        self.roots, self.content = roots, [i and f for i, f in zip(inside, free)]
        text = sum(n for n, c in zip(lengths, self.content) if c)
        same = sum(n * pages for k, _, n in template if self.content[k])
        self.template = {(k, crc) for k, crc, _ in template if not self.content[k] or 2 * same < text}


def outline(root: Node, shape: Shape) -> str:
    """Lengths of a page's nodes and its texts in order, as JSON; each text with whether a block begins or ends before it, its node, and node and checksum of its block.

    What is inside head, menus' tags and the like is never main text and left out.
    """
    never = [False] * len(shape.paths)
    for k, (parent, label) in enumerate(shape.paths):
        never[k] = parent >= 0 and never[parent] or label.rstrip("!").partition(".")[0] in _NEVER
    texts: list[list] = []
    space = False
    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            while texts and texts[-1][4] == " ":
                texts.pop()
            space = True
        elif isinstance(x, tuple):
            text, k, block = x
            words = text.split()
            if not words and space:
                continue
            text = (" " if text[0].isspace() else "") + " ".join(words) + (" " if words and text[-1].isspace() else "")
            entry = [int(space), k, shape.of[block], shape.sums[block][0], text]
            if texts and not space and texts[-1][4] != " " and words and texts[-1][1:4] == entry[1:4]:
                texts[-1][4] += text
            else:
                texts.append(entry)
            space = False
        else:
            k, block = shape.of[id(x)], shape.block.get(id(x), id(root))
            edge = [] if x.tag in _INLINE else [None]
            parts = [p if isinstance(p, Node) else (p, k, block) for p in x.parts if isinstance(p, Node) or p and not never[k]]
            stack.extend([*edge, *reversed(parts), *edge])
    return json.dumps([shape.length, texts], separators=(",", ":"), ensure_ascii=False)


def main_text(structure: str, outlined: str, seed: str, wrapper: Wrapper | None) -> str:
    """The blocks of a page that its layout's wrapper calls content; a node that the wrapper does not know follows its parent.

    A page without a wrapper, or with no partner of its content roots, has its roots on the page itself.
    """
    paths = json.loads(structure)
    lengths, texts = json.loads(outlined)
    partner = align(structure, seed) if wrapper else ()
    free = free_nodes(paths, lengths)
    keeps: list[bool] = []
    if wrapper is None or not wrapper.roots.intersection(partner):
        inside = _inside(paths, content_roots(paths, lengths, free))
        keeps = [i and f for i, f in zip(inside, free)]
        template: set = set()
    else:
        template = wrapper.template
        for k, (parent, _) in enumerate(paths):
            keeps.append(wrapper.content[partner[k]] if partner[k] >= 0 else free[k] and parent >= 0 and keeps[parent])
    out: list[str] = []
    for space, k, block, crc, text in texts:
        if space:
            out.append(" ")
        if keeps[k] and not (template and (partner[block], crc) in template):
            out.append(text)
    return " ".join("".join(out).split())


def leaders(structures: list[str], lengths: list[list[int]], most: int = LAYOUTS) -> list[str]:
    """Seeds of a host's layouts, from its trees, the commonest first: a tree that no seed covers is the next one, ``most`` at most."""
    seeds: list[str] = []
    for structure, length in zip(structures, lengths):
        if len(seeds) >= most:
            break
        if layout(structure, length, seeds)[0] < 0:
            seeds.append(structure)
    return seeds


def _held(rows: DataFrame) -> int:
    """Bytes of a small table's rows, as JSON."""
    return rows.agg(F.sum(F.length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0


def _joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(other) if _held(other) <= BROADCAST_BYTES else other, keys)


def _next_seeds(trees: DataFrame, more: int) -> DataFrame:
    """(host, seeds): the next layouts of each host, from the commonest trees that have none yet, ``more`` times the first round's."""
    order = [F.col("pages").desc(), F.col("structure")]
    for salt in ([F.pmod(F.xxhash64("structure"), F.lit(64))], []):  # twice, so that no task sorts all trees of a host
        trees = trees.withColumn("place", F.row_number().over(Window.partitionBy("host", *salt).orderBy(*order))).filter(F.col("place") <= CANDIDATES * more)
    before = Window.partitionBy("host").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trees = trees.withColumn("upto", F.sum(F.length("structure")).over(before)).filter((F.col("upto") <= BATCH_BYTES) | (F.col("place") == 1))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [leaders([t["structure"] for t in x], [t["length"] for t in x], LAYOUTS * more) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seeds, pa.list_(pa.string()))], ["host", "seeds"])

    ranked = trees.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "structure", "length"))).alias("trees"))
    return ranked.mapInArrow(lead, "host string, seeds array<string>")


def _placed(trees: DataFrame, seeds: DataFrame, which=None) -> DataFrame:
    """``trees``, for each row of their host in ``seeds`` (``which`` of them), with the layout, of that row's, that each belongs to (null: none), the text that it holds, and all text."""
    columns = ["host", "tree", "structure", "pages", "length"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout(*x) for x in zip(*[batch.column(i).to_pylist() for i in (2, 4, 6)])]
            layouts = [(n << 16) + which if which >= 0 else None for n, (which, _, _) in zip(batch.column(5).to_pylist(), found)]
            more = [pa.array(layouts, pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], [*columns, "layout", "held", "total"])

    kinds = "host string, tree string, structure string, pages long, length array<long>, layout long, held long, total long"
    rows = _joined(trees.alias("trees"), seeds.alias("seeds"), ["host"])
    rows = rows if which is None else rows.filter(which)
    return rows.select(*columns, "seeds.round", "seeds.seeds").mapInArrow(place, kinds)


def group_layouts(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, layout, seed) and (host, tree, layout) from (host, tree, structure, pages, length), one row for each tree of a host.

    A host's trees are taken in order, the commonest first: one that no seed covers is the seed
    of a new layout. Every tree then belongs to the layout whose seed holds most of its text, the
    earliest of equal ones. Seeds are found some at a time, in rounds over the trees that are not
    yet covered, until there are none; neither their number nor the result is bounded by that.
    """
    still, rounds = trees.select("host", "tree", "structure", "pages", "length"), []
    while True:
        seeds = written(_next_seeds(still, 1 << min(len(rounds), 3)), "page-seeds").withColumn("round", F.lit(len(rounds)))
        placed = written(_placed(still, seeds), "page-layouts")
        rounds.append((seeds, placed))
        still = placed.filter("layout is null").select(*still.columns)
        if still.isEmpty():
            break
    every = rounds[0][0]
    found = rounds[0][1].filter("layout is not null").withColumn("round", F.lit(0))
    for n, (seeds, placed) in enumerate(rounds[1:], 1):
        every = every.union(seeds)
        found = found.union(placed.filter("layout is not null").withColumn("round", F.lit(n)))
    belongs = found.select("host", "tree", "layout", "held")
    if len(rounds) > 1:  # those of earlier rounds may fit later seeds better
        others = _placed(found.filter("held < total"), every, F.col("seeds.round") > F.col("trees.round"))
        belongs = belongs.union(others.filter("layout is not null").select("host", "tree", "layout", "held"))
        belongs = belongs.groupBy("host", "tree").agg(F.max_by("layout", F.struct("held", -F.col("layout"))).alias("layout"))
    numbered = every.select("host", "round", F.posexplode("seeds").alias("at", "seed")).select("host", (F.shiftleft(F.col("round").cast("long"), 16) + F.col("at")).alias("layout"), "seed")
    return numbered, written(belongs.select("host", "tree", "layout"), "page-belongs")


def _trees(partial: DataFrame) -> DataFrame:
    """(host, tree, structure, pages, length): trees of all tasks, with the sums of their pages and of their nodes' lengths."""
    lengths = partial.select("host", "tree", F.posexplode("length").alias("node", "n")).groupBy("host", "tree", "node").agg(F.sum("n").alias("n"))
    lengths = lengths.groupBy("host", "tree").agg(F.array_sort(F.collect_list(F.struct("node", "n")))["n"].alias("length"))
    return partial.groupBy("host", "tree").agg(F.first("structure").alias("structure"), F.sum("pages").alias("pages")).join(lengths, ["host", "tree"])


def tree_of(structure: str) -> str:
    """A short name of a tree."""
    return hashlib.blake2b(structure.encode(), digest_size=16).hexdigest()


def induce_wrappers(pages: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(host, layout, seed, template, weights, pages) of each layout, and (host, tree, layout) of each tree, from (host, html).

    Pages shrink to compact trees with the checksums of their text blocks. Equal trees of a host
    are merged in each task: of their blocks only those on all of them can be template, so the
    others are dropped there, and a hot host costs no more than any other. A host's trees are
    grouped to layouts, as many as there are (``group_layouts``), and aligned with the seed of
    their own. A block is template if all pages of the layout have it at the same node, and there
    are ``min_pages`` of them at least.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0

        def out() -> pa.RecordBatch:
            columns = [[h for h, _ in held], [tree_of(s) for _, s in held], [s for _, s in held], [x[0] for x in held.values()], [x[1] for x in held.values()], [[{"node": k, "crc": c, "n": n} for (k, c), n in x[2].items()] for x in held.values()]]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("node", pa.int32()), ("crc", pa.int64()), ("n", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "tree", "structure", "pages", "length", "blocks"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shape = Shape(parse(page or ""))
                key = (host, shape.structure())
                blocks = {(k, c): n for k, found in enumerate(shape.blocks) for c, n in found.items()}
                if key in held:
                    n, length, known = held[key]
                    size -= len(known)
                    known = {b: m for b, m in known.items() if b in blocks}
                    held[key] = (n + 1, [x + y for x, y in zip(length, shape.length)], known)
                    size += len(known)
                else:
                    held[key] = (1, shape.length, blocks)
                    size += len(blocks) + len(shape.paths)
                if size > HELD:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    kinds = "host string, tree string, structure string, pages long, length array<long>, blocks array<struct<node:int,crc:bigint,n:bigint>>"
    partial = written(pages.select("host", "html").mapInArrow(shapes, kinds), "page-shapes")
    seeds, belongs = group_layouts(written(_trees(partial), "page-trees"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, which, structure, n, length, blocks, seed in zip(*[c.to_pylist() for c in batch.columns]):
                partner = align(structure, seed)
                out.append((host, which, -1, 0, n, 0, 0))
                sums: dict[int, int] = {}
                for k, x in enumerate(length):
                    if x and partner[k] >= 0:
                        sums[partner[k]] = sums.get(partner[k], 0) + x
                out += [(host, which, k, 0, 0, 0, x) for k, x in sums.items()]
                same = {(partner[b["node"]], b["crc"]): b["n"] for b in blocks if partner[b["node"]] >= 0}
                out += [(host, which, k, crc, n, size, 0) for (k, crc), size in same.items()]
            columns = list(zip(*out)) if out else [[]] * 7
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "layout", "node", "crc", "pages", "n", "length"])

    rows = _joined(_joined(partial, belongs, ["host", "tree"]), seeds, ["host", "layout"]).select("host", "layout", "structure", "pages", "length", "blocks", "seed")
    summed = written(
        rows.mapInArrow(aligned, "host string, layout long, node int, crc long, pages long, n long, length long")
        .groupBy("host", "layout", "node", "crc")
        .agg(F.sum("pages").alias("pages"), F.max("n").alias("n"), F.sum("length").alias("length")),
        "page-blocks",
    )
    totals = summed.filter("node = -1").select("host", "layout", F.col("pages").alias("of"))
    kept = summed.filter("node >= 0").join(totals, ["host", "layout"]).filter((F.col("length") > 0) | ((F.col("pages") == F.col("of")) & (F.col("of") >= min_pages)))
    wrappers = kept.groupBy("host", "layout", F.col("of").alias("pages")).agg(
        F.collect_list(F.when(F.col("n") > 0, F.struct("node", "crc", "n"))).alias("template"), F.collect_list(F.when(F.col("length") > 0, F.struct("node", "length"))).alias("weights")
    )
    return seeds.join(wrappers, ["host", "layout"], "left").select("host", "layout", "seed", "template", "weights", "pages"), belongs


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every row of ``pages``.

    A null or empty page has an empty text. A null URL, or one without a host, has the empty
    host. Rows that repeat are treated alike; very long, deep or broken pages are read whole, and
    other columns play no part. An empty table gives no rows. A layout with fewer than MIN_PAGES
    pages has no template; its text is told from menus and the like by their names only. A host
    may have any number of layouts; a page meets only its own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    wrappers, belongs = induce_wrappers(rows)
    wrappers = written(wrappers, "wrappers")
    kind = pages.schema[id_col].dataType.simpleString()

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[str]] = [[], [], []]
            for page in batch.column(3).to_pylist():
                root = parse(page or "")
                shape = Shape(root)
                structure = shape.structure()
                for column, x in zip(columns, (tree_of(structure), structure, outline(root, shape))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.string()) for c in columns)], ["id", "url", "host", "tree", "structure", "outline"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[tuple[str, int], tuple[str, Wrapper | None]] = {}
        for batch in batches:
            out = []
            for i, (host, which, structure, texts) in enumerate(zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 5)])):
                if (host, which) not in built:
                    if len(built) >= 4096:
                        built.clear()
                    seed, template, weights, n = (batch.column(k)[i].as_py() for k in (6, 7, 8, 9))
                    built[host, which] = seed, None if n is None else Wrapper(seed, [(t["node"], t["crc"], t["n"]) for t in template], [(x["node"], x["length"]) for x in weights], n)
                out.append(main_text(structure, texts, *built[host, which]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    read = rows.mapInArrow(outlined, f"id {kind}, url string, host string, tree string, structure string, outline string")
    known = _joined(_joined(read, belongs, ["host", "tree"]), wrappers, ["host", "layout"])
    return known.select("id", "url", "host", "layout", "structure", "outline", "seed", "template", "weights", "pages").mapInArrow(run, f"id {kind}, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; nulls, repeats and the like as in ``extract``."""
    return extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
