"""Main text of web pages by wrappers inferred from pages of one host.

A page is a stream of tags and texts. Runs of equal neighbours in the stream become repeated groups.
The streams of all pages of a host are then aligned one after another: text that differs becomes a
slot, a stretch that only one side has is optional, a single unit opposite a repeated group a
repetition of it. The result is a regular expression without unions, the host's wrapper. Its texts
lie in containers (sections, divisions, lists and the like). Main containers are the articles where
their slots hold most text outside links and outside anything marked as boilerplate, else the lowest
container of all such slots.

Each page is matched against its host's wrapper. Texts that fall on a constant of it are dropped;
of those that fall on slots, the ones in main containers are the page's main text, without
boilerplate inside them.
"""

from __future__ import annotations

import functools
import html
import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtrail.llm import common
from termtrail.llm.url_filter import host_of

LEAST_PAGES = 3  # pages of a host that a constant is on
LONGEST_UNIT = 16  # tokens of a repeated group
MERGED = 16  # wrappers aligned at once

# Fixed values of HTML: elements by what they do to a stream of text.
DROPPED = "script style noscript template textarea title select svg iframe object canvas head".split()
MARKED = "nav header footer aside form menu dialog button".split()
CONTAINERS = set("html body main article section div ul ol dl table tbody thead tr td th li blockquote figure details "
                 "fieldset center".split()) | set(MARKED)
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 pre hr dt dd address caption figcaption summary legend option".split())
MARKED_NAMES = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar "
                   "aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply "
                   "replies disqus cookie cookies consent notice notices popup modal overlay share sharing social related "
                   "newsletter subscribe subscription signup login search widget toolbar pagination pager".split())
# words that say nothing of their own beside a marked one: "comment-list" is marked, "related-work" is not
NEUTRAL_NAMES = set("area article articles bar block bottom box button buttons col column container content count fixed form global "
                    "icon icons inner item items js left link links list main media news outer page panel post posts primary rail "
                    "right secondary section side site slot sticky teaser teasers text thread title toggle top unit user wrap "
                    "wrapper zone".split())
MARKED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog form alert menu toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(DROPPED) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?", re.I)
UNMARKED = set("html body main article".split())  # hold the text whatever their class words say
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@functools.lru_cache(maxsize=10_000)
def _boilerplate(value: str) -> bool:
    """Whether a class or id names boilerplate: marked words, and at most neutral ones beside them."""
    named = [w.lower() for w in _NAME.findall(value)]
    return any(w in MARKED_NAMES for w in named) and all(w in MARKED_NAMES or w in NEUTRAL_NAMES for w in named)


def _tag(name: str, attributes: str) -> tuple[str, bool]:
    """The key of an opening tag, and whether it marks boilerplate."""
    marked, classes = name in MARKED, ""
    if attributes.strip(" /"):
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "class":
                classes = "." + ".".join(sorted(re.sub(r"\d+", "", value).split()))
            if kind in ("class", "id"):
                marked |= name not in UNMARKED and any(map(_boilerplate, value.split()))
            elif kind == "role":
                marked |= name not in UNMARKED and value.lower() in MARKED_ROLES
            elif kind == "hidden":
                marked |= name not in UNMARKED
    return name + (classes if classes != "." else ""), marked


# A node's key is a tag with its classes, "#" with the containers of a text, or the keys of a repeated group.
Key = str | tuple["Key", ...]


class Node(NamedTuple):
    """A part of a wrapper, with what the pages that have it hold there."""

    key: Key
    text: str | None = None  # of a single text on one page
    pages: int = 1
    held: dict = {}  # by container path: characters outside links, and those of texts that all of its pages have there


class Wrapper(NamedTuple):
    """Nodes in order; those that not all ``pages`` have are optional."""

    pages: int
    nodes: list[Node]


class Text(NamedTuple):
    at: int  # place in the stream
    text: str
    weight: int  # characters outside links
    path: tuple[str, ...]


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    weight: int
    parts: tuple[Text, ...]


@functools.lru_cache(maxsize=10_000)
def _breaks(name: str) -> bool:
    """Whether a tag ends a line of text."""
    found = re.match("[a-z0-9]+", name)
    return found is not None and found[0] in BLOCKS


def read(page: str | None) -> tuple[list[str], dict[int, str], list[Block]]:
    """The stream of a page, its texts by place, and its unmarked text between tags that break lines.

    What has no closing tag ends with its container.
    """
    keys: list[str] = []
    texts: dict[int, str] = {}
    found: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # element, key, marked
    path: tuple[str, ...] = ()
    key, marked, links = "#", False, 0
    now: list[str] = []
    parts: list[Text] = []
    last: tuple[str, ...] = ()

    def close() -> None:
        text = " ".join("".join(now).split())
        if text:
            found.append(Block(last, text, sum(p.weight for p in parts), tuple(parts)))
        now.clear()
        parts.clear()

    for m in _TOKEN.finditer(page or ""):
        if m.lastgroup == "text":
            text = m["text"]
            plain = " ".join(text.split())
            if not marked:
                now.append(html.unescape(text))
                last = path
                if plain:
                    parts.append(Text(len(keys), plain, 0 if links else len(plain), path))
            if plain:
                texts[len(keys)] = plain
                keys.append(key)
        elif m.lastgroup == "attributes":
            name, depth = m["name"].lower(), len(stack)
            moved = False
            if name == "a":
                links = 0 if m["end"] else 1
            if m["end"]:
                if name in CONTAINERS and any(e == name for e, *_ in stack):
                    while stack.pop()[0] != name:
                        pass
                    links, moved = 0, True
                keys.append(f"</{name}>")
            else:
                tag, boilerplate = _tag(name, m["attributes"])
                if name in ("li", "tr", "td", "th") and depth and stack[-1][0] == name:
                    stack.pop()
                    moved = True
                if name in CONTAINERS and not m["attributes"].endswith("/"):
                    stack.append((name, tag, boilerplate))
                    moved = True
                keys.append(f"<{tag}>")
            if moved:
                path, marked = tuple(k for _, k, _ in stack), any(x for *_, x in stack)
                key = "#" + " ".join(path) + (" !" if marked else "")
            if _breaks(name):
                close()
            elif name.startswith("br") and not m["end"]:
                now.append(" ")
    close()
    return keys, texts, found


# Characters that stand for keys while repeats are looked for: a unit begins with an opening tag or a group.
_OPEN, _OTHER, _END = 0xE000, 0x20000, 0x110000
_UNITS = [re.compile(f"([{chr(_OPEN)}-{chr(_OTHER - 1)}].{{{size - 1}}})\\1+", re.S) for size in range(1, LONGEST_UNIT + 1)]


def folded(keys: list[Key]) -> list[tuple[Key, int, int]]:
    """Repeated neighbours as groups, innermost and shortest first: keys and the stretches they stand for."""
    codes: dict[Key, str] = {}
    names: dict[str, Key] = {}
    opened, other = _OPEN, _OTHER

    def code(key: Key) -> str:
        nonlocal opened, other
        if key not in codes:
            if isinstance(key, tuple) or key[0] == "<" and key[1] != "/":
                codes[key], opened = chr(opened), opened + 1
            else:
                codes[key], other = chr(other), other + 1
            names[codes[key]] = key
        return codes[key]

    if len(keys) > 1:
        distinct = set(keys)
        if 2 * len(distinct) > _OTHER - _OPEN:  # more names than characters: nothing is folded
            return [(k, i, i + 1) for i, k in enumerate(keys)]
    line = "".join(map(code, keys))
    starts = list(range(len(line) + 1))
    changed = True
    while changed:
        changed = False
        for size, pattern in enumerate(_UNITS, 1):
            if 2 * size > len(line):
                break
            out, at, place = [], [], 0
            for m in pattern.finditer(line):
                key = tuple(names[c] for c in m[1])
                if (size == 1 and isinstance(key[0], tuple)) or opened >= _OTHER:
                    continue
                out += [line[place:m.start()], code(key)]
                at += [*starts[place:m.start()], starts[m.start()]]
                place = m.end()
            if place:
                line, starts, changed = "".join(out) + line[place:], at + starts[place:], True
    return [(names[c], starts[i], starts[i + 1]) for i, c in enumerate(line)]


def _joined(nodes: list[Node], key: Key) -> Node:
    held: dict = {}
    for n in nodes:
        for path, (mass, texts) in n.held.items():
            before, same = held.get(path, (0, {}))
            held[path] = before + mass, same | {t: same.get(t, 0) + w for t, w in texts.items()}
    return Node(key, None, nodes[0].pages, held)


def fold(nodes: list[Node]) -> list[Node]:
    """Repeated neighbours as groups."""
    return [nodes[i] if j == i + 1 else _joined(nodes[i:j], key) for key, i, j in folded([n.key for n in nodes])]


def _groups(keys: Iterable[Key]) -> set[tuple]:
    found: set[tuple] = set()
    for k in keys:
        if isinstance(k, tuple):
            found |= {k} | _groups(k)
    return found


def _units(groups: set[tuple]) -> dict[Key, list[tuple]]:
    """Units by their first key, shortest first."""
    by_first: dict[Key, list[tuple]] = defaultdict(list)
    for unit in sorted(groups, key=lambda u: (len(u), repr(u))):
        by_first[unit[0]].append(unit)
    return by_first


def regrouped(keys: list[Key], units: dict[Key, list[tuple]], pages: list[int] | None = None) -> list[tuple[Key, int, int]]:
    """A unit of a group that stands alone is the group too, also within groups: keys and their stretches."""
    def alike(lo: int, hi: int) -> bool:
        return pages is None or len(set(pages[lo:hi])) == 1

    now = [(_inner(k, units), i, i + 1) for i, k in enumerate(keys)]
    changed = bool(units)
    while changed:
        changed, out, i = False, [], 0
        line = [k for k, *_ in now]
        while i < len(now):
            key, lo, hi = now[i]
            for unit in units.get(key, ()):
                j = i
                while tuple(line[j:j + len(unit)]) == unit:
                    j += len(unit)
                if j > i and alike(lo, now[j - 1][2]):
                    key, hi, i, changed = unit, now[j - 1][2], j - 1, True
                    break
            if out and isinstance(key, tuple) and out[-1][0] == key and alike(out[-1][1], hi):
                lo, changed = out.pop()[1], True
            out.append((key, lo, hi))
            i += 1
        now = out
    return now


def _inner(key: Key, units: dict[Key, list[tuple]]) -> Key:
    if not isinstance(key, tuple) or not units:
        return key
    inside = tuple(k for k, *_ in regrouped(list(key), units))
    return inside[0] if len(inside) == 1 and isinstance(inside[0], tuple) else inside


def _regrouped(nodes: list[Node], units: dict[Key, list[tuple]]) -> list[Node]:
    found = regrouped([n.key for n in nodes], units, [n.pages for n in nodes])
    return [nodes[i]._replace(key=key) if j == i + 1 else _joined(nodes[i:j], key) for key, i, j in found]


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """The wrapper of all pages of two: texts that differ become slots, what one side lacks is optional,
    a single unit opposite a repeated group a repetition of it.
    """
    units = _units(_groups(n.key for w in (a, b) for n in w.nodes))
    x, y = _regrouped(a.nodes, units), _regrouped(b.nodes, units)
    out: list[Node] = []
    for kind, i, j, k, m in SequenceMatcher(None, [n.key for n in x], [n.key for n in y], autojunk=False).get_opcodes():
        if kind != "equal":
            out += x[i:j] + y[k:m]
            continue
        for p, q in zip(x[i:j], y[k:m], strict=True):
            held = {}
            for path in p.held | q.held:
                (mass, texts), (more, others) = p.held.get(path, (0, {})), q.held.get(path, (0, {}))
                held[path] = mass + more, {t: w + others[t] for t, w in texts.items() if t in others}
            out.append(Node(p.key, p.text if p.text == q.text else None, p.pages + q.pages, held))
    return Wrapper(a.pages + b.pages, out)


def match(wrapper: Wrapper, keys: list[Key]) -> list[tuple[int | None, int, int]]:
    """The wrapper's node for each stretch of a folded stream.

    A page of the wrapper's own host takes a way through the expression that leaves out optional
    nodes only; of another page, what aligns with the wrapper is named, the rest has no node.
    """
    own = [n.key for n in wrapper.nodes]
    found = regrouped(keys, _units(_groups([*own, *keys])))
    line = [k for k, *_ in found]
    places: list[int | None] = [None] * len(line)
    waiting: list[tuple[int, int, tuple]] = [(0, 0, ())]
    seen: set[tuple[int, int]] = set()
    while waiting:
        i, j, way = waiting.pop()
        while i < len(own):
            if j < len(line) and own[i] == line[j]:
                if (i, j) in seen:
                    break
                seen.add((i, j))
                if wrapper.nodes[i].pages < wrapper.pages:
                    waiting.append((i + 1, j, way))
                i, j, way = i + 1, j + 1, (i, way)
            elif wrapper.nodes[i].pages < wrapper.pages:
                i += 1
            else:
                break
        if i == len(own) and j == len(line):
            for at in range(j - 1, -1, -1):
                places[at], way = way
            break
    else:
        for i, j, n in SequenceMatcher(None, own, line, autojunk=False).get_matching_blocks():
            places[j:j + n] = range(i, i + n)
    return [(place, i, j) for place, (_, i, j) in zip(places, found, strict=True)]


def expression(nodes: list[Node], pages: int = 0) -> str:
    """The wrapper as text: constants as they are, slots as #."""
    def shown(key: Key) -> str:
        return "(" + "".join(map(shown, key)) + ")+" if isinstance(key, tuple) else "#" if key[0] == "#" else key

    pages = pages or max((n.pages for n in nodes), default=0)
    out = []
    for optional, run in itertools.groupby(nodes, lambda n: n.pages < pages):
        text = "".join(n.text if n.text and n.pages > 1 else shown(n.key) for n in run)
        out.append(f"({text})?" if optional else text)
    return "".join(out)


def blocks(page: str | None) -> list[Block]:
    """The unmarked text of a page between tags that break lines."""
    return read(page)[2]


def article_root(path: tuple[str, ...]) -> tuple[str, ...] | None:
    """The outermost article that holds a path, else the outermost main element."""
    names = [k.split(".")[0] for k in path]
    for name in ("article", "main"):
        if name in names:
            return path[:names.index(name) + 1]
    return None


def main_paths(pages: list[str | None], constants: set[str]) -> list[list[str]]:
    """Containers of the main text: all articles if they hold half of it, else the lowest one with all of it."""
    return _roots((b.path, b.weight) for page in pages for b in blocks(page) if b.text not in constants)


def _roots(found: Iterable[tuple[tuple[str, ...], int]]) -> list[list[str]]:
    mass: dict[tuple[str, ...], int] = defaultdict(int)
    for path, weight in found:
        if weight > 0:
            mass[path] += weight
    if not mass:
        return []
    roots = {r for p in mass if (r := article_root(p)) is not None}
    if 2 * sum(n for p, n in mass.items() if article_root(p) is not None) >= sum(mass.values()):
        return [list(r) for r in sorted(roots)]
    return [os.path.commonprefix([list(p) for p in mass])]


def _constants(node: Node) -> dict[tuple[str, ...], dict]:
    """Texts that a node's pages, ``LEAST_PAGES`` or more, all have there, in no article or main element."""
    return {p: texts for p, (_, texts) in node.held.items() if node.pages >= LEAST_PAGES and article_root(p) is None}


def slot_paths(wrapper: Wrapper) -> list[list[str]]:
    """Containers of the main text by the wrapper's slots."""
    fixed = [_constants(n) for n in wrapper.nodes]
    return _roots((p, mass - sum(c.get(p, {}).values()))
                  for n, c in zip(wrapper.nodes, fixed, strict=True) for p, (mass, _) in n.held.items())


def _single(page: str | None) -> Wrapper:
    """The wrapper of one page, with its texts as they are."""
    keys, texts, found = read(page)
    nodes = [Node(k, texts.get(i)) for i, k in enumerate(keys)]
    for t in (t for b in found for t in b.parts):
        nodes[t.at] = nodes[t.at]._replace(held={t.path: (t.weight, {t.text: t.weight})})
    return Wrapper(1, fold(nodes))


def infer(pages: list[str | None]) -> tuple[str, list[list[str]]]:
    """Wrapper expression and main container paths from sample pages, equal pages once."""
    distinct = sorted({p for p in pages if p}, key=lambda p: (len(p), p))
    wrapper = functools.reduce(align, map(_single, distinct)) if distinct else Wrapper(0, [])
    return expression(wrapper.nodes, wrapper.pages), slot_paths(wrapper)


def _under(path: tuple[str, ...], roots: set[tuple[str, ...]]) -> bool:
    return any(path[:i] in roots for i in range(len(path) + 1))


def _key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _main_text(found: list[Block], roots: set[tuple[str, ...]]) -> str:
    """Blocks of the main containers, one to a line.

    A page with less than half of its unmarked text in its host's containers is judged by itself.
    """
    if 2 * sum(b.weight for b in found if _under(b.path, roots)) < sum(b.weight for b in found) or not roots:
        roots = {tuple(p) for p in _roots((b.path, b.weight) for b in found)}
    return "\n".join(b.text for b in found if _under(b.path, roots))


def extract(page: str | None, paths: list[list[str]]) -> str:
    """The main text of a page by given containers."""
    return _main_text(blocks(page), {tuple(p) for p in paths})


class Extractor:
    """Main texts of a host's pages by its wrapper; ways through it are kept for streams met before."""

    def __init__(self, main: str | None):
        found = json.loads(main or '{"pages": 0, "nodes": [], "paths": []}')
        self.wrapper = Wrapper(found["pages"], [Node(_key_of(k), None, n) for k, n, _ in found["nodes"]])
        self.constants = [frozenset(c) for *_, c in found["nodes"]]
        self.roots = {tuple(p) for p in found["paths"]}
        self.ways: dict[tuple, list] = {}

    def slots(self, found: list[Block], keys: list[str]) -> list[Block]:
        """Blocks with a text that falls on no constant."""
        if not any(self.constants):
            return found
        stream = folded(keys)
        line = tuple(k for k, *_ in stream)
        if line not in self.ways:
            if len(self.ways) >= 1000:
                self.ways.clear()
            self.ways[line] = match(self.wrapper, list(line))
        fixed: dict[int, frozenset] = {}
        for place, i, j in self.ways[line]:
            if place is not None and self.constants[place]:
                fixed |= dict.fromkeys(range(stream[i][1], stream[j - 1][2]), self.constants[place])
        return [b for b in found if not b.parts
                or any(_key(" ".join(t.path), t.text) not in fixed.get(t.at, ()) for t in b.parts)]

    def text(self, page: str | None) -> str:
        """A page of nothing but constants keeps them."""
        keys, _, found = read(page)
        return _main_text(self.slots(found, keys) or found, self.roots)


def _key_of(found: str | list) -> Key:
    return found if isinstance(found, str) else tuple(map(_key_of, found))


def _dumped(wrapper: Wrapper) -> str:
    return json.dumps([wrapper.pages, [[n.key, n.pages, [[" ".join(p), mass, [*texts.items()]] for p, (mass, texts) in n.held.items()]]
                                       for n in wrapper.nodes]])


def _loaded(text: str) -> Wrapper:
    pages, nodes = json.loads(text)
    return Wrapper(pages, [Node(_key_of(k), None, n, {tuple(p.split()): (mass, dict(map(tuple, texts))) for p, mass, texts in held})
                           for k, n, held in nodes])


_TEXTS = "host string, skeleton bigint, page bigint, node int, path string, block bigint, weight bigint"
_PAGE, _SKELETON = -1, -2  # in place of a node: a row for each page, and for each skeleton (its keys as JSON)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each page by the nodes of its skeleton; ``page`` is a hash of its unmarked text."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    names = ["host", "skeleton", "page", "node", "path", "block", "weight"]
    known: dict[tuple, int] = {}
    told: set[tuple] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            out: list[tuple] = []
            for host, page in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                keys, _, found = read(page)
                stream = folded(keys)
                line = tuple(k for k, *_ in stream)
                if len(known) > 10_000:
                    known.clear()
                    told.clear()
                if line not in known:
                    known[line] = _key("", json.dumps(line))
                skeleton = known[line]
                if (host, skeleton) not in told:
                    told.add((host, skeleton))
                    out.append((host, skeleton, 0, _SKELETON, json.dumps(line), 0, 0))
                whole = _key("", "\n".join(b.text for b in found))
                out.append((host, skeleton, whole, _PAGE, "", 0, 0))
                places = [n for n, (_, i, j) in enumerate(stream) for _ in range(i, j)]
                weights: dict[tuple, int] = defaultdict(int)
                for t in (t for b in found for t in b.parts):
                    path = " ".join(t.path)
                    weights[places[t.at], path, _key(path, t.text)] += t.weight
                out += [(host, skeleton, whole, *at, weight) for at, weight in weights.items()]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of all pages of one skeleton."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            made = []
            for line, n, held in zip(*(c.to_pylist() for c in batch.slice(lo, 64).select(["keys", "n", "held"]).columns), strict=True):
                nodes = [Node(k, None, n, {}) for k in map(_key_of, json.loads(line))]
                for h in held or ():
                    nodes[h["node"]].held[tuple(h["path"].split())] = h["mass"], {a["block"]: a["weight"] for a in h["always"]}
                made.append(_dumped(Wrapper(n, nodes)))
            yield pa.record_batch([batch.slice(lo, 64).column("host"), pa.array(made, pa.string())], ["host", "wrapper"])


def _aligned(table: pa.Table) -> pa.Table:
    """One wrapper of a few of a host's, shorter ones first."""
    found = sorted(table.column("wrapper").to_pylist(), key=lambda w: (len(w), w))
    made = _dumped(functools.reduce(align, map(_loaded, found)))
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([made], pa.string())})


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for wrapper in map(_loaded, batch.column("wrapper").to_pylist()):
            nodes = [[n.key, n.pages, sorted({t for c in _constants(n).values() for t in c})] for n in wrapper.nodes]
            made.append(json.dumps({"pages": wrapper.pages, "nodes": nodes, "paths": slot_paths(wrapper)}))
        yield pa.record_batch([batch.column("host"), pa.array(made, pa.string())], ["host", "main"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, main)`` for each host, from all its pages: the wrapper's nodes with their constants, and
    the container paths of its main text, as JSON.

    Pages of one folded stream (skeleton) are counted on Spark, without their order: how many have
    it, and which texts all of them have at a node. Pages of equal unmarked text count once there.
    A host's skeletons are then aligned in a tree, ``MERGED`` at a time. A text is constant if all
    pages with its node, ``LEAST_PAGES`` or more, have it there, in no article or main element.
    Counts and masses are summed before they are shuffled, so a host with a third of all pages is
    no hot key.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    key = ["host", "skeleton"]
    seen = common.stored(rows.mapInArrow(_texts, _TEXTS).groupBy(*key, "page", "node", "path", "block")
                         .agg(F.max("weight").alias("weight")), "texts")
    counts = common.stored(seen.where(F.col("node") == _PAGE).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "counts")
    texts = seen.where("node >= 0").groupBy(*key, "node", "path", "block").agg(
        F.count(F.lit(1)).alias("found"), F.sum("weight").alias("weight"))
    held = texts.join(counts, key).groupBy(*key, "node", "path").agg(
        F.sum("weight").alias("mass"),
        F.collect_list(F.when(F.col("found") == F.col("n"), F.struct("block", "weight"))).alias("always"))
    held = held.groupBy(*key).agg(F.collect_list(F.struct("node", "path", "mass", "always")).alias("held"))
    skeletons = seen.where(F.col("node") == _SKELETON).select(*key, F.col("path").alias("keys"))
    now = skeletons.join(counts, key).join(held, key, "left").select("host", "keys", "n", "held")
    now = common.stored(now.mapInArrow(_singles, "host string, wrapper string"), "wrappers")
    while True:
        of_host = now.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (of_host.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        dealt = now.join(of_host, "host").withColumn(
            "bucket", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / MERGED)))
        now = common.stored(dealt.select("host", "bucket", "wrapper").groupBy("host", "bucket").applyInArrow(
            _aligned, "host string, wrapper string"), "wrappers")
    return common.stored(now.mapInArrow(_described, "host string, main string"), "described")


def main_texts(pages: DataFrame, known: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every row by the wrappers of ``known``; whole pages.

    Null pages and pages without text give an empty text; null urls are of the host "". Repeated
    rows give repeated results, an empty table none; further columns are not read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"),
                        host_of(F.col(url_col)).alias("host")).join(known.select("host", "main"), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Extractor] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = []
                for page, main in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if main not in known:
                        if len(known) >= 100:
                            known.clear()
                        known[main] = Extractor(main)
                    texts.append(known[main].text(page))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                       pa.array(np.array([len(t) for t in texts], dtype=np.int64))], [id_col, url_col, "text", "n_chars"])

    return rows.select("id", "url", "html", "main").mapInArrow(
        run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_texts(pages, wrappers(pages))
