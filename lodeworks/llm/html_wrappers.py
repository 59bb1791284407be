"""Main text of web pages, by wrappers inferred for each host.

A page is a tree of tags, read as a stream of tokens. A wrapper is a union-free regular expression over such trees:
an element has parts, each an element or a text slot, in order; parts may be optional or repeated, and parts that
change places are one repeated group of optional parts; there are no alternatives. Pages are aligned with it one
after the other: each element of a page meets the part of its name under its parent's part, and widens it: a part
that some parents lack becomes optional, one that comes twice repeated, neighbours in either order a group, texts
that differ a slot. All of this is kept as sums, minima and maxima for each part, and as a set of neighbours, so pages
widen a wrapper in any order alike, in parallel, and a host with a third of all pages never meets in one task.

A page is then matched against its host's wrapper. In an article's element, names alone say what isn't the article.
Outside, a part is the template's if its text is the same on all pages of a host whose pages differ, and a block or a
repeated group is left out if most of its text is links.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import whole

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot body html".split())
DROPPED = frozenset("head nav footer aside form script style noscript template svg button select option textarea input iframe dialog menu object audio video canvas label".split())
#: Words in the class, id or role of an element that holds something other than the article.
NOT_ARTICLE = frozenset("ad ads adv advert adverts advertisement advertising banner banners promo promotion promoted sponsor sponsored sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login search social share sharing sharebar comment comments commentlist respond reply replies disqus related recommended recommendations more widget widgets pagination pager toolbar tags complementary contentinfo skip disclaimer".split())
ARTICLE = frozenset("article content post entry story main maincontent body articlebody".split())
#: Words in a class that turn its meaning round: no-sidebar, has-sidebar. Those of a header are the article's inside it.
NEGATING = frozenset("no not non has with without is hide single open".split())
HEADER = frozenset("header masthead".split())
#: Elements that a paragraph, an item or a cell never reaches out of.
BARRIERS = frozenset("ul ol table div section article body".split())


def name_of(tag: str, attributes: str) -> str:
    """The tag with the tokens of its class, id and role, as words joined by dashes; digits don't tell elements apart."""
    tokens: list[str] = []
    if "=" in attributes:
        for m in _MARK.finditer(attributes):
            for token in (m[2] or m[3] or m[4] or "").split():
                tokens.append("-".join(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())))
    return ".".join([tag, *filter(None, tokens)])


def stream(page: str) -> Iterator[tuple[str, str]]:
    """("open", name), ("close", tag), ("void", tag) and ("text", raw) in page order, with end tags implied."""
    open_: list[str] = []
    times: Counter = Counter()

    def closed(tag: str) -> Iterator[tuple[str, str]]:
        while True:
            last = open_.pop()
            times[last] -= 1
            yield "close", last
            if last == tag:
                return

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                yield "text", raw
            continue
        tag = tag.lower()
        if m[2]:
            if times[tag]:
                yield from closed(tag)
            continue
        if tag in VOID:
            yield "void", tag
            continue
        for ends in ("p",) * (tag in CLOSES_P) + (tag,) * (tag in ("li", "option", "td", "th", "tr", "dd", "dt")):
            if times[ends]:
                for t in reversed(open_):
                    if t == ends:
                        yield from closed(ends)
                        break
                    if t in BARRIERS:
                        break
        if m[4].endswith("/"):
            yield "void", tag
        else:
            open_.append(tag)
            times[tag] += 1
            yield "open", name_of(tag, m[4])
    while open_:
        yield "close", open_.pop()


def _is_marked(name: str, inside: bool) -> bool:
    """Whether a token of the name says that the element holds something other than the article."""
    for token in name.split(".")[1:]:
        words = token.split("-")
        if not NEGATING.intersection(words) and NOT_ARTICLE.difference(HEADER if inside else ()).intersection(words):
            return True
    return False


def _is_article(name: str) -> bool:
    tag, *tokens = name.split(".")
    return tag in ("article", "main") or (tag in ("div", "section", "td") and any(ARTICLE.intersection(t.split("-")) for t in tokens))


class Page:
    """A page's elements, in page order (0 is the root), and its pieces of text: (element, raw), or (-1, "") between
    blocks. dropped and inside say of each element whether it is left out by name, and lies in an article's element."""

    def __init__(self, page: str):
        self.names, self.parents, self.pieces = [""], [-1], []
        stack = [0]
        for kind, x in stream(page):
            if kind == "open":
                if x.split(".", 1)[0] in BLOCKS:
                    self.pieces.append((-1, ""))
                self.names.append(x)
                self.parents.append(stack[-1])
                stack.append(len(self.names) - 1)
            elif kind == "close":
                if x in BLOCKS:
                    self.pieces.append((-1, ""))
                stack.pop()
            elif kind == "text":
                self.pieces.append((stack[-1], x))
            elif x in ("br", "hr"):
                self.pieces.append((stack[-1], "\n"))
        n = len(self.names)
        self.tags = [x.split(".", 1)[0] for x in self.names]
        article = [_is_article(x) for x in self.names]
        sure = self._above_main(article)
        self.dropped, self.inside = [False] * n, [False] * n
        for i in range(1, n):
            p = self.parents[i]
            marked = i not in sure and self.tags[i] not in ("html", "body", "main") and _is_marked(self.names[i], self.inside[p])
            self.dropped[i] = self.dropped[p] or self.tags[i] in DROPPED or marked
            self.inside[i] = self.inside[p] or (article[i] and not self.dropped[i])

    def _above_main(self, article: list[bool]) -> set[int]:
        """The article's element with the most text, and those around it: these aren't left out by their marks."""
        size = [0] * len(self.names)
        for i, raw in self.pieces:
            if i >= 0:
                size[i] += len("".join(raw.split()))
        for i in range(len(size) - 1, 0, -1):
            size[self.parents[i]] += size[i]
        best = max((i for i, x in enumerate(article) if x), key=lambda i: (self.tags[i] == "article", size[i], -i), default=0)
        around = set()
        while best > 0:
            around.add(best)
            best = self.parents[best]
        return around

    def keys(self) -> list[int]:
        """The part of the wrapper that each element meets: a hash of its name under its parent's part."""
        out = [0]
        for name, p in zip(self.names[1:], self.parents[1:], strict=True):
            out.append(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), out[p]))
        return out


def aligned(page: str) -> tuple[dict[int, list], set[tuple[int, int]]]:
    """What a page adds to its host's wrapper: for each part [name, parent, block, elements, parents that have it, pages
    with text, characters, those in links, least and greatest hash of the text], and the neighbours (before, after).

    Texts count that are neither left out by name nor in an article's element, a heading of the page or a title.
    """
    p = Page(page)
    keys = p.keys()
    n = len(keys)
    block, in_link, in_header = [0] * n, [False] * n, [False] * n
    parts: dict[int, list] = {0: ["", 0, 0, 1, 1, 0, 0, 0, 0, 0]}
    last_child, had = [0] * n, set()
    neighbours: set[tuple[int, int]] = set()
    for i in range(1, n):
        up, tag, key = p.parents[i], p.tags[i], keys[i]
        block[i] = key if tag in BLOCKS else block[up]
        in_link[i] = in_link[up] or tag == "a"
        in_header[i] = in_header[up] or tag in ("header", "title")
        part = parts.setdefault(key, [p.names[i], keys[up], block[i], 0, 0, 0, 0, 0, 0, 0])
        part[3] += 1
        if (up, key) not in had:
            had.add((up, key))
            part[4] += 1
        if last_child[up] and last_child[up] != key:
            neighbours.add((last_child[up], key))
        last_child[up] = key
    texts: dict[int, list[str]] = {}
    for i, raw in p.pieces:
        if i < 0 or p.dropped[i] or p.inside[i] or in_header[i]:
            continue
        text = " ".join(raw.split())
        if text:
            part = parts[keys[i]]
            part[6] += len(text)
            part[7] += len(text) * in_link[i]
            texts.setdefault(keys[i], []).append(text)
    for key, found in texts.items():
        parts[key][5] = 1
        parts[key][8] = parts[key][9] = zlib.crc32("\n".join(found).encode("utf-8", "surrogatepass"))
    return parts, neighbours


def widened(a: tuple[dict, set, int], b: tuple[dict, set, int]) -> tuple[dict, set, int]:
    """Two wrappers (parts, neighbours, pages) as one: in any order and grouping the same."""
    parts = {k: list(v) for k, v in a[0].items()}
    for key, v in b[0].items():
        own = parts.get(key)
        if own is None:
            parts[key] = list(v)
            continue
        if v[5]:
            own[8], own[9] = (min(own[8], v[8]), max(own[9], v[9])) if own[5] else (v[8], v[9])
        for k in range(3, 8):
            own[k] += v[k]
    return parts, a[1] | b[1], a[2] + b[2]


def groups(parts: dict[int, list], neighbours: set[tuple[int, int]]) -> dict[int, int]:
    """The group of each part: the least of those that it changes places with, itself at least."""
    after: dict[int, list[int]] = {}
    for a, b in neighbours:
        after.setdefault(a, []).append(b)
    # Strongly connected parts, by Tarjan's algorithm without recursion.
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on, stack, out = set(), [], {}
    for root in sorted(parts):
        if root in index:
            continue
        work = [(root, iter(sorted(after.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(after.get(w, ())))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    at = stack.index(v) if len(stack) < 64 else len(stack) - 1 - stack[::-1].index(v)
                    members = stack[at:]
                    del stack[at:]
                    on.difference_update(members)
                    out.update(dict.fromkeys(members, min(members)))
    return out


def expression(parts: dict[int, list], neighbours: set[tuple[int, int]], pages: int) -> str:
    """A small wrapper as text: names with their parts in brackets, ? optional, + repeated, # a slot, (...)+ a group."""
    group = groups(parts, neighbours)
    children: dict[int, list[int]] = {}
    for key, v in parts.items():
        if key:
            children.setdefault(v[1], []).append(key)
    before = {(group[a], group[b]) for a, b in neighbours if group[a] != group[b]}

    def one(key: int, count: int) -> str:
        v = parts[key]
        inner = [*(["#"] if v[5] else []), *ordered(key)]
        return v[0] + (f"[{' '.join(inner)}]" if inner else "") + "?" * (v[4] < count) + "+" * (v[3] > v[4])

    def ordered(key: int) -> list[str]:
        left = {}
        for k in children.get(key, ()):
            left.setdefault(group[k], []).append(k)
        out = []
        while left:
            ready = [g for g in left if not any((h, g) in before for h in left if h != g)]
            g = min(ready or left, key=lambda g: min(parts[k][0] for k in left[g]))
            members = sorted(left.pop(g), key=lambda k: parts[k][0])
            texts = [one(k, parts[key][3] if key else pages) for k in members]
            out.append(texts[0] if len(texts) == 1 else f"({' '.join(texts)})+")
        return out

    return " ".join(ordered(0))


def kept_parts(parts: dict[int, list], neighbours: set[tuple[int, int]], pages: int) -> list[int]:
    """The parts outside articles whose text is main text: of blocks, and of groups of blocks that change places, in
    which at most half is links and not all is the template's."""
    varies = any(v[8] != v[9] for v in parts.values())
    group = groups(parts, neighbours)
    template = lambda v: varies and v[5] == pages and v[8] == v[9]
    units: dict[int, list[int]] = {}
    for key, v in parts.items():
        if v[6]:
            units.setdefault(group[v[2]], []).append(key)
    out = []
    for own in units.values():
        chars, links = (sum(parts[k][i] for k in own) for i in (6, 7))
        if 2 * links < chars and not all(template(parts[k]) for k in own):
            out += own
    return sorted(out)


def extract(page: str, kept: set[int] | None) -> str:
    """The text of a page, matched against its host's wrapper: blocks in page order, joined by line ends. If any of it
    is in an article's element, only what is; else that of the parts in kept (all, if that is None)."""
    p = Page(page)
    keys = p.keys() if kept is not None and not any(p.inside) else None
    blocks: tuple[list[str], list[str]] = ([], [])  # outside and in an article's element
    now: tuple[list[str], list[str]] = ([], [])

    def end() -> None:
        for some, out in zip(now, blocks, strict=True):
            text = " ".join("".join(some).split())
            if text:
                out.append(text)
            some.clear()

    for i, raw in p.pieces:
        if i < 0:
            end()
        elif raw == "\n":
            now[p.inside[i]].append(raw)
        elif not p.dropped[i] and (p.inside[i] or keys is None or keys[i] in kept):
            now[p.inside[i]].append(html.unescape(raw))
    end()
    return "\n".join(blocks[1] or blocks[0])


_PARTS = pa.schema([("host", pa.string()), ("key", pa.int64()), ("to", pa.int64()), ("name", pa.string()), ("parent", pa.int64()), ("block", pa.int64()), *((c, pa.int64()) for c in ("elements", "parents", "texts", "chars", "links", "low", "high", "pages"))])
_SUMS = ("elements", "parents", "texts", "chars", "links", "pages")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of a task's pages, one row for each part (to is null) and for each pair of neighbours."""
    found: dict[str, tuple[dict, set, int]] = {}
    size = 0

    def packed() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for host, (parts, neighbours, pages) in found.items():
            for key, (name, parent, block, elements, parents, texts, chars, links, low, high) in parts.items():
                rows.append((host, _signed(key), None, name, _signed(parent), _signed(block), elements, parents, texts, chars, links, low if texts else None, high if texts else None, pages if not key else 0))
            rows += [(host, _signed(a), _signed(b), None, None, None, 0, 0, 0, 0, 0, None, None, 0) for a, b in neighbours]
        found.clear()
        for i in range(0, len(rows), 50_000):
            cols = zip(*rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PARTS.types, strict=True)], schema=_PARTS)

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            own = (*aligned(page.as_py()), 1)
            size += len(own[0])
            found[host] = _into(found[host], own) if host in found else own
            if size > 1_000_000:
                yield from packed()
                size = 0
    yield from packed()


def _into(a: tuple[dict, set, int], b: tuple[dict, set, int]) -> tuple[dict, set, int]:
    """widened, in place."""
    for key, v in b[0].items():
        own = a[0].get(key)
        if own is None:
            a[0][key] = v
            continue
        if v[5]:
            own[8], own[9] = (min(own[8], v[8]), max(own[9], v[9])) if own[5] else (v[8], v[9])
        for k in range(3, 8):
            own[k] += v[k]
    a[1].update(b[1])
    return a[0], a[1], a[2] + b[2]


_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
#: Tables of kept parts up to this size are broadcast; larger ones are joined, salted.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, key, to, name, parent, block, sums, low, high) from (host, html): the parts of each host's wrapper, and its
    neighbours (with to)."""
    ddl = "host string, key long, to long, name string, parent long, block long, elements long, parents long, texts long, chars long, links long, low long, high long, pages long"
    rows = pages.select("host", "html").mapInArrow(_infer, ddl)
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return rows.groupBy("host", "key", "to").agg(F.min("name").alias("name"), F.min("parent").alias("parent"), F.min("block").alias("block"), *sums, F.min("low").alias("low"), F.max("high").alias("high"))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rows in batch.column("rows").to_pylist():
            parts = {r["key"]: [r["name"], r["parent"], r["block"], *(r[c] for c in ("elements", "parents", "texts", "chars", "links")), r["low"] or 0, r["high"] or 0] for r in rows if r["to"] is None}
            neighbours = {(r["key"], r["to"]) for r in rows if r["to"] is not None}
            out.append(kept_parts(parts, neighbours, sum(r["pages"] for r in rows)))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.int64()))], names=["host", "slots"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, set[int] | None] = {}
    for batch in batches:
        out: list[str] = []
        for host, page, slots in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("slots"), strict=True):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = {x & (1 << 64) - 1 for x in slots.as_py() or ()} or None
            out.append(extract(page.as_py(), known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], names=["doc", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """pages (url and html are read) without html, with text: the article of each page, empty if none.

    The host is what the url has between :// and the next slash (null and other urls share the host ""). A
    null html is an empty page. Equal pages are read alike, and tell no more of a template than one. Elements of any
    depth are read. Pages without an article's element, of a host whose wrapper keeps no part, give all text that isn't
    excluded by name. A column named text is replaced; all others stay, whatever their names. No pages give no rows.
    """
    from . import shared

    pages = pages.drop("text")
    keep = [c for c in pages.columns if c != "html"]
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    # Other columns travel as one, so that no name of theirs meets ours.
    own = pages.select(host.alias("host"), whole("html").alias("html"), F.struct(*keep).alias("doc"))
    row = F.struct("key", "to", "name", "parent", "block", *_SUMS, "low", "high")
    # As many rows for a host as its wrapper has parts and neighbours, however many pages it has.
    slots = wrappers(own).groupBy("host").agg(F.collect_list(row).alias("rows")).mapInArrow(_decide, "host string, slots array<long>")
    slots = shared.written(slots, "slots")
    size = slots.agg(F.sum(F.length("host") + 8 * F.size("slots"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(slots), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")
        many = slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", salt).join(many, ["host", "salt"], "left").drop("salt")
    kind = own.select("doc").schema.add("text", "string")
    return joined.select("host", "html", "slots", "doc").mapInArrow(_read, kind).select(*[F.col("doc")[c].alias(c) for c in keep], "text")


def query(spark, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
