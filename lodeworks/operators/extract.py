"""Cards of captured result pages to rows: one extractor for each portal, run over Arrow batches.

HTML here is rarely well formed, so Spark's XPath functions can't read it; a small tolerant tree can. Only the
cutting of cards is Python: prices, areas and the rest are mined from the cut texts by Column functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SNIPPET = 300
RAW_CHARS = 2000


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [p for p in reversed(n.parts) if isinstance(p, Node)]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def all(self, tag: str = "", cls: str = "") -> Iterator[Node]:
        for n in self.walk():
            if n is not self and (not tag or n.tag == tag) and (not cls or cls in n.classes()):
                yield n

    def first(self, tag: str = "", cls: str = "") -> Node | None:
        return next(self.all(tag, cls), None)

    def strings(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                if n.strip():
                    yield n.strip()
            elif n.tag not in ("script", "style"):
                todo += reversed(n.parts)

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.now)
        self.now.parts.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.now.parts.append(Node(tag, dict(attrs), self.now))

    def handle_endtag(self, tag):
        n = self.now
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.now = n.parent

    def handle_data(self, data):
        self.now.parts.append(data)


def parse(html: str | None) -> Node:
    """The page as a tree. Marked sections that the parser refuses are read as text."""
    for text in (html or "", (html or "").replace("<![", "&lt;![")):
        b = _Builder()
        try:
            b.feed(text)
            b.close()
        except AssertionError:
            continue
        return b.root
    return Node("", {}, None)


def text_of(card: Node, *classes: str) -> str:
    """The text of the first node with one of the classes, tried in order; empty if none."""
    for cls in classes:
        if (n := card.first(cls=cls)) is not None:
            return n.text()
    return ""


def mined_price(link: Node, levels: int = 4) -> str:
    """The text of the nearest ancestor that holds exactly one euro sign; without one, the widest text reached before
    an ancestor that holds several."""
    n, text = link, link.text()
    for _ in range(levels):
        if text.count("€") == 1 or n.parent is None:
            break
        wider = n.parent.text()
        if wider.count("€") > 1:
            break
        n, text = n.parent, wider
    return text


#: Portals in the order of the crawl, with their sites.
PORTALS = {
    "nehnutelnosti": "https://www.nehnutelnosti.sk",
    "topreality": "https://www.topreality.sk",
    "reality": "https://www.reality.sk",
    "bazos": "https://reality.bazos.sk",
    "byty": "https://www.byty.sk",
}
PROJECT_SITE = "https://www.yimba.sk"

CARD = "raw_id string, url string, title string, price_text string, info_text string, locality_text string, description string, full_text string"


def _card(site: str, link: Node, **k) -> dict:
    href = link.attrs.get("href") or ""
    url = site + href if href.startswith("/") else href
    return {"url": url, "title": link.text(), "raw_id": None, "price_text": "", "info_text": "", "locality_text": "", "description": "", "full_text": ""} | k


def _heading_link(card: Node) -> Node | None:
    h = card.first("h2")
    return next((a for a in h.all("a") if a.attrs.get("href")), None) if h else None


def _any_link(card: Node) -> Node | None:
    """The heading's link, else the first of the card."""
    return _heading_link(card) or next((a for a in card.all("a") if a.attrs.get("href")), None)


def _id_in(pattern: str, url: str) -> str | None:
    m = re.search(pattern, url)
    return m[1] if m else None


#: Fixed patterns: where each site keeps the number of an offer in its address.
BAZOS_ID, DETAIL_ID, REALITY_ID = r"/inzerat/(\d+)", r"/detail/[^\s\"']*?(\d{5,})", r"[-/](\d{4,})/?$"
TOPREALITY_ID, BYTY_ID = r"[-/](\d{4,})(?:\.html)?/?$", r"/(\d{5,})(?:[/?-]|\.html|$)"


def each(nodes: Iterator[Node], cut: Callable[[Node], dict | None]) -> Iterator[dict]:
    """What is cut from the nodes that are cards. One that can't be cut gives its error, and the others go on."""
    for node in nodes:
        try:
            card = cut(node)
        except Exception as e:  # noqa: BLE001  whatever a site's markup leads to
            card = {"error": f"{type(e).__name__}: {e}"}
        if card is not None:
            yield card


def bazos_cards(root: Node) -> Iterator[dict]:
    def cut(card: Node) -> dict | None:
        if not (link := _heading_link(card)):
            return None
        c = _card(PORTALS["bazos"], link, price_text=text_of(card, "inzeratycena"), locality_text=text_of(card, "inzeratylok"), description=text_of(card, "popis"))
        return c | {"raw_id": _id_in(BAZOS_ID, c["url"]), "info_text": f"{c['title']} {c['description']}", "full_text": card.text()}

    return each(root.all("div", "inzeraty"), cut)


def nehnutelnosti_cards(root: Node) -> Iterator[dict]:
    def cut(card: Node) -> dict | None:
        if not (link := _any_link(card)):
            return None
        part = lambda x: text_of(card, f"advertisement-item--content__{x}")
        info = part("info")
        return _card(PORTALS["nehnutelnosti"], link, raw_id=card.attrs.get("data-id"), price_text=part("price"), info_text=info, locality_text=part("locality"), description=part("description") or info, full_text=card.text())

    known = list(root.all("div", "advertisement-item"))
    return each(iter(known), cut) if known else detail_links(root)


def detail_links(root: Node) -> Iterator[dict]:
    """Anchors to detail pages, for pages whose cards aren't recognised; the first of each url counts."""
    seen = set()

    def cut(a: Node) -> dict | None:
        number = _id_in(DETAIL_ID, a.attrs.get("href") or "")
        c = _card(PORTALS["nehnutelnosti"], a)
        url = c["url"].split("?")[0]
        if not number or url in seen:
            return None
        seen.add(url)
        mined = mined_price(a)
        if not (c["title"] or mined):
            return None
        return c | {"url": url, "raw_id": number, "title": c["title"] or mined[:100], "price_text": mined if "€" in mined else "", "info_text": mined, "description": mined, "full_text": mined}

    return each(root.all("a"), cut)


def reality_cards(root: Node) -> Iterator[dict]:
    def cut(card: Node) -> dict | None:
        link = _heading_link(card) or next((x for x in card.all("a", "offer__title") if x.attrs.get("href")), None) or _any_link(card)
        if not link:
            return None
        params = text_of(card, "offer__params")
        c = _card(PORTALS["reality"], link, price_text=text_of(card, "offer__price"), info_text=params, locality_text=text_of(card, "offer__address"), description=text_of(card, "offer__description") or params, full_text=card.text())
        return c | {"raw_id": card.attrs.get("data-id") or _id_in(REALITY_ID, c["url"])}

    return each((n for n in root.walk() if n.tag in ("article", "div") and "offer" in n.classes()), cut)


def topreality_cards(root: Node) -> Iterator[dict]:
    def cut(card: Node) -> dict | None:
        if not (link := _any_link(card)):
            return None
        either = lambda x: text_of(card, x) or text_of(card, f"estate__{x}")
        params = either("params")
        c = _card(PORTALS["topreality"], link, price_text=text_of(card, "price"), info_text=params, locality_text=either("locality"), description=text_of(card, "description") or params, full_text=card.text())
        return c | {"raw_id": _id_in(TOPREALITY_ID, c["url"])}

    return each(root.all("div", "estate"), cut)


def byty_cards(root: Node) -> Iterator[dict]:
    site, seen = PORTALS["byty"], set()

    def cut(a: Node) -> dict | None:
        href = a.attrs.get("href") or ""
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            return None
        url = (site + href if href.startswith("/") else href).split("?")[0].rstrip("/")
        number = _id_in(BYTY_ID, href) if url.startswith(site) else None
        title = a.text()
        if not number or len(title) < 5 or url in seen:
            return None
        seen.add(url)
        mined = mined_price(a)
        return _card(site, a) | {"url": url, "raw_id": number, "price_text": mined if "€" in mined else "", "info_text": mined or title, "description": mined, "full_text": mined or title}

    return each(root.all("a"), cut)


EXTRACTORS: dict[str, Callable[[Node], Iterator[dict]]] = {"nehnutelnosti": nehnutelnosti_cards, "topreality": topreality_cards, "reality": reality_cards, "bazos": bazos_cards, "byty": byty_cards}

_NAMES = [f.split()[0] for f in CARD.split(", ")]


def cut_cards(pages: DataFrame) -> DataFrame:
    """(portal, page_no, card_pos, the columns of CARD, error) for each card of captured pages (portal, page_no,
    html). Unknown portals, junk and null pages give none; a card that can't be cut has nothing but its error."""

    names = [*_NAMES, "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for portal, page, html in zip(*(batch.column(n).to_pylist() for n in ("portal", "page_no", "html")), strict=True):
                of_portal = EXTRACTORS.get(portal)
                if of_portal and html:
                    rows += [(portal, page, i, *(c.get(n) for n in names)) for i, c in enumerate(of_portal(parse(html)))]
            cols = list(zip(*rows, strict=True)) or [[]] * (3 + len(names))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["portal", "page_no", "card_pos", *names])

    return pages.select("portal", F.col("page_no").cast("int").alias("page_no"), "html").mapInArrow(run, f"portal string, page_no int, card_pos int, {CARD}, error string")


def cards(pages: DataFrame) -> DataFrame:
    """The cards of `cut_cards` that could be cut."""
    return cut_cards(pages).where("error IS NULL").drop("error")


def broken_cards(pages: DataFrame) -> DataFrame:
    """(portal, n): how many cards couldn't be cut."""
    return cut_cards(pages).where("error IS NOT NULL").groupBy("portal").agg(F.count(F.lit(1)).alias("n"))


#: Portals whose facts may stand anywhere on the card, and those that name no place of their own.
ANYWHERE, GUESSED = ("reality", "topreality"), ("reality", "topreality", "byty")


def listings(cut: DataFrame) -> DataFrame:
    """Cards to listing rows, with nulls for what can't be parsed."""
    c = F.col
    anywhere = c("portal").isin(*ANYWHERE)
    mined = F.concat_ws(" ", "title", "info_text", "description", F.when(anywhere, c("full_text")))
    norm = T.normalise(mined)
    street, district = T.split_locality(c("locality_text"))
    whole_locality = F.when(c("locality_text") != "", c("locality_text"))
    is_bazos = c("portal") == "bazos"
    area = F.coalesce(T.area(c("info_text")), T.area(c("title")), F.when(anywhere, T.area(c("full_text"))))
    price = F.coalesce(T.price(F.when(c("price_text") != "", c("price_text"))), F.when(anywhere & F.contains("full_text", F.lit("€")), T.price(c("full_text"))))
    raw = F.create_map(F.lit("locality"), "locality_text", F.lit("info"), F.left("info_text", F.lit(RAW_CHARS)), F.lit("card_text"), F.when(c("portal") != "nehnutelnosti", F.left("full_text", F.lit(RAW_CHARS))))
    return cut.select(
        T.listing_id(c("portal"), c("raw_id"), c("url")).alias("id"),
        "portal", "url", "title", price.alias("price_eur"), area.alias("area_m2"), T.rooms(norm).alias("rooms"),
        F.when(~is_bazos, street).alias("street"),
        F.coalesce(F.when(is_bazos, whole_locality).otherwise(district), F.when(c("portal").isin(*GUESSED), T.guess_locality(norm))).alias("district"),
        T.floor_of(norm).alias("floor"), T.condition(norm).alias("condition"), T.balcony(norm).alias("balcony"),
        F.left(F.coalesce("description", F.lit("")), F.lit(SNIPPET)).alias("description_snippet"),
        F.map_filter(raw, lambda _, v: v != "").alias("raw"),
        "page_no", "card_pos",
    )


def record() -> Column:
    """A listing as an ordered record, with its price per square metre."""
    c = F.col
    names = ["id", "portal", "url", "title", "price_eur", "area_m2", "price_per_m2", "rooms", "street", "district", "floor", "condition", "balcony", "description_snippet", "first_seen", "raw_extra"]
    made = {"price_per_m2": T.price_per_m2(c("price_eur"), c("area_m2")), "raw_extra": c("raw")}
    return F.struct(*[made.get(n, c(n)).alias(n) for n in names])


def record_json() -> Column:
    """record() as JSON text, unknown values as null."""
    return F.to_json(record(), {"ignoreNullFields": "false"})


def is_usable() -> Column:
    return F.coalesce(F.col("price_eur").cast("string"), F.col("area_m2").cast("string"), F.col("rooms")).isNotNull()


def project_cards(root: Node) -> Iterator[dict]:
    seen = set()

    def cut(card: Node) -> dict | None:
        h = card.first("h3")
        link = next((a for n in (h, card) if n is not None for a in n.all("a") if a.attrs.get("href")), None)
        if link is None:
            return None
        url = urljoin(PROJECT_SITE, link.attrs["href"])
        slug = url.split("?")[0].rstrip("/").rsplit("/", 1)[-1]
        if not slug or slug in seen:
            return None
        seen.add(slug)
        image = card.first("img")
        m = re.search(r"/upload/Projekty/([^/]+)/", image.attrs.get("src") or "", re.I) if image else None
        status = next((x for x in card.classes() if x != "project-list-result"), "unknown")
        return {"slug": slug, "name": link.text() or (h.text() if h else "") or slug, "url": url, "status": status, "district": (unquote(m[1]) or None) if m else None}

    return each(root.all("div", "project-list-result"), cut)


def projects(pages: DataFrame) -> DataFrame:
    """(slug, name, url, status, district) of captured project lists (html); the first card of a slug on a page. Cards
    that can't be cut are left out."""
    names = ["slug", "name", "url", "status", "district"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tuple(c[n] for n in names) for html in batch.column("html").to_pylist() if html for c in project_cards(parse(html)) if "error" not in c]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)

    return pages.select("html").mapInArrow(run, ", ".join(f"{n} string" for n in names))


#: The project site's own words for the class of a card.
STATUS_LABELS = {"intention": "Zámer", "construction": "Výstavba", "success": "Zrealizované", "cancelled": "Pozastavené / Zrušené"}


def status_label(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(table[status], status)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, href, title): the anchors of each page with text, the first of each href."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                seen: dict[str, str] = {}
                for a in parse(html).all("a"):
                    if a.attrs.get("href") and (t := a.text()):
                        seen.setdefault(a.attrs["href"], t)
                rows += [(page_id, h, t) for h, t in seen.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "href", "title"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, href string, title string")
