"""Captured result pages: where they come from, and which of them count.

There is no live crawling here. A page is a row (portal, page_no, url, status, html); `PageSource` reads such
rows from any fetcher as a Spark data source, one partition for each portal, and the rest are plain filters.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.extract import PORTALS, PROJECT_SITE

MOST_PAGES = 3
BAZOS_PAGE_SIZE = 20
HEAD_CHARS = 4000
SCHEMA = "portal string, page_no int, url string, status int, html string"

#: What a page that blocks robots says near its top.
CHALLENGES = ("just a moment", "cf-browser-verification", "cf_chl_", "attention required", "captcha", "access denied")
BLOCKED = (403, 429, 503)
#: Of our own, in the place of an HTTP status.
DISALLOWED, UNREACHABLE = -1, -2


def is_challenge(html: Column) -> Column:
    head = F.lower(F.left(html, F.lit(HEAD_CHARS)))
    out = F.lit(False)
    for marker in CHALLENGES:
        out = out | F.contains(head, F.lit(marker))
    return F.coalesce(out, F.lit(False))


def page_error() -> Column:
    """Why a page can't be used, or null."""
    status = F.col("status")
    ours = F.when(status == DISALLOWED, F.lit("disallowed by robots.txt")).when(status == UNREACHABLE, F.lit("request failed"))
    return ours.when(status.isin(*BLOCKED), F.concat(F.lit("blocked: HTTP "), status.cast("string"))).when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).when(is_challenge(F.col("html")), F.lit("challenge page"))


def usable_pages(pages: DataFrame) -> DataFrame:
    """The pages of portals none of whose first MOST_PAGES pages failed: one failure loses the portal's run."""
    own = pages.where(F.col("page_no") <= MOST_PAGES).withColumn("error", page_error())
    failed = own.where("error IS NOT NULL").select("portal").distinct()
    return own.join(failed, "portal", "left_anti").drop("error")


def failed_portals(pages: DataFrame) -> DataFrame:
    """(portal, error): the error of the first failing page."""
    own = pages.where(F.col("page_no") <= MOST_PAGES).withColumn("error", page_error()).where("error IS NOT NULL")
    return own.groupBy("portal").agg(F.min_by("error", "page_no").alias("error"))


def paged(found: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Rows (portal, page_no, id) that a page loop keeps: those of the page where an id first comes, repeats within
    it included, up to the first page that brings nothing new (or the last allowed)."""
    first = F.min("page_no").over(Window.partitionBy("portal", "id"))
    new = found.where(F.col("page_no") <= most).withColumn("is_new", F.col("page_no") == first)
    by_page = new.groupBy("portal", "page_no").agg(F.max("is_new").alias("any_new"))
    going = F.min("any_new").over(Window.partitionBy("portal").orderBy("page_no"))
    before = Window.partitionBy("portal").orderBy("page_no")
    # A page that is missing ends the loop as well.
    open_ = by_page.withColumn("going", going & (F.col("page_no") == F.row_number().over(before))).where("going").select("portal", "page_no")
    return new.where("is_new").join(open_, ["portal", "page_no"], "left_semi").drop("is_new")


def search_url(portal: str, rules: dict, page: int) -> str:
    """The address of a result page; bazos also takes the price limit."""
    search, filters = rules.get("search") or {}, rules.get("filters") or {}
    city = search.get("city", "Bratislava")
    site, lower = PORTALS[portal], city.lower()
    more = lambda name: f"?{name}={page}" if page > 1 else ""
    if portal == "nehnutelnosti":
        return f"{site}/{lower}/byty/predaj/{more('p[page]')}"
    if portal == "topreality":
        return f"{site}/vyhladavanie-nehnutelnosti-{page}.html?{urlencode({'searchType': 'string', 'q': city})}"
    if portal == "reality":
        return f"{site}/byty/{lower}/predaj/{more('page')}"
    if portal == "bazos":
        query = {"hledat": city} | ({"cenado": int(filters["max_price_eur"])} if filters.get("max_price_eur") else {})
        skip = f"{(page - 1) * BAZOS_PAGE_SIZE}/" if page > 1 else ""
        return f"{site}/predam/byt/{skip}?{urlencode(query)}"
    return f"{site}/byty/predaj/{lower}{more('strana')}"


def project_list_url(rules: dict) -> str:
    """The project list by type (none if it is empty) and districts."""
    p = rules.get("projects") or {}
    kind = p.get("type", "Bývanie")
    pairs = [("type", kind)] * bool(kind) + [("district[]", d) for d in p.get("districts") or ("downtown", "ruzinov", "stare-mesto")]
    return f"{PROJECT_SITE}/zoznam-projektov?{urlencode(pairs, quote_via=quote)}"


def robots_allow(url: str, robots_txt: str | None, agent: str = "*") -> bool:
    """Whether robots.txt allows the url; one that can't be had (None) allows everything."""
    if robots_txt is None:
        return True
    parser = RobotFileParser()
    parser.parse(robots_txt.splitlines())
    return parser.can_fetch(agent, url)


class PoliteFetcher:
    """fetch(portal, page) for `page_source`: asks robots.txt once for each site (what can't be had allows all), waits
    between the requests to a site, never before the first, and gives up on a request after a while.

    get(url, timeout) -> (status, text), or raises; sleep and draw (of seconds between two bounds) can be replaced.
    """

    def __init__(self, get: Callable[[str, float], tuple[int, str]], rules: dict, delay: tuple[float, float] = (3.0, 6.0), timeout: float = 30.0, agent: str = "*", sleep: Callable[[float], None] = time.sleep, draw: Callable[[float, float], float] = random.uniform):
        self.get, self.rules, self.delay, self.timeout, self.agent, self.sleep, self.draw = get, rules, delay, timeout, agent, sleep, draw
        self.robots: dict[str, str | None] = {}
        self.asked: dict[str, int] = {}

    def _robots(self, site: str) -> str | None:
        if site not in self.robots:
            try:
                status, text = self.get(f"{site}/robots.txt", self.timeout)
                self.robots[site] = text if status == 200 else None
            except Exception:  # noqa: BLE001  whatever a client raises
                self.robots[site] = None
        return self.robots[site]

    def page(self, url: str) -> tuple[int, str]:
        site = "/".join(url.split("/")[:3])
        if not robots_allow(url, self._robots(site), self.agent):
            return DISALLOWED, ""
        if self.asked.get(site):
            self.sleep(self.draw(*self.delay))
        self.asked[site] = self.asked.get(site, 0) + 1
        try:
            return self.get(url, self.timeout)
        except Exception:  # noqa: BLE001
            return UNREACHABLE, ""

    def __call__(self, portal: str, page: int) -> tuple[str, int, str]:
        url = search_url(portal, self.rules, page)
        return (url, *self.page(url))


class _Portal(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, fetch: Callable[[str, int], tuple[str, int, str] | None]):
        self.fetch = fetch

    def partitions(self):
        return [_Portal(p) for p in PORTALS]

    def read(self, partition) -> Iterator[tuple]:
        for page in range(1, MOST_PAGES + 1):
            got = self.fetch(partition.value, page)
            if got is None:
                return
            yield (partition.value, page, *got)


def page_source(fetch: Callable[[str, int], tuple[str, int, str] | None]) -> type[DataSource]:
    """A data source named captured_pages over fetch(portal, page) -> (url, status, html), or None at the end."""

    class PageSource(DataSource):
        @classmethod
        def name(cls):
            return "captured_pages"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Reader(fetch)

    return PageSource
