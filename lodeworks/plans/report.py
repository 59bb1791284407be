"""Ranked reports as strings made of columns, and the publishers that take them.

A report's rows are capped before they meet in one string, so what is gathered is bounded; only counts cover
the whole run.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.extract import status_label

MOST_ISSUES = MOST_IN_MESSAGE = 20
MESSAGE_CHARS = 4096
MOST_TITLES = 1000

# Fixed values throughout this module: the sentences, headings and label texts of reports and messages.

#: Label -> (colour, description).
LABELS = {
    "hot": ("E11D48", "High-scoring listing"),
    "interesting": ("F59E0B", "Mid-scoring listing"),
    "match": ("22C55E", "Listing passed all hard filters"),
    "price-drop": ("3B82F6", "Previously seen listing whose price moved >2%"),
    "scraper-broken": ("6B7280", "Portal returned 0 listings for 3 consecutive runs"),
    "digest": ("8B5CF6", "One run's new matches, collected into a single issue"),
    "new-project": ("0EA5E9", "New or re-staged development project on YIM.BA"),
}
#: For labels that have no entry of their own.
DEFAULT_LABEL = ("BFDBFE", "Label of a run")


def ranked(items: DataFrame) -> DataFrame:
    """Adds rank, by score from the highest; the crawl's order (seq) breaks ties."""
    return items.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("seq"))))


def top(items: DataFrame, most: int = MOST_ISSUES) -> DataFrame:
    """The first rows by score and crawl order, ranked. Only these are ranked: the sort is a bounded top-k."""
    return ranked(items.orderBy(F.col("score").desc(), F.col("seq")).limit(most))


def _area(unit: str, unknown: str) -> Column:
    a = F.col("area_m2")
    return F.when(a != 0, F.concat(T.general(a), F.lit(f" {unit}"))).otherwise(F.lit(unknown))


def _first_text(*names: str, unknown: str) -> Column:
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names], F.lit(unknown))


def _price(unknown: str = "? €") -> Column:
    old, new = F.col("price_change.old"), F.col("price_change.new")
    return F.when(F.col("price_change").isNotNull(), F.concat(T.money(new, unknown), F.lit(" (was "), T.money(old, unknown), F.lit(")"))).otherwise(T.money(F.col("price_eur"), unknown))


def issue_title() -> Column:
    c = F.col
    return F.concat(F.lit("["), c("score").cast("string"), F.lit("] "), T.money(c("price_eur")), F.lit(" | "), _area("m²", "? m²"), F.lit(" | "), _first_text("street", "district", unknown="?"), F.lit(" | "), c("portal"))


def issue_body() -> Column:
    c, lit = F.col, F.lit
    ppm2 = T.price_per_m2(c("price_eur"), c("area_m2"))
    fields = [
        ("Portal", c("portal")), ("Price", T.money(c("price_eur"))), ("Area", _area("m²", "-")),
        ("Price / m²", F.when(ppm2 != 0, F.concat(T.general(ppm2), lit(" €"))).otherwise(lit("-"))),
        ("Rooms", T.or_dash(c("rooms"))), ("Street", T.or_dash(c("street"))), ("District", T.or_dash(c("district"))), ("Floor", T.or_dash(c("floor"))),
        ("Condition", c("condition")), ("Balcony", T.yes_no(c("balcony"))), ("Parking", T.yes_no(c("ai.parking"))), ("First seen", T.or_dash(c("first_seen"))),
    ]
    old, new = c("price_change.old"), c("price_change.new")
    banner = F.when(c("price_change").isNotNull(), F.concat(lit("**Price "), F.when(new < old, lit("dropped")).otherwise(lit("rose")), lit(": "), T.money(old), lit(" -> "), T.money(new), lit("**\n")))
    breakdown = F.when(F.size("breakdown") > 0, F.concat(lit("\nScore breakdown:\n"), F.array_join(F.transform("breakdown", lambda x: F.concat(lit("- "), x)), "\n")))
    flags = F.when(F.size("ai.red_flags") > 0, F.concat(lit("\n**Red flags:** "), F.array_join("ai.red_flags", ", ")))
    detail = F.coalesce(F.when(c("ai.summary") != "", c("ai.summary")), F.when(c("description_snippet") != "", c("description_snippet")))
    quote = F.concat(lit("\n> "), F.translate(detail, "\n", " "))
    table = [F.concat(lit(f"| {n} | "), v, lit(" |")) for n, v in fields]
    return F.concat_ws("\n", F.concat(lit("### ["), c("title"), lit("]("), c("url"), lit(")\n")), banner, lit("| Field | Value |\n| --- | --- |"), *table, F.concat(lit("\n**Score: "), c("score").cast("string"), lit("**")), breakdown, flags, quote, F.concat(lit("\nLink: "), c("url")))


def digest_row() -> Column:
    c = F.col
    parts = [c("score").cast("string"), _price(), _area("m²", "-"), T.or_dash(c("rooms")), _first_text("street", "district", unknown="-"), c("condition"), c("portal"), F.concat(F.lit("[open]("), c("url"), F.lit(")"))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def overflow_row() -> Column:
    c = F.col
    return F.concat(F.lit("| "), F.concat_ws(" | ", c("score").cast("string"), F.concat(F.lit("["), c("title"), F.lit("]("), c("url"), F.lit(")")), T.money(c("price_eur")), _area("m²", "-")), F.lit(" |"))


def archive_row(logged: Column) -> Column:
    c = F.col
    title = T.cell(c("title"))
    link = F.concat(F.lit("["), F.when(title != "", title).otherwise(F.lit("listing")), F.lit("]("), c("url"), F.lit(")"))
    rooms = F.coalesce(F.when(c("rooms") != "", c("rooms")), F.lit("-"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", logged, c("score").cast("string"), _price("-"), _area("m²", "-"), rooms, T.cell(_first_text("street", "district", unknown="-")), c("condition"), c("portal"), link), F.lit(" |"))


ARCHIVE_HEADER = "| Logged | Score | Price | Area | Rooms | Address | Condition | Portal | Listing |\n| --- | ---: | ---: | ---: | :---: | --- | --- | --- | --- |"


def message_block() -> Column:
    c = F.col
    rooms = F.when(c("rooms") != "", F.concat(c("rooms"), F.lit(" rooms"))).otherwise(F.lit("? rooms"))
    head = F.concat(F.lit("\n["), c("score").cast("string"), F.lit("] "), F.concat_ws(" | ", _price(), _area("m2", "? m2"), rooms, _first_text("street", "district", unknown="?"), c("portal")))
    return F.concat_ws("\n", head, F.when(c("ai.summary") != "", c("ai.summary")), c("url"))


def _joined(rows: DataFrame, line: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")


def digest(items: DataFrame, date: str) -> DataFrame:
    """One row (title, body, label): the run's table. Every match is a line of it, as the report is one text."""
    n = F.count(F.lit(1)).cast("string")
    head = F.concat(F.lit("**"), n, F.lit(" new matching flat(s)** this run, highest score first.\n\n| Score | Price | Area | Rooms | Address | Condition | Portal | Link |\n| ---: | ---: | ---: | :---: | --- | --- | --- | --- |\n"))
    rows = ranked(items)
    out = rows.agg(F.concat(n, F.lit(f" new Bratislava flat(s) - {date}")).alias("title"), F.concat(head, _joined(rows, digest_row()), F.lit("\n\nEdit `rules.yaml` to tune matches.")).alias("body"))
    return out.withColumn("label", F.lit("digest"))


def issues(items: DataFrame) -> DataFrame:
    """(title, body, labels) of the first MOST_ISSUES by rank."""
    return top(items).orderBy("rank").select(issue_title().alias("title"), issue_body().alias("body"), "labels")


def overflow(items: DataFrame) -> DataFrame:
    """One row (body, n) for the listings beyond the first MOST_ISSUES; n is 0 if there are none."""
    head = f"This run matched more than {MOST_ISSUES} listings, which usually means\nthe filters in `rules.yaml` are too loose. The overflow is listed below instead\nof opening one Issue each.\n\n| Score | Listing | Price | Area |\n| --- | --- | --- | --- |\n"
    rest = ranked(items).where(F.col("rank") > MOST_ISSUES)
    return rest.agg(F.concat(F.lit(head), _joined(rest, overflow_row())).alias("body"), F.count(F.lit(1)).alias("n"))


def message(items: DataFrame, date: str) -> DataFrame:
    """One row (text): the short message, with MOST_IN_MESSAGE blocks and the number of the others."""
    blocks = top(items, MOST_IN_MESSAGE)
    shown = blocks.agg(_joined(blocks, message_block()).alias("blocks"), F.lit(1).alias("k"))
    counted = items.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("k"))
    more = F.when(F.col("n") > MOST_IN_MESSAGE, F.concat(F.lit("\n...and "), (F.col("n") - MOST_IN_MESSAGE).cast("string"), F.lit(" more (see the GitHub issue).")))
    text = F.concat_ws("\n", F.concat(F.col("n").cast("string"), F.lit(f" new Bratislava flat(s) - {date}")), F.when(F.col("blocks") != "", F.col("blocks")), more)
    return shown.join(counted, "k").select(T.truncated(text, MESSAGE_CHARS).alias("text"))


def _status(change: str = " -> ") -> Column:
    c = F.col
    return F.when(c("previous_status").isNull(), status_label(c("status"))).otherwise(F.concat(status_label(c("previous_status")), F.lit(change), status_label(c("status"))))


def project_row() -> Column:
    c = F.col
    what = F.when(c("previous_status").isNull(), F.lit("new")).otherwise(F.lit("changed"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", what, F.concat(F.lit("["), c("name"), F.lit("]("), c("url"), F.lit(")")), T.or_dash(c("district")), _status()), F.lit(" |"))


def project_report(updates: DataFrame, date: str) -> DataFrame:
    """One row (title, body, label) for project updates with seq."""
    new = F.count_if(F.col("previous_status").isNull())
    changed = F.count_if(F.col("previous_status").isNotNull())
    parts = F.concat_ws(", ", F.when(new > 0, F.concat(new.cast("string"), F.lit(" new project(s)"))), F.when(changed > 0, F.concat(changed.cast("string"), F.lit(" status change(s)"))))
    head = "New and re-staged Bratislava development projects in your watched districts, from [YIM.BA](https://www.yimba.sk/zoznam-projektov).\n\n| What | Project | District | Status |\n| --- | --- | --- | --- |\n"
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", project_row().alias("line")))), lambda x: x["line"]), "\n")
    tail = "\n\nTurn this off with `projects.enabled: false` in `rules.yaml`."
    return updates.agg(F.concat(F.lit("Development watch: "), parts, F.lit(f" - {date}")).alias("title"), F.concat(F.lit(head), lines, F.lit(tail)).alias("body")).withColumn("label", F.lit("new-project"))


def project_message(updates: DataFrame, date: str) -> DataFrame:
    """One row (text) with the first MOST_IN_MESSAGE updates by seq."""
    c = F.col
    place = _first_text("district", unknown="?")
    head = F.when(c("previous_status").isNull(), F.concat(F.lit("NEW: "), c("name"), F.lit(" | "), place, F.lit(" | "), status_label(c("status")))).otherwise(F.concat(c("name"), F.lit(" | "), place, F.lit(" | "), _status()))
    block = F.concat(F.lit("\n"), head, F.lit("\n"), c("url"))
    shown = updates.orderBy("seq").limit(MOST_IN_MESSAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", block.alias("line")))), lambda x: x["line"]), "\n").alias("blocks"), F.lit(1).alias("k"))
    counted = updates.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("k"))
    more = F.when(c("n") > MOST_IN_MESSAGE, F.concat(F.lit("\n...and "), (c("n") - MOST_IN_MESSAGE).cast("string"), F.lit(" more (see the GitHub issue).")))
    text = F.concat_ws("\n", F.concat(c("n").cast("string"), F.lit(f" development project update(s) - {date}")), F.when(c("blocks") != "", c("blocks")), more)
    return shown.join(counted, "k").select(T.truncated(text, MESSAGE_CHARS).alias("text"))


def label_rows(used: DataFrame, default: tuple[str, str] = DEFAULT_LABEL) -> DataFrame:
    """(label, colour, description) of labels in use; those without an entry get the default."""
    spark = used.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in LABELS.items()], "label string, colour string, description string")
    j = used.select("label").distinct().join(F.broadcast(table), "label", "left")
    return j.select("label", F.coalesce("colour", F.lit(default[0])).alias("colour"), F.coalesce("description", F.lit(default[1])).alias("description"))


def unreported(alerts: DataFrame, open_titles: DataFrame) -> DataFrame:
    """Alerts (portal, ...) without an open alert (title) that names the portal. Open alerts are those of a page
    that the service lists, MOST_TITLES at most; they are read and become conditions."""
    titles = [r[0] for r in open_titles.select("title").where("title IS NOT NULL").distinct().limit(MOST_TITLES + 1).collect()]
    if len(titles) > MOST_TITLES:
        raise ValueError(f"there are more than {MOST_TITLES} open alerts")
    return alerts.where(~F.exists(F.array(*map(F.lit, titles)), lambda t: F.contains(t, F.col("portal")))) if titles else alerts


class Publisher(Protocol):
    """Where reports go. Implementations swallow failures and say so by returning None or False."""

    def create_issue(self, title: str, body: str, labels: list[str]) -> int | None: ...

    def ensure_labels(self, labels: list[tuple[str, str, str]]) -> None: ...

    def open_titles(self, label: str) -> list[str]: ...

    def send_message(self, text: str) -> bool: ...


class Recorder:
    """A publisher that keeps what it is given; for tests and dry runs."""

    def __init__(self, open_titles: list[str] | None = None):
        self.issues: list[tuple[str, str, list[str]]] = []
        self.labels: dict[str, tuple[str, str]] = {}
        self.messages: list[str] = []
        self._open = open_titles or []

    def create_issue(self, title: str, body: str, labels: list[str]) -> int | None:
        self.issues.append((title, body, labels))
        return len(self.issues)

    def ensure_labels(self, labels: list[tuple[str, str, str]]) -> None:
        self.labels |= {n: (c, d) for n, c, d in labels if n not in self.labels}

    def open_titles(self, label: str) -> list[str]:
        return self._open

    def send_message(self, text: str) -> bool:
        self.messages.append(text)
        return True
