"""One run: captured pages to classified, filtered, scored listings, new state and reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich, extract, rules as R, state as S
from ..sources import pages as P
from . import report

#: Positions in the order of the crawl.
ORDER = {p: i for i, p in enumerate(extract.PORTALS)}


@dataclass
class Run:
    items: DataFrame  # what is reported, with score, breakdown, labels, price_change, seq
    dropped: DataFrame  # (label, n)
    state: dict[str, DataFrame]
    alerts: DataFrame
    project_updates: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        for df in self.held:
            df.unpersist()


def crawl(pages: DataFrame) -> DataFrame:
    """Usable listings of captured pages, in crawl order (seq): portal, page, card."""
    cut = extract.listings(extract.cards(P.usable_pages(pages)))
    kept = P.paged(cut).where(extract.is_usable())
    position = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("portal")]
    return kept.withColumn("seq", position.cast("bigint") * 10**12 + F.col("page_no").cast("bigint") * 10**6 + F.col("card_pos"))


def unseen(pages: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """The listings of captured pages that a run would report or drop: those that are new or have a new price."""
    found = crawl(pages).withColumn("fingerprint", T.fingerprint(F.col("portal"), F.col("title"), F.col("area_m2"), F.col("rooms")))
    return S.classify(found, state["listings"], state["content"]).where("status <> 'seen'")


def run(pages: DataFrame, project_pages: DataFrame | None, state: dict[str, DataFrame], rules: Mapping, today: str, answers: DataFrame | None = None) -> Run:
    """today is the run's date as text; answers (id, json) are an enrichment provider's, if there is one.

    The classified listings are persisted: state, items and counts all read them. close() the result when its
    frames have been written.
    """
    day = F.lit(today).cast("date")
    found = crawl(pages).withColumn("fingerprint", T.fingerprint(F.col("portal"), F.col("title"), F.col("area_m2"), F.col("rooms")))
    classified = S.classify(found, state["listings"], state["content"])
    if answers is not None:
        rich = enrich.merge(classified.where("status <> 'seen'"), answers)
        classified = rich.unionByName(classified.where("status = 'seen'"), allowMissingColumns=True)
        classified = classified.withColumn("fingerprint", T.fingerprint(F.col("portal"), F.col("title"), F.col("area_m2"), F.col("rooms")))
    else:
        classified = classified.withColumn("ai", F.lit(None).cast("struct<parking:boolean,terrace:boolean,year_built:int,is_new_development:boolean,red_flags:array<string>,summary:string>"))
    classified = classified.persist(StorageLevel.MEMORY_AND_DISK_2)
    listings, content = S.remember(classified, state["listings"], state["content"], day)
    judged = R.hard_filter(classified.where("status <> 'seen'"), rules)
    passed = R.scored(judged.where("drop_code IS NULL"), rules)
    kept = passed.where(F.col("score") >= R.min_score(rules))
    change = F.when((F.col("status") == "price_change") & (F.col("previous_price") != 0) & (F.col("price_eur") != 0), F.struct(F.col("previous_price").alias("old"), F.col("price_eur").alias("new")))
    labels = F.when(change.isNotNull(), F.array_append("labels", F.lit("price-drop"))).otherwise(F.col("labels"))
    items = kept.withColumn("labels", labels).withColumn("price_change", change).withColumn("first_seen", F.coalesce("known_since", day))
    counts = classified.groupBy("portal").agg(F.count(F.lit(1)).alias("n"))
    ran = pages.select("portal").distinct().join(P.failed_portals(pages), "portal", "left").join(counts, "portal", "left")
    runs = ran.select("portal", F.coalesce("n", F.lit(0)).cast("int").alias("count"), "error", day.cast("timestamp_ntz").alias("at"))
    health = S.record_health(runs, state["health"])
    spark = pages.sparkSession
    wanted = rules.get("projects") or {}
    if project_pages is not None and wanted.get("enabled", True):
        listed = extract.projects(project_pages)
        updates = S.project_updates(listed, state["projects"], wanted.get("statuses"), seeding=state["projects"].isEmpty())
        projects = S.remember_projects(listed, state["projects"], day)
    else:
        updates, projects = spark.createDataFrame([], "slug string, name string, url string, status string, district string, previous_status string"), state["projects"]
    tables = {"listings": S.prune(listings, day), "content": S.prune(content, day), "health": health, "projects": projects}
    low = passed.where(F.col("score") < R.min_score(rules)).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("score below threshold").alias("label"), "n")
    return Run(items, R.drop_histogram(judged).unionByName(low), tables, S.alerts(health), updates, [classified])


def publish(done: Run, rules: Mapping, to: report.Publisher, date: str) -> None:
    """Hands a run's reports to a publisher: a digest or single issues, projects, alerts, and messages. What comes
    to the driver is the finished texts, alerts by portal, and updates of one project list."""
    if not done.items.isEmpty():
        if (rules.get("output") or {}).get("mode", "digest") == "digest":
            row = report.digest(done.items, date).first()
            to.ensure_labels([("digest", *report.LABELS["digest"])])
            to.create_issue(row["title"], row["body"], ["digest"])
        else:
            used = done.items.select(F.explode("labels").alias("label"))
            to.ensure_labels([tuple(r) for r in report.label_rows(used).collect()])
            for row in report.issues(done.items).collect():  # MOST_ISSUES rows
                to.create_issue(row["title"], row["body"], row["labels"])
            rest = report.overflow(done.items).first()
            if rest["n"]:
                to.create_issue(f"{rest['n']} additional matches over the {report.MOST_ISSUES}/run cap", rest["body"], ["match"])
        to.send_message(report.message(done.items, date).first()["text"])
    if not done.project_updates.isEmpty():
        numbered = done.project_updates.withColumn("seq", F.col("slug"))
        row = report.project_report(numbered, date).first()
        to.create_issue(row["title"], row["body"], ["new-project"])
        to.send_message(report.project_message(numbered, date).first()["text"])
    titles = done.items.sparkSession.createDataFrame([(t,) for t in to.open_titles("scraper-broken")], "title string")
    for row in report.unreported(done.alerts, titles).collect():  # one for each portal at most
        portal, n = row["portal"], row["zero_streak"]
        body = f"The `{portal}` scraper has produced **0 listings for {n} consecutive runs**: its pages or addresses may have changed, or it may be blocking us."
        to.create_issue(f"{portal}: 0 listings for {n} consecutive runs", body, ["scraper-broken"])
