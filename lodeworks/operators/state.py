"""Change detection against keyed state, as joins and windows.

State is four tables: listings (by id), content (by fingerprint), health (by portal), projects (by slug). A run
takes the old tables and returns new ones; nothing is updated in place. The run's date is always passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TTL_DAYS = 120
ALERT_AFTER = 3

LISTINGS = "id string, first_seen date, last_seen date, url string, hash string, price_eur bigint"
CONTENT = "fingerprint string, first_seen date, last_seen date, id string, url string, price_eur bigint"
HEALTH = "portal string, zero_streak int, last_error string, last_run timestamp_ntz, last_count int"
PROJECTS = "slug string, first_seen date, last_seen date, name string, url string, status string, district string"


def _previous(key: str) -> Column:
    """The last earlier row with the same key, as a struct (null at the first, or where there is no key)."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct(F.col("price_eur").alias("price"), F.col("seq").alias("seq"))
    return F.when(F.col(key).isNotNull(), F.last(entry).over(w))


def _since(key: str) -> Column:
    """The earliest known date among the earlier rows with the same key."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.col(key).isNotNull(), F.min("first_seen").over(w))


def classify(listings: DataFrame, known: DataFrame, content: DataFrame) -> DataFrame:
    """Adds status (new, price_change or seen) and previous_price to listings with columns id, fingerprint,
    price_eur and seq (the order in which they were crawled, from 0 up).

    A listing is compared with the last row of its id, in this run or in the state; only if there is none, with
    the last row of its fingerprint. State rows come before the run as seq -1.
    """
    c = F.col
    now = listings.withColumn("first_seen", F.lit(None).cast("date"))
    by_id = known.select("id", "price_eur", "first_seen", F.lit(-1).cast("bigint").alias("seq"))
    with_id = now.unionByName(by_id, allowMissingColumns=True).withColumn("by_id", _previous("id")).withColumn("since_id", _since("id")).where("seq >= 0")
    by_content = content.select("fingerprint", "price_eur", "first_seen", F.lit(-1).cast("bigint").alias("seq"))
    # Listings without a fingerprint need no window; they would all share one partition.
    looked = with_id.where("fingerprint IS NOT NULL").unionByName(by_content, allowMissingColumns=True).withColumn("by_content", _previous("fingerprint")).withColumn("since_content", _since("fingerprint")).where("seq >= 0")
    bare = with_id.where("fingerprint IS NULL").withColumn("by_content", F.lit(None).cast(looked.schema["by_content"].dataType)).withColumn("since_content", F.lit(None).cast("date"))
    both = looked.unionByName(bare).withColumn("entry", F.coalesce("by_id", "by_content"))
    moved = T.price_moved(c("entry.price"), c("price_eur"))
    status = F.when(c("entry").isNull(), "new").when(moved, "price_change").otherwise("seen")
    return both.withColumn("status", status).withColumn("previous_price", c("entry.price")).withColumn("known_since", F.coalesce("since_id", "since_content")).drop("by_id", "by_content", "since_id", "since_content", "entry", "first_seen")


def remember(classified: DataFrame, known: DataFrame, content: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """The new listings and content tables: the last row of each key, with the key's earliest first_seen. A
    listing seen again under a new id keeps the date of its fingerprint."""
    day = today.cast("date")
    now = classified.withColumn("first_seen", F.coalesce("known_since", day)).withColumn("last_seen", day).withColumn("hash", F.sha1(F.col("url").cast("binary")))

    def merged(old: DataFrame, key: str, fields: list[str]) -> DataFrame:
        rows = old.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(now.where(F.col(key).isNotNull()).select(*old.columns, "seq"))
        latest = F.max_by(F.struct(*fields), "seq")
        return rows.groupBy(key).agg(latest.alias("r"), F.min("first_seen").alias("first_seen")).select(key, "first_seen", *[f"r.{f}" for f in fields]).select(*old.columns)

    return merged(known, "id", ["last_seen", "url", "hash", "price_eur"]), merged(content, "fingerprint", ["last_seen", "id", "url", "price_eur"])


def prune(table: DataFrame, today: Column, days: int = TTL_DAYS) -> DataFrame:
    """Rows last seen within so many days (or first seen, where that is null); rows without dates go."""
    return table.where(F.coalesce("last_seen", "first_seen") >= F.date_sub(today.cast("date"), days))


def record_health(runs: DataFrame, health: DataFrame) -> DataFrame:
    """The new health table from one run's (portal, count, error, at): the streak of bad runs grows with an error
    or no listings, and ends with a good run. Portals that didn't run keep their row."""
    c = F.col
    bad = c("error").isNotNull() | (c("count") == 0)
    j = health.join(runs, "portal", "full")
    ran = c("at").isNotNull()
    return j.select(
        "portal",
        F.when(ran & bad, F.coalesce("zero_streak", F.lit(0)) + 1).when(ran, 0).otherwise(c("zero_streak")).cast("int").alias("zero_streak"),
        F.when(ran, c("error")).otherwise(c("last_error")).alias("last_error"),
        F.when(ran, c("at")).otherwise(c("last_run")).alias("last_run"),
        F.when(ran, c("count")).otherwise(c("last_count")).cast("int").alias("last_count"),
    )


def alerts(health: DataFrame, least: int = ALERT_AFTER) -> DataFrame:
    """(portal, zero_streak) of sources that failed so often in a row, by portal."""
    return health.where(F.col("zero_streak") >= least).select("portal", "zero_streak").orderBy("portal")


def streaks(runs: DataFrame) -> DataFrame:
    """Adds streak, the bad runs in a row up to each run, to a log of (portal, run, ok)."""
    w = Window.partitionBy("portal").orderBy("run")
    island = F.sum(F.col("ok").cast("int")).over(w)
    return runs.withColumn("island", island).withColumn("streak", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("portal", "island").orderBy("run"))).drop("island")


def project_updates(projects: DataFrame, known: DataFrame, statuses: list[str] | None, seeding: bool) -> DataFrame:
    """(project columns, previous_status) of projects that are new or changed status: none while seeding; only
    wanted statuses, if any are named."""
    j = projects.join(known.select("slug", F.col("status").alias("previous_status"), F.lit(True).alias("is_known")), "slug", "left")
    changed = F.col("is_known").isNull() | ~F.col("previous_status").eqNullSafe(F.col("status"))
    out = j.where(changed & F.lit(not seeding)).drop("is_known")
    return out.where(F.col("status").isin(*statuses)) if statuses else out


def remember_projects(projects: DataFrame, known: DataFrame, today: Column) -> DataFrame:
    """The new projects table; projects have no time to live, and unwatched ones are kept too."""
    day = today.cast("date")
    old = known.select("slug", F.col("first_seen").alias("since"))
    now = projects.join(old, "slug", "left").select("slug", F.coalesce("since", day).alias("first_seen"), day.alias("last_seen"), "name", "url", "status", "district")
    return now.unionByName(known.join(projects.select("slug"), "slug", "left_anti").select(*now.columns))
