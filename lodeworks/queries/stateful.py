"""Queries of keyed state: changes, first dates, streaks, projects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state as S
from ..sources import pages as P
from .common import table

_EMPTY = ("id string, price_eur bigint, first_seen date", "fingerprint string, price_eur bigint, first_seen date")


def change_detect(spark, sf):
    """Orders as sightings: the id is customer and month, the fingerprint the customer (for two of three)."""
    o = table(spark, sf, "orders")
    seq = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 10**10 + F.col("o_orderkey")
    sightings = o.select(
        "o_orderkey", F.concat_ws("/", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM")).alias("id"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("fingerprint"), F.floor("o_totalprice").cast("bigint").alias("price_eur"), seq.alias("seq"),
    )
    known, content = (spark.createDataFrame([], x) for x in _EMPTY)
    return S.classify(sightings, known, content).select("o_orderkey", "status", "previous_price")


_CHANGE_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS id, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderdate AS d FROM orders),
l AS (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY CAST(d AS DATE), o_orderkey) AS by_id, lag(price) OVER (PARTITION BY o_custkey ORDER BY CAST(d AS DATE), o_orderkey) AS by_fp FROM o),
p AS (SELECT o_orderkey, price, coalesce(by_id, CASE WHEN o_custkey % 3 <> 0 THEN by_fp END) AS old FROM l)
SELECT o_orderkey, CASE WHEN old IS NULL THEN 'new' WHEN old > 0 AND price <> 0 AND abs(price - old) / CAST(old AS DOUBLE) > 0.02 THEN 'price_change' ELSE 'seen' END AS status, old AS previous_price FROM p
"""


def _remembered(spark, sf):
    """State after a run over all orders whose older half is the known state."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    named = o.select(F.col("o_custkey").cast("string").alias("id"), day.alias("day"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").cast("bigint").alias("price_eur"))
    old = named.where("day < DATE '1995-01-01'").groupBy("id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.max_by("price_eur", "seq").alias("price_eur"))
    known = old.select("id", "first_seen", "last_seen", F.lit("u").alias("url"), F.lit("h").alias("hash"), "price_eur")
    content = spark.createDataFrame([], S.CONTENT)
    now = named.where("day >= DATE '1995-01-01'").select("id", "seq", "price_eur", F.lit(None).cast("string").alias("fingerprint"), F.lit("v").alias("url"))
    classified = S.classify(now, known, content)
    return S.remember(classified, known, content, F.lit("1998-01-01"))[0]


def first_seen_carry(spark, sf):
    return _remembered(spark, sf).select("id", "first_seen", "last_seen", "price_eur")


def prune_ttl(spark, sf):
    kept = S.prune(_remembered(spark, sf), F.lit("1998-01-01"))
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.min("first_seen").alias("oldest"))


_STATE = """
o AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS day, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
k AS (SELECT id, min(day) AS first_seen, max(day) AS last_seen, arg_max(price, seq) AS price FROM o WHERE day < DATE '1995-01-01' GROUP BY id),
n AS (SELECT id, arg_max(price, seq) AS price FROM o WHERE day >= DATE '1995-01-01' GROUP BY id),
r AS (SELECT coalesce(k.id, n.id) AS id, coalesce(first_seen, DATE '1998-01-01') AS first_seen, CASE WHEN n.id IS NULL THEN last_seen ELSE DATE '1998-01-01' END AS last_seen, CASE WHEN n.id IS NULL THEN k.price ELSE n.price END AS price_eur FROM k FULL JOIN n ON k.id = n.id)"""


def project_diff(spark, sf):
    """Each user's last event before the middle of the log is the known one, their last one the listed."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("slug"), "event_id", F.col("event_type").alias("status"))
    middle = e.agg(F.expr("max(event_id) DIV 2")).first()[0]  # one number
    known = e.where(F.col("event_id") <= F.lit(middle)).groupBy("slug").agg(F.max_by("status", "event_id").alias("status"))
    listed = e.groupBy("slug").agg(F.max_by("status", "event_id").alias("status"))
    out = S.project_updates(listed, known, ["click", "purchase", "view"], seeding=False)
    return out.select("slug", "status", "previous_status", F.col("previous_status").isNull().alias("is_new"))


_PROJECT_SQL = """
WITH m AS (SELECT max(event_id) // 2 AS m FROM events),
k AS (SELECT user_id, arg_max(event_type, event_id) AS status FROM events, m WHERE event_id <= m.m GROUP BY user_id),
l AS (SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id)
SELECT CAST(l.user_id AS VARCHAR) AS slug, l.status, k.status AS previous_status, k.status IS NULL AS is_new FROM l LEFT JOIN k USING (user_id)
WHERE k.status IS DISTINCT FROM l.status AND l.status IN ('click', 'purchase', 'view')
"""


def source_health(spark, sf):
    """Event types as sources and hours as runs: a run fails if the source has no event in it."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("portal"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("run"))
    hours = e.groupBy("portal").agg(F.min("run").alias("a"), F.max("run").alias("b")).select("portal", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("run"))
    seen = e.groupBy("portal", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = hours.join(seen, ["portal", "run"], "left").withColumn("ok", F.col("n").isNotNull())
    return S.streaks(runs).groupBy("portal").agg(F.max("streak").alias("worst"), F.sum((F.col("streak") >= S.ALERT_AFTER).cast("bigint")).alias("alerts"))


_HEALTH_SQL = """
WITH e AS (SELECT event_type AS portal, date_trunc('hour', ts) AS run FROM events), g AS (SELECT portal, unnest(generate_series(min(run), max(run), INTERVAL 1 HOUR)) AS run FROM e GROUP BY portal),
r AS (SELECT g.portal, g.run, n IS NOT NULL AS ok FROM g LEFT JOIN (SELECT portal, run, count(*) AS n FROM e GROUP BY ALL) s ON g.portal = s.portal AND g.run = s.run),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY portal ORDER BY run) AS island FROM r),
s AS (SELECT portal, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY portal, island ORDER BY run) AS streak FROM i)
SELECT portal, CAST(max(streak) AS BIGINT) AS worst, CAST(sum(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM s GROUP BY portal
"""


def page_loop_dedupe(spark, sf):
    e = table(spark, sf, "events")
    page = F.dense_rank().over(Window.partitionBy("event_type").orderBy(F.col("ts").cast("date")))
    found = e.select(F.col("event_type").alias("portal"), page.alias("page_no"), F.col("user_id").cast("string").alias("id"), "event_id")
    return P.paged(found).groupBy("portal", "page_no").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


_LOOP_SQL = """
WITH f AS (SELECT event_type AS portal, dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS page_no, user_id AS id FROM events),
n AS (SELECT *, page_no = min(page_no) OVER (PARTITION BY portal, id) AS is_new FROM f WHERE page_no <= 3),
p AS (SELECT portal, page_no, bool_or(is_new) AS any_new FROM n GROUP BY ALL),
g AS (SELECT portal, page_no, bool_and(any_new) OVER (PARTITION BY portal ORDER BY page_no) AS going FROM p)
SELECT n.portal, n.page_no, count(*) AS rows, count(DISTINCT id) AS ids FROM n JOIN g ON n.portal = g.portal AND n.page_no = g.page_no WHERE is_new AND going GROUP BY ALL
"""


def source_union(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.length("text").cast("bigint").alias("size"))
    p = table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.length("html").cast("bigint").alias("size"))
    c = table(spark, sf, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), F.length("text").cast("bigint").alias("size"))
    return d.unionByName(p).unionByName(c)


QUERIES = {f.__name__: f for f in (change_detect, first_seen_carry, prune_ttl, project_diff, source_health, page_loop_dedupe, source_union)}
ORACLES = {
    "change_detect": _CHANGE_SQL,
    "first_seen_carry": f"WITH {_STATE} SELECT id, first_seen, last_seen, price_eur FROM r",
    "prune_ttl": f"WITH {_STATE} SELECT count(*) AS kept, min(first_seen) AS oldest FROM r WHERE last_seen >= DATE '1998-01-01' - INTERVAL 120 DAY",
    "project_diff": _PROJECT_SQL,
    "source_health": _HEALTH_SQL,
    "page_loop_dedupe": _LOOP_SQL,
    "source_union": "SELECT 'documents' AS source, doc_id AS id, length(text) AS size FROM documents UNION ALL SELECT 'pages', page_id, length(html) FROM pages UNION ALL SELECT 'conversations', conv_id, length(text) FROM conversations",
}
