"""Queries of extraction, ranking, rendering, and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich, extract, rules as R
from ..plans import report
from ..sources import pages
from .common import DUCK_LISTINGS, RULES, listings, sql_over, table
from .ruling import _LISTED, _SCORED

_ORDER_ITEMS = """
SELECT o_orderkey AS seq, CAST(floor(o_totalprice / 4000) AS INT) AS score, concat('Byt | ', CAST(o_orderkey AS STRING)) AS title, concat('https://example.com/', CAST(o_orderkey AS STRING)) AS url,
  CASE o_orderkey % 5 WHEN 0 THEN 'bazos' ELSE 'byty' END AS portal, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS price_eur,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey % 90) + 30.5 END AS area_m2, CASE WHEN o_custkey % 2 = 0 THEN '3' ELSE NULL END AS rooms,
  CASE WHEN o_custkey % 3 = 0 THEN 'Obchodná' ELSE NULL END AS street, CASE WHEN o_custkey % 4 = 0 THEN 'Bratislava I' ELSE NULL END AS district, 'unknown' AS condition,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(floor(o_totalprice) + 5000 AS BIGINT) ELSE NULL END AS old_price, CAST(o_orderdate AS DATE) AS day
FROM {orders}
"""
_AI = "struct<parking:boolean,terrace:boolean,year_built:int,is_new_development:boolean,red_flags:array<string>,summary:string>"


def _items(spark, sf):
    t = sql_over(spark, sf, _ORDER_ITEMS, "orders")
    change = F.when((F.col("old_price") != 0) & (F.col("price_eur") != 0), F.struct(F.col("old_price").alias("old"), F.col("price_eur").alias("new")))
    return t.withColumn("price_change", change).withColumn("ai", F.lit(None).cast(_AI))


def top_k_overflow(spark, sf):
    return report.top(_items(spark, sf)).select("rank", "seq", "score")


def render_rows(spark, sf):
    return _items(spark, sf).select("seq", report.issue_title().alias("title"), report.digest_row().alias("digest"), report.archive_row(F.date_format("day", "yyyy-MM-dd")).alias("archive"))


def render_digest(spark, sf):
    return report.digest(_items(spark, sf), "2026-01-02")


def render_overflow(spark, sf):
    return report.overflow(_items(spark, sf))


_MORE = {"floor": "CAST(seq % 9 AS INT)", "balcony": "CASE seq % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END", "first_seen": "CASE WHEN seq % 4 <> 0 THEN day END"}


def issue_bodies(spark, sf):
    """The report of each item, with all its parts or none."""
    t = _items(spark, sf).withColumns({k: F.expr(v) for k, v in _MORE.items()})
    some = F.col("seq") % 2 == 0
    t = t.withColumn("breakdown", F.when(some, F.array(F.lit("+5 a"), F.lit("-2 b"))).otherwise(F.array().cast("array<string>"))).withColumn("description_snippet", F.when(F.col("seq") % 5 != 0, F.concat(F.lit("Pekný\nbyt "), F.col("seq").cast("string"))))
    ai = F.struct((F.col("seq") % 3 == 0).alias("parking"), F.when(some, F.array(F.lit("drazba"), F.lit("podiel"))).alias("red_flags"), F.when(F.col("seq") % 8 == 0, F.lit("Short.")).alias("summary"))
    return t.withColumn("ai", F.when(F.col("seq") % 10 != 1, ai)).select("seq", report.issue_body().alias("body"))


def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncated(F.col("text"), report.MESSAGE_CHARS).alias("text"))


_UPDATES = """
SELECT p_partkey AS seq, concat('p', CAST(p_partkey AS STRING)) AS slug, p_name AS name, concat('https://example.com/', CAST(p_partkey AS STRING)) AS url,
  CASE p_size % 3 WHEN 0 THEN 'intention' WHEN 1 THEN 'construction' ELSE 'other' END AS status, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Ružinov' END AS district, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'success' END AS previous_status
FROM {part}
"""


def project_report(spark, sf):
    return report.project_report(sql_over(spark, sf, _UPDATES, "part"), "2026-01-02")


def project_message(spark, sf):
    return report.project_message(sql_over(spark, sf, _UPDATES, "part"), "2026-01-02")


_SITES = [{"search": {"city": "Bratislava"}, "filters": {"max_price_eur": 250000}}, {"search": {"city": "Košice"}}]


def search_addresses(spark, sf):
    """Addresses of the first three pages of each portal, for two rule sets."""
    rows = [(k, portal, page, pages.search_url(portal, rules, page)) for k, rules in enumerate(_SITES) for portal in extract.PORTALS for page in (1, 2, 3)]
    lists = [(2, "projects", 1, pages.project_list_url({})), (3, "projects", 1, pages.project_list_url({"projects": {"type": "", "districts": ["raca"]}}))]
    return spark.createDataFrame([*rows, *lists], "rules int, portal string, page int, url string")


_ADDRESS_SQL = """
WITH r(rules, lower, encoded, most) AS (VALUES (0, 'bratislava', 'Bratislava', '&cenado=250000'), (1, 'košice', 'Ko%C5%A1ice', '')), p(page) AS (VALUES (1), (2), (3)),
u AS (SELECT rules, page, unnest([
  {'portal': 'nehnutelnosti', 'url': 'https://www.nehnutelnosti.sk/' || lower || '/byty/predaj/' || CASE WHEN page > 1 THEN '?p[page]=' || page ELSE '' END},
  {'portal': 'topreality', 'url': 'https://www.topreality.sk/vyhladavanie-nehnutelnosti-' || page || '.html?searchType=string&q=' || encoded},
  {'portal': 'reality', 'url': 'https://www.reality.sk/byty/' || lower || '/predaj/' || CASE WHEN page > 1 THEN '?page=' || page ELSE '' END},
  {'portal': 'bazos', 'url': 'https://reality.bazos.sk/predam/byt/' || CASE WHEN page > 1 THEN (page - 1) * 20 || '/' ELSE '' END || '?hledat=' || encoded || most},
  {'portal': 'byty', 'url': 'https://www.byty.sk/byty/predaj/' || lower || CASE WHEN page > 1 THEN '?strana=' || page ELSE '' END}], recursive := true) FROM r, p)
SELECT CAST(rules AS INT) AS rules, portal, CAST(page AS INT) AS page, url FROM u
UNION ALL SELECT 2, 'projects', 1, 'https://www.yimba.sk/zoznam-projektov?type=B%C3%BDvanie&district%5B%5D=downtown&district%5B%5D=ruzinov&district%5B%5D=stare-mesto'
UNION ALL SELECT 3, 'projects', 1, 'https://www.yimba.sk/zoznam-projektov?district%5B%5D=raca'
"""


def _records(spark, sf):
    own = listings(spark, sf).withColumn("id", F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))
    return own.withColumn("first_seen", F.lit("2026-01-02").cast("date")).withColumn("raw", F.create_map(F.lit("locality"), F.coalesce("street", F.lit("")), F.lit("info"), "title"))


def listing_records(spark, sf):
    """Listings as ordered records in JSON."""
    return _records(spark, sf).select("id", extract.record_json().alias("record"))


def source_texts(spark, sf):
    return _records(spark, sf).select("id", enrich.source_text().alias("source"))


_RECORDS = "(SELECT *, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, CASE WHEN area_m2 > 0 THEN round_even(CAST(price_eur AS DOUBLE) / area_m2, 1) END AS ppm2 FROM (" + DUCK_LISTINGS + "))"
_J = lambda x: f"coalesce(to_json({x})::VARCHAR, 'null')"
_RECORD_SQL = "SELECT id, '{' || concat_ws(',', " + ", ".join(f"'\"{n}\":' || {v}" for n, v in (
    ("id", _J("id")), ("portal", _J("portal")), ("url", _J("url")), ("title", _J("title")), ("price_eur", _J("price_eur")), ("area_m2", _J("area_m2::DOUBLE")), ("price_per_m2", _J("ppm2")), ("rooms", _J("rooms")), ("street", _J("street")),
    ("district", _J("district")), ("floor", _J("floor")), ("condition", _J("condition")), ("balcony", _J("balcony")), ("description_snippet", _J("description_snippet")), ("first_seen", "'\"2026-01-02\"'"), ("raw_extra", "'{\"locality\":' || to_json(coalesce(street, '')) || ',\"info\":' || to_json(title) || '}'"),
)) + ") || '}' AS record FROM " + _RECORDS


def render_message(spark, sf):
    return report.message(_items(spark, sf), "2026-01-02")


def monthly_archive(spark, sf):
    rows = _items(spark, sf).select(F.date_format("day", "yyyy-MM").alias("month"), report.archive_row(F.date_format("day", "yyyy-MM-dd")).alias("row"))
    # The marks of all rows, added up: any other row gives another sum.
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5("row"), 1, 10), 16, 10).cast("bigint")).alias("marks"))


_MONEY = "replace(format('{:,}', price_eur), ',', ' ') || ' €'"
_PRICE = "CASE WHEN old_price IS NOT NULL AND price_eur IS NOT NULL THEN {new} || ' (was ' || replace(format('{{:,}}', old_price), ',', ' ') || ' €)' ELSE coalesce({new}, '{unknown}') END"
_PLACE = "coalesce(street, district, '{}')"
_AREA = "coalesce(printf('%g', area_m2) || ' m²', '{}')"
_DUCK_ITEMS = f"i AS ({_ORDER_ITEMS.format(orders='orders')})"
_TITLE = f"'[' || score || '] ' || coalesce({_MONEY}, '? €') || ' | ' || {_AREA.format('? m²')} || ' | ' || {_PLACE.format('?')} || ' | ' || portal"
_DIGEST = f"'| ' || score || ' | ' || {_PRICE.format(new=_MONEY, unknown='? €')} || ' | ' || {_AREA.format('-')} || ' | ' || coalesce(rooms, '-') || ' | ' || {_PLACE.format('-')} || ' | ' || condition || ' | ' || portal || ' | [open](' || url || ') |'"
_ARCHIVE = f"'| ' || strftime(day, '%Y-%m-%d') || ' | ' || score || ' | ' || {_PRICE.format(new=_MONEY, unknown='-')} || ' | ' || {_AREA.format('-')} || ' | ' || coalesce(rooms, '-') || ' | ' || {_PLACE.format('-')} || ' | ' || condition || ' | ' || portal || ' | [' || trim(replace(title, '|', '/')) || '](' || url || ') |'"
_BLOCK = f"chr(10) || '[' || score || '] ' || {_PRICE.format(new=_MONEY, unknown='? €')} || ' | ' || coalesce(printf('%g', area_m2) || ' m2', '? m2') || ' | ' || coalesce(rooms, '?') || ' rooms | ' || {_PLACE.format('?')} || ' | ' || portal || chr(10) || url"


def alert_anti(spark, sf):
    alerts = table(spark, sf, "nation").select(F.col("n_name").alias("portal"))
    titles = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("Scraper broken: "), "n_name").alias("title"))
    return report.unreported(alerts, titles)


def label_lookup(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "intention").when(F.col("o_orderstatus") == "F", "success").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").groupBy(extract.status_label(status).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_dimension(spark, sf):
    label = F.when(F.col("o_orderpriority").startswith("1"), "hot").when(F.col("o_orderpriority").startswith("2"), "digest").otherwise(F.col("o_orderpriority"))
    return report.label_rows(table(spark, sf, "orders").select(label.alias("label")))


#: Result pages of one card, from parts: what was put in is what must come out.
_CARDS = """
SELECT p_partkey, CAST(p_partkey AS STRING) AS k, CAST(p_size AS STRING) AS z, CASE p_partkey % 5 WHEN 0 THEN 'nehnutelnosti' WHEN 1 THEN 'topreality' WHEN 2 THEN 'reality' WHEN 3 THEN 'bazos' ELSE 'byty' END AS portal FROM {part}
"""
_FACTS = "' izbový byt, <b>' || z || ' m²</b>, ' || z || '. poschodie, novostavba, balkón'"
_HTML = f"""
SELECT p_partkey, portal, 1 AS page_no, CASE portal
  WHEN 'bazos' THEN '<div class="inzeraty"><h2 class=nadpis><a href="/inzerat/' || k || '0001/x.php">Byt ' || k || '</a></h2><div class="popis">3' || {_FACTS} || '</div><div class="inzeratycena"><b>' || k || ' 500 €</b></div><div class="inzeratylok">Bratislava<br>811 0' || z || '</div></div>'
  WHEN 'nehnutelnosti' THEN '<div class="advertisement-item" data-id="N' || k || '"><h2><a href="/detail/' || k || '">Byt ' || k || '</a></h2><div class="advertisement-item--content__price">' || k || '.500,- EUR</div><div class="advertisement-item--content__info">3' || {_FACTS} || '</div><div class="advertisement-item--content__locality">Ulica ' || z || ', Bratislava - Ružinov</div></div>'
  WHEN 'reality' THEN '<article class="offer"><h2><a href="/byt/' || k || '0001/">Byt ' || k || '</a></h2><span class="offer__price">' || k || ' 500 €</span><p class="offer__address">Ulica ' || z || ', okres Senec</p><p class="offer__params">3' || {_FACTS} || '</p></article>'
  WHEN 'topreality' THEN '<div class="estate"><h2><a href="/byt-' || k || '0001.html">Byt ' || k || '</a></h2><strong class="price">' || k || ' 500 €</strong><span class="locality">Bratislava I</span><ul class="params"><li>3' || {_FACTS} || '</ul></div>'
  ELSE '<nav><a href="#top">Hore na začiatok</a></nav><div><div><a href="/byt/' || k || '00001">Byt ' || k || ' 3' || {_FACTS} || '</a><span>' || k || ' 500 €</span></div></div>' END AS html
FROM ({_CARDS})
"""


def card_extract(spark, sf):
    pages = sql_over(spark, sf, _HTML, "part")
    out = extract.listings(extract.cards(pages))
    return out.select("portal", "id", "url", "price_eur", "area_m2", "rooms", "street", "district", "floor", "condition", "balcony")


_CARD_SQL = f"""
SELECT portal, CASE portal WHEN 'bazos' THEN 'bazos:' || k || '0001' WHEN 'nehnutelnosti' THEN 'nehnutelnosti:N' || k WHEN 'reality' THEN 'reality:' || k || '0001' WHEN 'topreality' THEN 'topreality:' || k || '0001' ELSE 'byty:' || k || '00001' END AS id,
  CASE portal WHEN 'bazos' THEN 'https://reality.bazos.sk/inzerat/' || k || '0001/x.php' WHEN 'nehnutelnosti' THEN 'https://www.nehnutelnosti.sk/detail/' || k WHEN 'reality' THEN 'https://www.reality.sk/byt/' || k || '0001/' WHEN 'topreality' THEN 'https://www.topreality.sk/byt-' || k || '0001.html' ELSE 'https://www.byty.sk/byt/' || k || '00001' END AS url,
  CASE WHEN p_partkey = 0 THEN 500 ELSE p_partkey * 1000 + 500 END AS price_eur, CAST(z AS DOUBLE) AS area_m2, '3' AS rooms,
  CASE WHEN portal IN ('nehnutelnosti', 'reality') THEN 'Ulica ' || z END AS street,
  CASE portal WHEN 'bazos' THEN 'Bratislava 811 0' || z WHEN 'nehnutelnosti' THEN 'Bratislava - Ružinov' WHEN 'reality' THEN 'Senec' WHEN 'topreality' THEN 'Bratislava I' END AS district,
  CAST(z AS INT) AS floor, 'novostavba' AS condition, true AS balcony FROM ({_CARDS.format(part="part")})
"""

#: Pages without cards, of two offers each, and a page of junk before them all.
_LINKS = """
SELECT p_partkey, 'nehnutelnosti' AS portal, 1 AS page_no, concat(CASE WHEN p_partkey % 5 = 0 THEN '<![foo[ bar' ELSE '' END, '<div><div><a href="/detail/byt/', CAST(p_partkey + 10000 AS STRING), '?x=1">Byt ', CAST(p_partkey AS STRING),
  '</a><span>3 izby, ', CAST(p_size AS STRING), ' m2, ', CAST(p_partkey AS STRING), ' 500 €</span></div><div><a href="/detail/byt/', CAST(p_partkey + 10000 AS STRING), '">zas</a></div><div><a href="https://x.sk/detail/', CAST(p_partkey + 50000 AS STRING), '">Druhý</a> 700 €</div><a href="/o-nas">O nás</a></div>') AS html
FROM {part}
"""


def detail_links(spark, sf):
    """Links to offers on pages whose cards aren't recognised."""
    out = extract.listings(extract.cards(sql_over(spark, sf, _LINKS, "part")))
    return out.select("id", "url", "title", "price_eur", "area_m2", "description_snippet")


_LINK_SQL = """
SELECT 'nehnutelnosti:' || (p_partkey + 10000) AS id, 'https://www.nehnutelnosti.sk/detail/byt/' || (p_partkey + 10000) AS url, 'Byt ' || p_partkey AS title, CASE WHEN p_partkey = 0 THEN 500 ELSE p_partkey * 1000 + 500 END AS price_eur, CAST(p_size AS DOUBLE) AS area_m2,
  'Byt ' || p_partkey || ' 3 izby, ' || p_size || ' m2, ' || p_partkey || ' 500 €' AS description_snippet FROM part
UNION ALL SELECT 'nehnutelnosti:' || (p_partkey + 50000), 'https://x.sk/detail/' || (p_partkey + 50000), 'Druhý', 700, NULL, 'Druhý 700 €' FROM part
"""

_PROJECT_HTML = """
SELECT concat('<div class="project-list-result ', CASE p_size % 4 WHEN 0 THEN 'intention' WHEN 1 THEN 'construction' WHEN 2 THEN 'success' ELSE '' END, '"><img src="/upload/Projekty/', CASE p_size % 3 WHEN 0 THEN 'Star%C3%A9%20Mesto' ELSE 'Ruzinov' END,
  '/a.jpg"><h3><a href="/projekt/p', CAST(p_partkey AS STRING), '">Projekt ', CAST(p_partkey AS STRING), '</a></h3><div></div>') AS html FROM {part}
"""


def project_cards(spark, sf):
    return extract.projects(sql_over(spark, sf, _PROJECT_HTML, "part"))


_PROJECT_CARD_SQL = """
SELECT 'p' || p_partkey AS slug, 'Projekt ' || p_partkey AS name, 'https://www.yimba.sk/projekt/p' || p_partkey AS url,
  CASE p_size % 4 WHEN 0 THEN 'intention' WHEN 1 THEN 'construction' WHEN 2 THEN 'success' ELSE 'unknown' END AS status, CASE p_size % 3 WHEN 0 THEN 'Staré Mesto' ELSE 'Ruzinov' END AS district FROM part
"""


def full_pipeline(spark, sf):
    """Listings through filter, score, cut, rank and the digest's rows: the best twenty."""
    judged = R.hard_filter(listings(spark, sf), RULES).where("drop_code IS NULL")
    kept = R.scored(judged, RULES).where(F.col("score") >= R.min_score(RULES))
    kept = kept.withColumn("seq", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    best = report.top(kept.withColumn("price_change", F.lit(None).cast("struct<old:bigint,new:bigint>")))
    return best.select("rank", "l_orderkey", "l_linenumber", "score", F.concat_ws(",", "labels").alias("labels"), report.digest_row().alias("row"))


_FULL_SQL = f"""
WITH {_LISTED}, {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM s WHERE score >= 10)
SELECT CAST(rank AS INT) AS rank, l_orderkey, l_linenumber, CAST(score AS INT) AS score, CASE WHEN score >= 40 THEN 'hot' WHEN score >= 20 THEN 'interesting' ELSE 'match' END AS labels,
  '| ' || score || ' | ' || coalesce({_MONEY}, '? €') || ' | ' || {_AREA.format("-")} || ' | ' || coalesce(rooms, '-') || ' | ' || {_PLACE.format("-")} || ' | ' || condition || ' | ' || portal || ' | [open](' || url || ') |' AS row
FROM r WHERE rank <= 20
"""

_BODY = f"""'### [' || title || '](' || url || ')' || chr(10) || chr(10)
  || CASE WHEN old_price IS NOT NULL AND price_eur IS NOT NULL THEN '**Price ' || CASE WHEN price_eur < old_price THEN 'dropped' ELSE 'rose' END || ': ' || replace(format('{{:,}}', old_price), ',', ' ') || ' € -> ' || {_MONEY} || '**' || chr(10) || chr(10) ELSE '' END
  || '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Portal | ' || portal || ' |' || chr(10) || '| Price | ' || coalesce({_MONEY}, '? €') || ' |' || chr(10) || '| Area | ' || {_AREA.format("-")} || ' |' || chr(10)
  || '| Price / m² | ' || coalesce(printf('%g', round_even(CAST(price_eur AS DOUBLE) / area_m2, 1)) || ' €', '-') || ' |' || chr(10) || '| Rooms | ' || coalesce(rooms, '-') || ' |' || chr(10) || '| Street | ' || coalesce(street, '-') || ' |' || chr(10)
  || '| District | ' || coalesce(district, '-') || ' |' || chr(10) || '| Floor | ' || {_MORE["floor"]} || ' |' || chr(10) || '| Condition | unknown |' || chr(10) || '| Balcony | ' || CASE seq % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '-' END || ' |' || chr(10)
  || '| Parking | ' || CASE WHEN seq % 10 = 1 THEN '-' WHEN seq % 3 = 0 THEN 'yes' ELSE 'no' END || ' |' || chr(10) || '| First seen | ' || coalesce(CAST({_MORE["first_seen"]} AS VARCHAR), '-') || ' |' || chr(10) || chr(10) || '**Score: ' || score || '**'
  || CASE WHEN seq % 2 = 0 THEN chr(10) || chr(10) || 'Score breakdown:' || chr(10) || '- +5 a' || chr(10) || '- -2 b' ELSE '' END || CASE WHEN seq % 2 = 0 AND seq % 10 <> 1 THEN chr(10) || chr(10) || '**Red flags:** drazba, podiel' ELSE '' END
  || CASE WHEN seq % 8 = 0 AND seq % 10 <> 1 THEN chr(10) || chr(10) || '> Short.' WHEN seq % 5 <> 0 THEN chr(10) || chr(10) || '> Pekný byt ' || seq ELSE '' END || chr(10) || chr(10) || 'Link: ' || url"""
_STATUS = "CASE {0} WHEN 'intention' THEN 'Zámer' WHEN 'construction' THEN 'Výstavba' WHEN 'success' THEN 'Zrealizované' ELSE {0} END"
_NOW, _WAS = _STATUS.format("status"), _STATUS.format("previous_status")
_PROJECT_ROW = f"'| ' || CASE WHEN previous_status IS NULL THEN 'new' ELSE 'changed' END || ' | [' || name || '](' || url || ') | ' || coalesce(district, '-') || ' | ' || CASE WHEN previous_status IS NULL THEN {_NOW} ELSE {_WAS} || ' -> ' || {_NOW} END || ' |'"
_PROJECT_BLOCK = f"chr(10) || CASE WHEN previous_status IS NULL THEN 'NEW: ' || name || ' | ' || coalesce(district, '?') || ' | ' || {_NOW} ELSE name || ' | ' || coalesce(district, '?') || ' | ' || {_WAS} || ' -> ' || {_NOW} END || chr(10) || url"
_DUCK_UPDATES = f"p AS ({_UPDATES.format(part='part')})"

_FUNCTIONS = (top_k_overflow, render_rows, render_digest, render_overflow, issue_bodies, truncated_texts, project_report, project_message, search_addresses, listing_records, source_texts, detail_links, render_message, monthly_archive, alert_anti, label_lookup, label_dimension, card_extract, project_cards, full_pipeline)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLES = {
    "top_k_overflow": f"WITH {_DUCK_ITEMS}, r AS (SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, seq, score FROM i) SELECT CAST(rank AS INT) AS rank, seq, score FROM r WHERE rank <= 20",
    "render_rows": f"WITH {_DUCK_ITEMS} SELECT seq, {_TITLE} AS title, {_DIGEST} AS digest, {_ARCHIVE} AS archive FROM i",
    "render_digest": f"""WITH {_DUCK_ITEMS}, d AS (SELECT count(*) AS n, string_agg({_DIGEST}, chr(10) ORDER BY score DESC, seq) AS rows FROM i)
SELECT n || ' new Bratislava flat(s) - 2026-01-02' AS title, '**' || n || ' new matching flat(s)** this run, highest score first.' || chr(10) || chr(10) || '| Score | Price | Area | Rooms | Address | Condition | Portal | Link |' || chr(10)
  || '| ---: | ---: | ---: | :---: | --- | --- | --- | --- |' || chr(10) || rows || chr(10) || chr(10) || 'Edit `rules.yaml` to tune matches.' AS body, 'digest' AS label FROM d""",
    "render_overflow": f"""WITH {_DUCK_ITEMS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM i)
SELECT 'This run matched more than 20 listings, which usually means' || chr(10) || 'the filters in `rules.yaml` are too loose. The overflow is listed below instead' || chr(10) || 'of opening one Issue each.' || chr(10) || chr(10) || '| Score | Listing | Price | Area |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
  || string_agg('| ' || score || ' | [' || title || '](' || url || ') | ' || coalesce({_MONEY}, '? €') || ' | ' || {_AREA.format("-")} || ' |', chr(10) ORDER BY rank) AS body, count(*) AS n FROM r WHERE rank > 20""",
    "issue_bodies": f"WITH {_DUCK_ITEMS} SELECT seq, {_BODY} AS body FROM i",
    "truncated_texts": "SELECT doc_id, CASE WHEN length(text) > 4096 THEN left(text, 4093) || '...' ELSE text END AS text FROM documents",
    "project_report": f"""WITH {_DUCK_UPDATES}, d AS (SELECT count(*) FILTER (previous_status IS NULL) AS a, count(*) FILTER (previous_status IS NOT NULL) AS b, string_agg({_PROJECT_ROW}, chr(10) ORDER BY seq) AS rows FROM p)
SELECT 'Development watch: ' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' new project(s)' END, CASE WHEN b > 0 THEN b || ' status change(s)' END) || ' - 2026-01-02' AS title,
  'New and re-staged Bratislava development projects in your watched districts, from [YIM.BA](https://www.yimba.sk/zoznam-projektov).' || chr(10) || chr(10) || '| What | Project | District | Status |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
  || rows || chr(10) || chr(10) || 'Turn this off with `projects.enabled: false` in `rules.yaml`.' AS body, 'new-project' AS label FROM d""",
    "project_message": f"""WITH {_DUCK_UPDATES}, r AS (SELECT *, row_number() OVER (ORDER BY seq) AS rank FROM p), m AS (SELECT (SELECT count(*) FROM p) AS n, string_agg({_PROJECT_BLOCK}, chr(10) ORDER BY rank) AS blocks FROM r WHERE rank <= 20),
t AS (SELECT n || ' development project update(s) - 2026-01-02' || chr(10) || blocks || CASE WHEN n > 20 THEN chr(10) || chr(10) || '...and ' || (n - 20) || ' more (see the GitHub issue).' ELSE '' END AS text FROM m)
SELECT CASE WHEN length(text) > 4096 THEN left(text, 4093) || '...' ELSE text END AS text FROM t""",
    "search_addresses": _ADDRESS_SQL,
    "listing_records": _RECORD_SQL,
    "source_texts": f"SELECT id, left(concat_ws(' ', title, description_snippet, nullif(street, ''), title), 6000) AS source FROM {_RECORDS}",
    "detail_links": _LINK_SQL,
    "render_message": f"""WITH {_DUCK_ITEMS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM i),
m AS (SELECT (SELECT count(*) FROM i) AS n, string_agg({_BLOCK}, chr(10) ORDER BY rank) AS blocks FROM r WHERE rank <= 20),
t AS (SELECT n || ' new Bratislava flat(s) - 2026-01-02' || chr(10) || blocks || chr(10) || chr(10) || '...and ' || (n - 20) || ' more (see the GitHub issue).' AS text FROM m)
SELECT CASE WHEN length(text) > 4096 THEN left(text, 4093) || '...' ELSE text END AS text FROM t""",
    "monthly_archive": f"WITH {_DUCK_ITEMS} SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, CAST(sum(CAST('0x' || substr(md5({_ARCHIVE}), 1, 10) AS BIGINT)) AS BIGINT) AS marks FROM i GROUP BY month",
    "alert_anti": "SELECT n_name AS portal FROM nation n WHERE NOT EXISTS (SELECT 1 FROM nation t WHERE t.n_nationkey % 3 = 0 AND contains('Scraper broken: ' || t.n_name, n.n_name))",
    "label_lookup": "SELECT CASE o_orderstatus WHEN 'O' THEN 'Zámer' WHEN 'F' THEN 'Zrealizované' ELSE o_orderstatus END AS label, count(*) AS n FROM orders GROUP BY 1",
    "label_dimension": "SELECT DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN 'hot' WHEN o_orderpriority LIKE '2%' THEN 'digest' ELSE o_orderpriority END AS label, CASE WHEN o_orderpriority LIKE '1%' THEN 'E11D48' WHEN o_orderpriority LIKE '2%' THEN '8B5CF6' ELSE 'BFDBFE' END AS colour, CASE WHEN o_orderpriority LIKE '1%' THEN 'High-scoring listing' WHEN o_orderpriority LIKE '2%' THEN 'One run''s new matches, collected into a single issue' ELSE 'Label of a run' END AS description FROM orders",
    "card_extract": _CARD_SQL,
    "project_cards": _PROJECT_CARD_SQL,
    "full_pipeline": _FULL_SQL,
}
