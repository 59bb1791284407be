"""Queries of the rules: filters, scores, tiers, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich, rules as R
from .common import DUCK_LISTINGS, RULES, listings, quoted, sql_norm, sql_word, table

KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def hard_filter(spark, sf):
    return R.hard_filter(listings(spark, sf), RULES).select(*KEY, "portal", "drop_code")


def drop_histogram(spark, sf):
    return R.drop_histogram(R.hard_filter(listings(spark, sf), RULES))


def drop_reasons(spark, sf):
    """The reason of each dropped listing, as text."""
    return R.hard_filter(listings(spark, sf), RULES).where("drop_code IS NOT NULL").select(*KEY, "drop_reason")


def _scored(spark, sf):
    judged = R.hard_filter(listings(spark, sf), RULES).where("drop_code IS NULL")
    return R.scored(judged, RULES)


def score_breakdown(spark, sf):
    return _scored(spark, sf).select(*KEY, "score", F.concat_ws("; ", "breakdown").alias("breakdown"), F.concat_ws(",", "labels").alias("labels"))


def min_score_cut(spark, sf):
    return _scored(spark, sf).where(F.col("score") >= R.min_score(RULES)).groupBy("portal").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def tier_asof(spark, sf):
    scores = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"))
    tiers = spark.createDataFrame([(60, "hot"), (30, "interesting"), (5, "match")], "min int, label string")
    return R.tier_join(scores, tiers)


def _answer():
    return F.when(F.col("doc_id") % 7 == 0, F.lit("[1, 2]")).when(F.col("doc_id") % 7 == 1, F.lit("not json")).otherwise(
    F.concat(F.lit('{"price_eur": '), (F.col("doc_id") * 100 - 5000).cast("string"), F.lit(', "rooms": "3", "condition": "'), F.when(F.col("doc_id") % 2 == 0, F.lit("novostavba")).otherwise(F.lit("odd")), F.lit('", "balcony": '), F.when(F.col("doc_id") % 3 == 0, F.lit("true")).otherwise(F.lit("null")), F.lit(', "summary": "s'), F.col("doc_id").cast("string"), F.lit('"}'))
)


def enrich_merge(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    nothing = {"street": "string", "district": "string", "floor": "int"}
    own = d.select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.col("n_chars")).alias("price_eur"), F.lit(None).cast("double").alias("area_m2"), F.when(F.col("doc_id") % 5 == 0, F.lit("2")).alias("rooms"),
        *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()], F.when(F.col("doc_id") % 3 == 0, F.lit("rekonstrukcia")).otherwise(F.lit("unknown")).alias("condition"), F.lit(None).cast("boolean").alias("balcony"),
    )
    answers = labels.select(F.col("doc_id").cast("string").alias("id"), _answer().alias("json"))
    return enrich.merge(own, answers).select("id", "price_eur", "rooms", "condition", "balcony", F.col("ai.summary").alias("summary"))


_ENRICH_SQL = """
WITH a AS (SELECT doc_id, doc_id % 7 NOT IN (0, 1) AS good FROM labels)
SELECT CAST(d.doc_id AS VARCHAR) AS id,
  coalesce(CASE WHEN d.doc_id % 4 = 0 THEN n_chars END, CASE WHEN good AND d.doc_id * 100 - 5000 > 0 THEN d.doc_id * 100 - 5000 END) AS price_eur,
  coalesce(CASE WHEN d.doc_id % 5 = 0 THEN '2' END, CASE WHEN good THEN '3' END) AS rooms,
  CASE WHEN d.doc_id % 3 = 0 THEN 'rekonstrukcia' WHEN good AND d.doc_id % 2 = 0 THEN 'novostavba' ELSE 'unknown' END AS condition,
  CASE WHEN good AND d.doc_id % 3 = 0 THEN true END AS balcony,
  CASE WHEN good THEN 's' || d.doc_id END AS summary
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""

_HOUSE, _COMMERCIAL, _FLAT = (f"({'|'.join(words)})" for words in (T.HOUSE_WORDS, T.COMMERCIAL_WORDS, T.FLAT_WORDS))
_CITY = "bratislava|bratislava i|ruzinov|raca|petrzalka|stare mesto|vrakuna|podunajske biskupice|vajnory|karlova ves|dubravka|lamac|devin|zahorska bystrica|jarovce|rusovce|cunovo"
_LISTED = f"""
l AS (SELECT *, {sql_norm("title || ' ' || description_snippet")} AS snip, {sql_norm("title || ' ' || description_snippet || ' ' || coalesce(street, '') || ' ' || coalesce(district, '')")} AS loc,
  {sql_norm("district")} AS nd, {sql_norm("street")} AS ns, CASE WHEN area_m2 > 0 THEN round_even(CAST(price_eur AS DOUBLE) / area_m2, 1) END AS ppm2,
  CASE rooms WHEN '1' THEN 1.0 WHEN '1.5' THEN 1.5 WHEN '2' THEN 2.0 WHEN '3' THEN 3.0 WHEN '4+' THEN 4.0 END AS nr FROM ({DUCK_LISTINGS})),
f AS (SELECT *, CASE
  WHEN NOT regexp_matches(snip, 'byt|garson|garzon|mezonet|apartman') AND {sql_word(_HOUSE, "snip")} THEN 'house'
  WHEN NOT {sql_word(_FLAT, "snip")} AND {sql_word(_COMMERCIAL, "snip")} THEN 'commercial'
  WHEN NOT regexp_matches(loc, '{_CITY}') THEN 'city_unconfirmed'
  WHEN district <> '' AND NOT contains(nd, 'bratislava') THEN 'locality_mismatch'
  WHEN district IS NOT NULL AND NOT ({sql_word("bratislava i", "nd")} OR {sql_word("ruzinov", "nd")} OR {sql_word("raca", "nd")} OR {sql_word("petrzalka", "nd")}) THEN 'district_not_searched'
  WHEN area_m2 < 25 THEN 'area_small' WHEN area_m2 > 115 THEN 'area_large' WHEN price_eur < 25000 THEN 'price_low' WHEN price_eur > 250000 THEN 'price_high'
  WHEN ppm2 > 4500 THEN 'ppm2_high' WHEN nr < 1.5 THEN 'rooms_few' WHEN floor > 10 THEN 'floor_high' WHEN floor = 0 THEN 'ground_floor' WHEN NOT balcony THEN 'no_balcony'
  WHEN condition NOT IN ('unknown', 'novostavba', 'rekonstrukcia') THEN 'condition' WHEN {sql_word("racianska", "ns")} THEN 'banned_street'
  WHEN {sql_word("raca", "loc")} THEN 'banned_district' WHEN contains(snip, 'drazba') THEN 'banned_keyword' END AS drop_code FROM l)"""
_REASON = """CASE drop_code WHEN 'house' THEN 'house or land, not a flat' WHEN 'commercial' THEN 'non-residential space, not a flat'
  WHEN 'city_unconfirmed' THEN 'not confirmed to be in search.city ~Bratislava~' WHEN 'locality_mismatch' THEN 'locality ~' || district || '~ does not mention search.city ~Bratislava~'
  WHEN 'district_not_searched' THEN 'district ~' || district || '~ not in search.districts'
  WHEN 'area_small' THEN 'area ' || printf('%g', area_m2) || ' m² below min_area_m2 25' WHEN 'area_large' THEN 'area ' || printf('%g', area_m2) || ' m² above max_area_m2 115'
  WHEN 'price_low' THEN 'price ' || price_eur || ' € below min_price_eur 25000 (auction teaser?)' WHEN 'price_high' THEN 'price ' || price_eur || ' € above max_price_eur 250000'
  WHEN 'ppm2_high' THEN 'price/m² ' || printf('%g', ppm2) || ' € above max_price_per_m2 4500' WHEN 'rooms_few' THEN 'rooms ' || rooms || ' below min_rooms 1.5'
  WHEN 'floor_high' THEN 'floor ' || floor || ' above max_floor 10' WHEN 'ground_floor' THEN 'ground floor excluded' WHEN 'no_balcony' THEN 'balcony required but listing has none'
  WHEN 'condition' THEN 'condition ~' || condition || '~ not in allowed_conditions' WHEN 'banned_street' THEN 'banned street ~Račianska~' WHEN 'banned_district' THEN 'banned district ~Rača~'
  WHEN 'banned_keyword' THEN 'banned keyword ~dražba~' END""".replace("~", "''")
_LABELS = "(VALUES " + ", ".join(f"({quoted(c)}, {quoted(n)})" for c, n in R.DROP_LABELS.items()) + ") AS t(code, label)"
_TERMS = (
    (sql_word("obchodna", "loc"), 15, "preferred street ''Obchodná''"),
    (sql_word("bazova", "loc"), 10, "preferred street ''Bazová''"),
    (sql_word("ruzinov", "loc"), 20, "preferred district ''Ružinov''"),
    (sql_word("bratislava i", "loc"), 12, "preferred district ''Bratislava I''"),
    ("contains(snip, 'garaz')", 8, "keyword ''garáž''"),
    ("contains(snip, 'parkovanie')", 5, "keyword ''parkovanie''"),
    ("condition = 'novostavba'", 10, "condition novostavba"),
    ("condition = 'povodny_stav'", -5, "condition povodny_stav"),
    ("balcony", 6, "balcony"),
)
_SCORED = f"""
g AS (SELECT *, (2600.0::DOUBLE - ppm2) / 2600.0::DOUBLE * 100 AS below FROM f WHERE drop_code IS NULL),
h AS (SELECT *, CASE WHEN below IS NOT NULL THEN CAST(greatest(-25, least(25, round_even(below, 0))) AS INT) END AS pb, CAST(round_even(below, 0) AS BIGINT) AS rb FROM g),
s AS (SELECT *, {" + ".join(f"CASE WHEN {t} THEN {b} ELSE 0 END" for t, b, _ in _TERMS)} + coalesce(pb, 0) AS score,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {t} THEN '{b:+d} {x}' END" for t, b, x in _TERMS)},
    CASE WHEN pb <> 0 THEN printf('%+d', pb) || ' price/m² ' || CAST(round_even(ppm2, 0) AS BIGINT) || ' € vs reference 2600 € (' || printf('%+d', rb) || '%, capped at ±25)' END], lambda x: x IS NOT NULL), '; ') AS breakdown FROM h)"""

QUERIES = {f.__name__: f for f in (hard_filter, drop_reasons, drop_histogram, score_breakdown, min_score_cut, tier_asof, enrich_merge)}
ORACLES = {
    "hard_filter": f"WITH {_LISTED} SELECT l_orderkey, l_linenumber, l_partkey, portal, drop_code FROM f",
    "drop_reasons": f"WITH {_LISTED} SELECT l_orderkey, l_linenumber, l_partkey, {_REASON} AS drop_reason FROM f WHERE drop_code IS NOT NULL",
    "drop_histogram": f"WITH {_LISTED} SELECT label, count(*) AS n FROM f JOIN {_LABELS} ON drop_code = code GROUP BY label",
    "score_breakdown": f"WITH {_LISTED}, {_SCORED} SELECT l_orderkey, l_linenumber, l_partkey, CAST(score AS INT) AS score, breakdown, CASE WHEN score >= 40 THEN 'hot' WHEN score >= 20 THEN 'interesting' WHEN score >= -5 THEN 'match' ELSE '' END AS labels FROM s",
    "min_score_cut": f"WITH {_LISTED}, {_SCORED} SELECT portal, count(*) AS n, CAST(max(score) AS INT) AS best FROM s WHERE score >= 10 GROUP BY portal",
    "tier_asof": "SELECT o_orderkey, CAST(floor(o_totalprice / 5000) AS INT) AS score, (SELECT max_by(label, m) FROM (VALUES (60, 'hot'), (30, 'interesting'), (5, 'match')) AS t(m, label) WHERE m <= floor(o_totalprice / 5000)) AS label FROM orders",
    "enrich_merge": _ENRICH_SQL,
}
