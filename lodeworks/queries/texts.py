"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract
from ..sources import pages as P
from .common import quoted, sql_norm, sql_over, sql_word, table

NEEDLES = ("the", "para", "Über", "être", "ción", "und")


def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalise(F.col("text")).alias("norm"))


def place_match(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.normalise(F.col("text")).alias("norm"))
    return d.select("doc_id", *[T.has_word(n, F.col("norm")).alias(f"has_{i}") for i, n in enumerate(NEEDLES)])


_PRICES = """
SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN concat(CAST(p_size AS STRING), ' m², ', CAST(p_partkey + 100000 AS STRING), ' € (2 701 €/m²)')
  WHEN 1 THEN concat('Cena: 1', CAST(100 + p_size AS STRING), ' 250,- EUR')
  WHEN 2 THEN concat('2.', CAST(100 + p_size AS STRING), '.000,50 €')
  WHEN 3 THEN 'Cena dohodou 150 000 €' WHEN 4 THEN concat('od ', CAST(p_partkey + 7000 AS STRING)) ELSE 'neuvedené' END AS text,
  CASE p_partkey % 6 WHEN 0 THEN p_partkey + 100000 WHEN 1 THEN 1100250 + 1000 * CAST(p_size AS BIGINT) WHEN 2 THEN 2100000 + 1000 * CAST(p_size AS BIGINT) WHEN 4 THEN p_partkey + 7000 ELSE NULL END AS truth
FROM {part}
"""


def price_extract(spark, sf):
    return sql_over(spark, sf, _PRICES, "part").select("p_partkey", T.price(F.col("text")).alias("price_eur"))


_ROOMS = """
SELECT p_partkey, p_size, concat(CASE p_size % 7 WHEN 0 THEN 'Garsónka' WHEN 1 THEN '1,5-izbový byt' WHEN 2 THEN '3 izbový byt' WHEN 3 THEN '5-izbový byt' WHEN 4 THEN '2 - izb. byt' WHEN 5 THEN '4-izbový' ELSE 'byt' END,
  ', ', CASE p_size % 5 WHEN 0 THEN CAST(p_size + 20 AS STRING) || ',5 m²' WHEN 1 THEN CAST(p_size + 20 AS STRING) || ' m2' WHEN 2 THEN CAST(p_size + 20 AS STRING) || ' m.' WHEN 3 THEN '5 min, ' || CAST(p_size + 20 AS STRING) || ' m³' ELSE 'bez plochy' END,
  ', ', CASE p_size % 4 WHEN 0 THEN 'prízemie' WHEN 1 THEN CAST(p_size AS STRING) || '. poschodie' WHEN 2 THEN CAST(p_size AS STRING) || '. NP' ELSE 'vyššie' END) AS text FROM {part}
"""


def area_rooms_floor(spark, sf):
    t = sql_over(spark, sf, _ROOMS, "part")
    norm = T.normalise(F.col("text"))
    code = T.rooms(norm)
    return t.select("p_partkey", T.area(F.col("text")).alias("area_m2"), code.alias("rooms"), T.rooms_number(code).alias("rooms_number"), T.floor_of(norm).alias("floor"))


_ROOMS_SQL = """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size + 20.5 WHEN 1 THEN p_size + 20.0 WHEN 2 THEN p_size + 20.0 ELSE NULL END::DOUBLE AS area_m2,
  CASE p_size % 7 WHEN 0 THEN '1' WHEN 1 THEN '1.5' WHEN 2 THEN '3' WHEN 3 THEN '4+' WHEN 4 THEN '2' WHEN 5 THEN '4+' END AS rooms,
  CASE p_size % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 3.0 WHEN 3 THEN 4.0 WHEN 4 THEN 2.0 WHEN 5 THEN 4.0 END::DOUBLE AS rooms_number,
  CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size WHEN 2 THEN p_size - 1 END::INT AS floor FROM part
"""

_STATES = """
SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'Novostavba, pôvodne sklad' WHEN 1 THEN 'po REKONŠTRUKCII' WHEN 2 THEN 'Pôvodný stav' WHEN 3 THEN p_type ELSE 'rekonštruovaný pôvodný byt' END, ' ',
  CASE p_partkey % 4 WHEN 0 THEN 'bez  balkóna' WHEN 1 THEN 's balkónom' WHEN 2 THEN 'lodžia' ELSE p_brand END) AS text FROM {part}
"""


def condition_balcony(spark, sf):
    norm = T.normalise(F.col("text"))
    return sql_over(spark, sf, _STATES, "part").select("p_partkey", T.condition(norm).alias("condition"), T.balcony(norm).alias("balcony"))


_STATES_SQL = """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'novostavba' WHEN 1 THEN 'rekonstrukcia' WHEN 2 THEN 'povodny_stav' WHEN 3 THEN 'unknown' ELSE 'rekonstrukcia' END AS condition,
  CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END AS balcony FROM part
"""

_PLACES = """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN concat('Ulica ', CAST(c_custkey AS STRING), ', Bratislava - Ružinov') WHEN 1 THEN concat('okres ', n_name, ', Hlavná ', CAST(c_custkey AS STRING))
  WHEN 2 THEN 'Bratislava III, Rača' WHEN 3 THEN concat(' , ', c_name) WHEN 4 THEN 'BRATISLAVA  V - Petržalka' ELSE 'Nové Mesto nad Váhom' END AS text, n_name, c_name
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""


def locality_split(spark, sf):
    street, district = T.split_locality(F.col("text"))
    return sql_over(spark, sf, _PLACES, "customer", "nation").select("c_custkey", street.alias("street"), district.alias("district"))


_SPLIT_SQL = """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Ulica ' || c_custkey WHEN 1 THEN 'Hlavná ' || c_custkey WHEN 2 THEN 'Rača' WHEN 3 THEN c_name WHEN 5 THEN 'Nové Mesto nad Váhom' END AS street,
  CASE c_custkey % 6 WHEN 0 THEN 'Bratislava - Ružinov' WHEN 1 THEN n_name WHEN 2 THEN 'Bratislava III' WHEN 4 THEN 'BRATISLAVA  V - Petržalka' END AS district
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def locality_guess(spark, sf):
    return sql_over(spark, sf, _PLACES, "customer", "nation").select("c_custkey", T.guess_locality(T.normalise(F.col("text"))).alias("locality"))


_GUESS_SQL = """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Bratislava - Ružinov' WHEN 2 THEN 'Bratislava III - Rača' WHEN 4 THEN 'Bratislava V - Petržalka' END AS locality FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

_KINDS = """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Rodinný dom so záhradou' WHEN 1 THEN '3-izbový byt v bytovom dome' WHEN 2 THEN 'Nebytový priestor, kancelária' WHEN 3 THEN 'Byt so skladom' WHEN 4 THEN 'Sklad a hala'
  WHEN 5 THEN 'Stavebný pozemok' WHEN 6 THEN 'dom a apartmán' WHEN 7 THEN p_type ELSE 'Predomky' END AS text FROM {part}
"""


def house_commercial(spark, sf):
    norm = T.normalise(F.col("text"))
    return sql_over(spark, sf, _KINDS, "part").select("p_partkey", T.looks_like_house(norm).alias("house"), T.looks_like_commercial(norm).alias("commercial"))


_KINDS_SQL = "SELECT p_partkey, p_partkey % 9 IN (0, 5) AS house, p_partkey % 9 IN (2, 4) AS commercial FROM part"


def listing_id(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).when(F.col("page_id") % 3 == 1, F.lit(""))
    return table(spark, sf, "pages").select("page_id", T.listing_id(F.lit("byty"), raw, F.col("url")).alias("id"), F.sha1(F.col("url").cast("binary")).alias("hash"))


_ID_SQL = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'byty:' || page_id ELSE 'byty:sha1:' || sha1(url) END AS id, sha1(url) AS hash FROM pages"


def fingerprint(spark, sf):
    t = table(spark, sf, "part")
    size = F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice"))
    return t.select("p_partkey", T.general(size).alias("area_text"), T.fingerprint(F.lit("bazos"), F.col("p_name"), size, F.col("p_size").cast("string")).alias("fingerprint"))


_FINGERPRINT_SQL = f"""
SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN printf('%g', p_retailprice) END AS area_text,
  CASE WHEN p_partkey % 10 <> 0 THEN sha1('bazos|' || {sql_norm("p_name")} || '|' || printf('%g', p_retailprice) || '|' || p_size) END AS fingerprint FROM part
"""


def unit_price(spark, sf):
    p, a = F.floor("l_extendedprice").cast("bigint"), F.when(F.col("l_quantity") > 2, F.col("l_quantity"))
    usable = F.coalesce(p.cast("string"), a.cast("string")).isNotNull()
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.price_per_m2(p, a).alias("ppm2"), usable.alias("usable"))


_UNIT_SQL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 2 THEN round_even(floor(l_extendedprice) / l_quantity, 1) END AS ppm2, true AS usable FROM lineitem"


def link_harvest(spark, sf):
    return extract.anchors(table(spark, sf, "pages"))


_LINKS_SQL = """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS x, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS i FROM pages),
b AS (SELECT page_id, i, regexp_extract(x, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(x, '>([^<]*)<', 1)) AS title FROM a)
SELECT page_id, href, arg_min(title, i) AS title FROM b WHERE href <> '' AND title <> '' GROUP BY page_id, href
"""


def challenge_pages(spark, sf):
    t = table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<title>Just a moment...</title>"), "html")).otherwise(F.col("html")))
    return t.select("page_id", P.is_challenge(F.col("html")).alias("challenge"))


_CHALLENGE_SQL = "SELECT page_id, page_id % 4 = 0 OR " + " OR ".join(f"contains(lower(left(html, 4000)), {quoted(c)})" for c in P.CHALLENGES) + " AS challenge FROM pages"

QUERIES = {f.__name__: f for f in (text_normalize, place_match, price_extract, area_rooms_floor, condition_balcony, locality_split, locality_guess, house_commercial, listing_id, fingerprint, unit_price, link_harvest, challenge_pages)}
ORACLES = {
    "text_normalize": f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents",
    "place_match": f"SELECT doc_id, {', '.join(f'{sql_word(T.plain(n), sql_norm('text'))} AS has_{i}' for i, n in enumerate(NEEDLES))} FROM documents",
    "price_extract": f"SELECT p_partkey, truth AS price_eur FROM ({_PRICES.format(part='part')})",
    "area_rooms_floor": _ROOMS_SQL,
    "condition_balcony": _STATES_SQL,
    "locality_split": _SPLIT_SQL,
    "locality_guess": _GUESS_SQL,
    "house_commercial": _KINDS_SQL,
    "listing_id": _ID_SQL,
    "fingerprint": _FINGERPRINT_SQL,
    "unit_price": _UNIT_SQL,
    "link_harvest": _LINKS_SQL,
    "challenge_pages": _CHALLENGE_SQL,
}
