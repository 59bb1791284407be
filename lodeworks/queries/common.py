"""Tables, the listing view that stands in for crawled listings, and the rule set of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import accent_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL that both engines read, over tables given as {name}."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_norm(x: str) -> str:
    """normalise() in DuckDB, by the same table."""
    src, dst = accent_table()
    return f"trim(regexp_replace(lower(translate(coalesce({x}, ''), {quoted(src)}, {quoted(dst)})), '\\s+', ' ', 'g'))"


def sql_word(needle: str, x: str) -> str:
    return f"regexp_matches({x}, '(^|[^\\p{{L}}\\p{{N}}_]){needle}($|[^\\p{{L}}\\p{{N}}_])')"


#: Listings made of order lines: deterministic text with accents, gaps, and every case the rules tell apart.
LISTINGS = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_suppkey % 5 WHEN 0 THEN 'nehnutelnosti' WHEN 1 THEN 'topreality' WHEN 2 THEN 'reality' WHEN 3 THEN 'bazos' ELSE 'byty' END AS portal,
  concat('https://example.com/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS url,
  concat(CASE l_partkey % 12 WHEN 0 THEN 'Rodinný dom' WHEN 1 THEN 'Nebytový priestor' WHEN 2 THEN 'Stavebný pozemok' WHEN 3 THEN 'Garsónka' ELSE concat(CAST(p_size % 5 + 1 AS STRING), '-izbový byt') END,
         CASE l_suppkey % 4 WHEN 0 THEN ', Obchodná' WHEN 1 THEN ', Račianska' WHEN 2 THEN ', Bazová' ELSE '' END) AS title,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 3 * CAST(floor(l_extendedprice) AS BIGINT) + 20000 END AS price_eur,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity * 2 + 20.5 END AS area_m2,
  CASE p_size % 6 WHEN 0 THEN '1' WHEN 1 THEN '1.5' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4+' ELSE NULL END AS rooms,
  CASE l_suppkey % 4 WHEN 0 THEN 'Obchodná' WHEN 1 THEN 'Račianska' ELSE NULL END AS street,
  CASE s_nationkey % 8 WHEN 0 THEN 'Bratislava I - Staré Mesto' WHEN 1 THEN 'Bratislava - Ružinov' WHEN 2 THEN 'Bratislava III - Rača' WHEN 3 THEN 'Trenčín' WHEN 4 THEN 'Bratislava II' WHEN 5 THEN 'Bratislava - Petržalka' ELSE NULL END AS district,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber * 3 - 3 AS INT) END AS floor,
  CASE p_size % 4 WHEN 0 THEN 'novostavba' WHEN 1 THEN 'povodny_stav' WHEN 2 THEN 'rekonstrukcia' ELSE 'unknown' END AS condition,
  CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS balcony,
  concat('Predaj v meste ', n_name, CASE l_orderkey % 9 WHEN 0 THEN ', Bratislava, garáž' WHEN 1 THEN ', Dúbravka, parkovanie' WHEN 2 THEN ', dražba' WHEN 3 THEN ', Ružinov' ELSE ', Bratislava' END) AS description_snippet
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""
LISTING_TABLES = ("lineitem", "part", "supplier", "nation")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_over(spark, sf_dir, LISTINGS, *LISTING_TABLES)


def duck(sql: str, *names: str) -> str:
    return sql.format(**{n: n for n in names})


DUCK_LISTINGS = duck(LISTINGS, *LISTING_TABLES)

RULES = {
    "search": {"city": "Bratislava", "districts": ["Bratislava I", "Ružinov", "Rača", "Petržalka"]},
    "filters": {
        "exclude_houses": True, "exclude_non_residential": True, "city_required": True, "min_area_m2": 25, "max_area_m2": 115, "min_price_eur": 25000, "max_price_eur": 250000,
        "max_price_per_m2": 4500, "min_rooms": "1.5", "max_floor": 10, "exclude_ground_floor": True, "require_balcony": True, "allowed_conditions": ["novostavba", "rekonstrukcia"],
        "banned_streets": ["Račianska"], "banned_districts": ["Rača"], "banned_keywords": ["dražba"],
    },
    "scoring": {
        "preferred_streets": [{"name": "Obchodná", "bonus": 15}, {"name": "Bazová", "bonus": 10}], "preferred_districts": [{"name": "Ružinov", "bonus": 20}, {"name": "Bratislava I", "bonus": 12.9}],
        "preferred_keywords": [{"name": "garáž", "bonus": 8}, {"name": "parkovanie", "bonus": 5}], "condition_bonus": {"novostavba": 10, "povodny_stav": -5}, "balcony_bonus": 6, "price_per_m2_reference": 2600,
    },
    "output": {"mode": "digest", "min_score_for_issue": 10, "labels_by_score": [{"min": 40, "label": "hot"}, {"min": 20, "label": "interesting"}, {"min": -5, "label": "match"}]},
    "projects": {"enabled": True, "statuses": ["intention", "construction"]},
}
