"""The rule set: loading, merging, validation, and its compilation to columns.

Every hard rule is written as a violation that is true only when the data confirm it, so unknown values never
drop a listing (but for the two rules that ask for confirmation). The first violation gives the code and the
reason. Scores are sums of columns; nothing is joined, shuffled or run in Python.
"""

from __future__ import annotations

import base64
import copy
import os
from collections.abc import Mapping
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OVERRIDE_VARIABLE = "RULES_OVERRIDE_B64"
PRICE_CAP = 25
CONDITIONS = {"novostavba", "povodny_stav", "rekonstrukcia", "unknown"}
NUMBERS = ("min_area_m2", "max_area_m2", "min_price_eur", "max_price_eur", "max_price_per_m2", "max_floor")
FLAGS = ("exclude_ground_floor", "exclude_houses", "exclude_non_residential", "city_required", "require_balcony")

#: Code of a rule -> label in the run's summary, in the order of evaluation.
DROP_LABELS = {
    "house": "not a flat (house/land)",
    "commercial": "not a flat (commercial)",
    "city_unconfirmed": "not confirmed in city",
    "locality_mismatch": "locality mismatch",
    "district_not_searched": "district not searched",
    "area_small": "area too small",
    "area_large": "area too large",
    "price_low": "price too low",
    "price_high": "price too high",
    "ppm2_high": "price/m2 too high",
    "rooms_few": "too few rooms",
    "floor_high": "floor too high",
    "ground_floor": "ground floor excluded",
    "no_balcony": "no balcony",
    "condition": "condition not allowed",
    "banned_street": "banned street",
    "banned_district": "banned district",
    "banned_keyword": "banned keyword",
}


class RulesError(ValueError):
    """The rules can't be read, or are malformed; the message names the key."""


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """over laid on base, mapping by mapping; neither is changed."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def load_rules(path: str, env: Mapping[str, str] | None = None) -> dict:
    """The YAML file, under the override in the environment (YAML in strict base64), validated."""
    try:
        with open(path, encoding="utf-8") as f:
            rules = yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        raise RulesError(f"{path}: {e}") from e
    if not isinstance(rules, Mapping):
        raise RulesError(f"{path}: the top level must be a mapping")
    raw = (os.environ if env is None else env).get(OVERRIDE_VARIABLE)
    if raw:
        try:
            over = yaml.safe_load(base64.b64decode(raw, validate=True).decode("utf-8"))
        except (ValueError, yaml.YAMLError) as e:
            raise RulesError(f"{OVERRIDE_VARIABLE}: {e}") from e
        if not isinstance(over, Mapping):
            raise RulesError(f"{OVERRIDE_VARIABLE}: must be a mapping")
        rules = deep_merge(rules, over)
    validate(rules)
    return dict(rules)


def _need(ok: bool, key: str, what: str) -> None:
    if not ok:
        raise RulesError(f"{key}: {what}")


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float))


def validate(rules: Mapping) -> None:
    """Raises RulesError at the first fault. Bonuses and label minima must be numbers, so that scoring can't fail."""
    _need(isinstance(rules, Mapping), "rules", "must be a mapping")
    section = lambda name, required=False: _section(rules, name, required)
    search, filters = section("search", True), section("filters", True)
    scoring, output, projects = section("scoring"), section("output"), section("projects")
    texts = lambda m, key, at: _need(m.get(key) is None or isinstance(m[key], list) and all(isinstance(x, str) for x in m[key]), f"{at}.{key}", "must be a list of strings")
    _need(search.get("city") is None or isinstance(search["city"], str), "search.city", "must be a string")
    _need(search.get("transaction") is None or isinstance(search["transaction"], str), "search.transaction", "must be a string")
    texts(search, "districts", "search")
    for key in NUMBERS:
        _need(filters.get(key) is None or _is_number(filters[key]), f"filters.{key}", "must be a number")
    rooms = filters.get("min_rooms")
    _need(rooms is None or isinstance(rooms, (int, float, str)), "filters.min_rooms", "must be a number or a code")
    for key in FLAGS:
        _need(key not in filters or isinstance(filters[key], bool), f"filters.{key}", "must be true or false")
    for key in ("allowed_conditions", "banned_streets", "banned_districts", "banned_keywords"):
        texts(filters, key, "filters")
    unknown = set(filters.get("allowed_conditions") or ()) - CONDITIONS
    _need(not unknown, "filters.allowed_conditions", f"unknown {sorted(unknown)}")
    for key in ("preferred_streets", "preferred_districts", "preferred_keywords"):
        entries = scoring.get(key)
        good = entries is None or isinstance(entries, list) and all(isinstance(e, Mapping) and isinstance(e.get("name"), str) and _is_number(e.get("bonus", 0)) for e in entries)
        _need(good, f"scoring.{key}", "must list mappings of name and bonus")
    bonus = scoring.get("condition_bonus")
    _need(bonus is None or isinstance(bonus, Mapping) and set(bonus) <= CONDITIONS and all(map(_is_number, bonus.values())), "scoring.condition_bonus", "must map conditions to numbers")
    for key in ("balcony_bonus", "price_per_m2_reference"):
        _need(scoring.get(key) is None or _is_number(scoring[key]), f"scoring.{key}", "must be a number")
    _need(output.get("mode") in (None, "digest", "issue_per_listing"), "output.mode", "must be digest or issue_per_listing")
    _need(output.get("min_score_for_issue") is None or _is_number(output["min_score_for_issue"]), "output.min_score_for_issue", "must be a number")
    labels = output.get("labels_by_score")
    _need(labels is None or isinstance(labels, list) and all(isinstance(e, Mapping) and isinstance(e.get("label"), str) and _is_number(e.get("min", 0)) for e in labels), "output.labels_by_score", "must list mappings of min and label")
    _need("enabled" not in projects or isinstance(projects["enabled"], bool), "projects.enabled", "must be true or false")
    _need(projects.get("type") is None or isinstance(projects["type"], str), "projects.type", "must be a string")
    for key in ("districts", "statuses"):
        texts(projects, key, "projects")


def _section(rules: Mapping, name: str, required: bool) -> Mapping:
    value = rules.get(name)
    _need(isinstance(value, Mapping) or value is None and not required, name, "must be a mapping")
    return value or {}


def with_text(listings: DataFrame) -> DataFrame:
    """Adds the normalised texts that rules look at: norm_snip (title and snippet), norm_street, norm_district, and
    norm_loc (all of these and the raw values, from their normal forms). Each is computed once: an expression that
    isn't deterministic is neither copied into the many conditions that read it nor pushed down with them."""
    c = F.col
    once = lambda x: F.when(F.monotonically_increasing_id() >= 0, x)
    some = lambda x: F.nullif(x, F.lit(""))
    out = listings.withColumns(
        {
            "norm_snip": once(T.normalise(F.concat_ws(" ", c("title"), c("description_snippet")))),
            "norm_street": once(T.normalise(c("street"))),
            "norm_district": once(T.normalise(c("district"))),
        }
    )
    raw = [some(T.normalise(F.array_join(F.map_values("raw"), " ")))] if "raw" in listings.columns else []
    return out.withColumn("norm_loc", once(F.concat_ws(" ", *[some(c(x)) for x in ("norm_snip", "norm_street", "norm_district")], *raw)))


def in_city(city: str, districts: list[str]) -> Column:
    """Whether the location text names the city, a searched district or, for Bratislava, an unambiguous borough."""
    names = [city, *districts]
    if T.plain(city) == "bratislava":
        names += [b for b in T.BOROUGHS if b != T.AMBIGUOUS_BOROUGH]
    return T.any_part([T.plain(n) for n in names if T.plain(n)], F.col("norm_loc"))


# Fixed values from here to hard_filter: the sentences that say why a listing was dropped.


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def violations(rules: Mapping) -> list[tuple[str, Column, Column]]:
    """(code, violated, reason) of each rule in force, in order."""
    f, search = rules.get("filters") or {}, rules.get("search") or {}
    city, districts = search.get("city"), search.get("districts") or []
    c, lit = F.col, F.lit
    out: list[tuple[str, Column, Column]] = []
    add = lambda code, bad, *parts: out.append((code, F.coalesce(bad, lit(False)), F.concat(*[p if isinstance(p, Column) else lit(p) for p in parts])))
    if f.get("exclude_houses"):
        add("house", T.looks_like_house(c("norm_snip")), "house or land, not a flat")
    if f.get("exclude_non_residential"):
        add("commercial", T.looks_like_commercial(c("norm_snip")), "non-residential space, not a flat")
    if f.get("city_required") and city:
        add("city_unconfirmed", ~in_city(city, districts), f"not confirmed to be in search.city {city!r}")
    if city:
        add("locality_mismatch", (c("district") != "") & ~T.has_part(city, c("norm_district")), "locality ", _quoted(c("district")), f" does not mention search.city {city!r}")
    if districts:
        found = lit(False)
        for d in districts:
            found = found | T.has_word(d, c("norm_district"))
        add("district_not_searched", c("district").isNotNull() & ~found, "district ", _quoted(c("district")), " not in search.districts")
    limit = lambda key: f.get(key)
    if (m := limit("min_area_m2")) is not None:
        add("area_small", c("area_m2") < m, "area ", T.general(c("area_m2")), f" m² below min_area_m2 {m}")
    if (m := limit("max_area_m2")) is not None:
        add("area_large", c("area_m2") > m, "area ", T.general(c("area_m2")), f" m² above max_area_m2 {m}")
    if (m := limit("min_price_eur")) is not None:
        add("price_low", c("price_eur") < m, "price ", c("price_eur").cast("string"), f" € below min_price_eur {m} (auction teaser?)")
    if (m := limit("max_price_eur")) is not None:
        add("price_high", c("price_eur") > m, "price ", c("price_eur").cast("string"), f" € above max_price_eur {m}")
    ppm2 = T.price_per_m2(c("price_eur"), c("area_m2"))
    if (m := limit("max_price_per_m2")) is not None:
        add("ppm2_high", ppm2 > m, "price/m² ", T.general(ppm2), f" € above max_price_per_m2 {m}")
    if (m := limit("min_rooms")) is not None:
        try:
            wanted = float(str(m).rstrip("+"))
        except ValueError:
            wanted = 0.0
        add("rooms_few", T.rooms_number(c("rooms")) < wanted, "rooms ", c("rooms"), f" below min_rooms {m}")
    if (m := limit("max_floor")) is not None:
        add("floor_high", c("floor") > m, "floor ", c("floor").cast("string"), f" above max_floor {m}")
    if f.get("exclude_ground_floor"):
        add("ground_floor", c("floor") == 0, "ground floor excluded")
    if f.get("require_balcony"):
        add("no_balcony", ~c("balcony"), "balcony required but listing has none")
    if f.get("allowed_conditions"):
        add("condition", (c("condition") != "unknown") & ~c("condition").isin(*f["allowed_conditions"]), "condition ", _quoted(c("condition")), " not in allowed_conditions")
    for code, key, match in (
        ("banned_street", "banned_streets", lambda b: T.has_word(b, c("norm_street"))),
        ("banned_district", "banned_districts", lambda b: T.has_word(b, c("norm_loc"))),
        ("banned_keyword", "banned_keywords", lambda b: T.has_part(b, c("norm_snip"))),
    ):
        for banned in f.get(key) or []:
            add(code, match(banned), f"{code.replace('_', ' ')} {banned!r}")
    return out


def hard_filter(listings: DataFrame, rules: Mapping) -> DataFrame:
    """Adds drop_code and drop_reason of the first rule that each listing breaks; null for those that stay."""
    bad = violations(rules)
    none = F.lit(None).cast("string")
    code = F.coalesce(*[F.when(v, F.lit(k)) for k, v, _ in bad], none)
    reason = F.coalesce(*[F.when(v, r) for _, v, r in bad], none)
    return with_text(listings).withColumn("drop_code", code).withColumn("drop_reason", reason)


def drop_label(code: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in DROP_LABELS.items() for x in kv])
    return F.when(code.isNotNull(), F.coalesce(labels[code], F.lit("other")))


def drop_histogram(filtered: DataFrame) -> DataFrame:
    """(label, n) of dropped listings."""
    return filtered.where("drop_code IS NOT NULL").groupBy(drop_label(F.col("drop_code")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _signed(n: int) -> str:
    return f"{n:+d}"


def scored(listings: DataFrame, rules: Mapping) -> DataFrame:
    """Adds score (int), breakdown (array of strings) and labels (array with the tier, if any); expects the
    texts of with_text."""
    s = rules.get("scoring") or {}
    c, lit = F.col, F.lit
    terms: list[tuple[Column, Column]] = []

    def flat(hit: Column, bonus: float, what: str) -> None:
        terms.append((F.when(hit, lit(int(bonus))), F.when(hit, lit(f"{_signed(int(bonus))} {what}"))))

    for key, what in (("preferred_streets", "preferred street"), ("preferred_districts", "preferred district")):
        for e in s.get(key) or []:
            flat(T.has_word(e["name"], c("norm_loc")), e.get("bonus", 0), f"{what} {e['name']!r}")
    for e in s.get("preferred_keywords") or []:
        flat(T.has_part(e["name"], c("norm_snip")), e.get("bonus", 0), f"keyword {e['name']!r}")
    for name, bonus in (s.get("condition_bonus") or {}).items():
        if bonus:
            flat(c("condition") == name, bonus, f"condition {name}")
    if s.get("balcony_bonus"):
        flat(c("balcony"), s["balcony_bonus"], "balcony")
    if ref := s.get("price_per_m2_reference"):
        ppm2 = T.price_per_m2(c("price_eur"), c("area_m2"))
        below = (lit(float(ref)) - ppm2) / lit(float(ref)) * 100
        # greatest and least skip nulls, so an unknown price is kept out first.
        bonus = F.when(below.isNotNull(), F.greatest(lit(-PRICE_CAP), F.least(lit(PRICE_CAP), F.rint(below).cast("int"))))
        whole = lambda x: F.rint(x).cast("bigint").cast("string")
        plus = lambda x: F.when(x >= 0, lit("+")).otherwise(lit(""))
        minus = F.when((F.rint(below) == 0) & (below < 0), lit("-0")).otherwise(F.concat(plus(F.rint(below)), whole(below)))
        line = F.concat(plus(bonus), bonus.cast("string"), lit(" price/m² "), whole(ppm2), lit(f" € vs reference {ref} € ("), minus, lit(f"%, capped at ±{PRICE_CAP})"))
        terms.append((bonus, F.when(bonus != 0, line)))
    total = lit(0)
    for value, _ in terms:
        total = total + F.coalesce(value, lit(0))
    lines = F.filter(F.array(*[t for _, t in terms]), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")
    out = listings.withColumn("score", total.cast("int")).withColumn("breakdown", lines)
    return out.withColumn("labels", tier(c("score"), rules))


def tier(score: Column, rules: Mapping) -> Column:
    """The label of the greatest minimum that the score reaches, as an array of one; empty below all. Of equal
    minima the first counts."""
    entries = (rules.get("output") or {}).get("labels_by_score") or []
    out = F.when(F.lit(False), F.array(F.lit("")))
    for e in sorted(entries, key=lambda e: -e.get("min", 0)):
        out = out.when(score >= e.get("min", 0), F.array(F.lit(e["label"])))
    return out.otherwise(F.array().cast("array<string>"))


#: More tiers than anyone would name; they are read to the driver and become conditions.
MOST_TIERS = 500


def tier_join(scores: DataFrame, tiers: DataFrame) -> DataFrame:
    """The same for tiers in a table (min, label), MOST_TIERS at most: adds the label of each score's greatest minimum.
    Of equal minima the first row counts, as in `tier`."""
    rows = tiers.select("min", "label").limit(MOST_TIERS + 1).collect()
    if len(rows) > MOST_TIERS:
        raise ValueError(f"a rule set has {MOST_TIERS} tiers at most")
    label = F.lit(None).cast("string")
    for row in sorted((r for r in reversed(rows) if r["min"] is not None), key=lambda r: r["min"]):
        label = F.when(F.col("score") >= row["min"], F.lit(row["label"])).otherwise(label)
    return scores.withColumn("label", label)


def min_score(rules: Mapping) -> int:
    return int((rules.get("output") or {}).get("min_score_for_issue") or 0)
