import base64

import pytest

from lodeworks.operators import rules as R

RULES = {
    "search": {"city": "Bratislava", "districts": ["Bratislava I"]},
    "filters": {"min_area_m2": 50, "max_price_eur": 300000, "max_price_per_m2": 5000, "min_rooms": 2, "max_floor": 5, "exclude_ground_floor": True, "require_balcony": True, "exclude_houses": True, "exclude_non_residential": True, "allowed_conditions": ["novostavba"], "banned_streets": ["Obchodná"], "banned_districts": ["Rača"], "banned_keywords": ["dražba"]},
    "scoring": {"preferred_districts": [{"name": "Staré Mesto", "bonus": 10.9}], "preferred_keywords": [{"name": "garáž", "bonus": 5}], "condition_bonus": {"novostavba": 3}, "balcony_bonus": 2, "price_per_m2_reference": 4000},
    "output": {"labels_by_score": [{"min": 30, "label": "hot"}, {"min": 10, "label": "match"}]},
}
BASE = dict(id="x", title="3-izbový byt", description_snippet="", price_eur=200000, area_m2=65.0, rooms="3", street=None, district="Bratislava I", floor=2, condition="novostavba", balcony=True)
SCHEMA = "id string, title string, description_snippet string, price_eur bigint, area_m2 double, rooms string, street string, district string, floor int, condition string, balcony boolean"

CASES = [
    ({}, None, None),
    ({"title": "Rodinný dom"}, "house", "house or land, not a flat"),
    ({"title": "byt v bytovom dome"}, None, None),
    ({"title": "Nebytový priestor"}, "commercial", "non-residential space, not a flat"),
    ({"title": "kancelária, byt vhodný"}, None, None),
    ({"district": "Trenčín"}, "locality_mismatch", "locality 'Trenčín' does not mention search.city 'Bratislava'"),
    ({"district": "Bratislava II"}, "district_not_searched", "district 'Bratislava II' not in search.districts"),
    ({"area_m2": 49.5}, "area_small", "area 49.5 m² below min_area_m2 50"),
    ({"price_eur": 300001}, "price_high", "price 300001 € above max_price_eur 300000"),
    ({"price_eur": 280000, "area_m2": 50.0}, "ppm2_high", "price/m² 5600 € above max_price_per_m2 5000"),
    ({"rooms": "1.5"}, "rooms_few", "rooms 1.5 below min_rooms 2"),
    ({"floor": 6}, "floor_high", "floor 6 above max_floor 5"),
    ({"floor": 0}, "ground_floor", "ground floor excluded"),
    ({"floor": -1}, None, None),
    ({"balcony": False}, "no_balcony", "balcony required but listing has none"),
    ({"condition": "povodny_stav"}, "condition", "condition 'povodny_stav' not in allowed_conditions"),
    ({"condition": "unknown"}, None, None),
    ({"street": "obchodna 5"}, "banned_street", "banned street 'Obchodná'"),
    ({"title": "byt, Rača"}, "banned_district", "banned district 'Rača'"),
    ({"title": "byt, Račianska"}, None, None),
    ({"description_snippet": "v dražbe, DRAŽBA"}, "banned_keyword", "banned keyword 'dražba'"),
    (dict.fromkeys(("price_eur", "area_m2", "rooms", "street", "district", "floor", "balcony")), None, None),
]


def test_first_violation_and_reason(spark):
    rows = [tuple((BASE | d | {"id": str(i)}).values()) for i, (d, _, _) in enumerate(CASES)]
    out = R.hard_filter(spark.createDataFrame(rows, SCHEMA), RULES)
    got = {int(r.id): r for r in out.withColumn("label", R.drop_label(out.drop_code)).collect()}
    for i, (d, code, reason) in enumerate(CASES):
        assert (got[i].drop_code, got[i].drop_reason) == (code, reason), d
        assert got[i].label == (R.DROP_LABELS[code] if code else None)
    hist = {r.label: r.n for r in R.drop_histogram(out).collect()}
    assert sum(hist.values()) == sum(c is not None for _, c, _ in CASES)


def test_city_must_be_confirmed(spark):
    rules = {"search": {"city": "Bratislava"}, "filters": {"city_required": True}}
    rows = [tuple((BASE | {"id": k, "title": t, "district": None}).values()) for k, t in (("a", "byt Petržalka"), ("b", "byt Nové Mesto"), ("c", "byt v Bratislave, bratislava"))]
    got = {r.id: r.drop_code for r in R.hard_filter(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got == {"a": None, "b": "city_unconfirmed", "c": None}


def test_scores_and_tiers(spark):
    rows = [tuple((BASE | d).values()) for d in ({"id": "a", "district": "Bratislava I - Staré Mesto", "description_snippet": "Garáž"}, {"id": "b", "price_eur": None, "balcony": None, "condition": "unknown"}, {"id": "c", "price_eur": 600000})]
    out = {r.id: r for r in R.scored(R.with_text(spark.createDataFrame(rows, SCHEMA)), RULES).collect()}
    assert out["a"].score == 10 + 5 + 3 + 2 + 23 and list(out["a"].labels) == ["hot"]
    assert out["a"].breakdown[0] == "+10 preferred district 'Staré Mesto'" and out["a"].breakdown[-1] == "+23 price/m² 3077 € vs reference 4000 € (+23%, capped at ±25)"
    assert out["b"].score == 0 and out["b"].breakdown == [] and out["b"].labels == []
    assert out["c"].score == -25 + 5


@pytest.mark.parametrize(
    "change,key",
    [
        ({"filters": None}, "filters"), ({"filters": {"min_area_m2": "x"}}, "min_area_m2"), ({"filters": {"exclude_houses": None}}, "exclude_houses"), ({"filters": {"allowed_conditions": ["odd"]}}, "allowed_conditions"),
        ({"scoring": {"preferred_streets": [{"name": "x", "bonus": None}]}}, "preferred_streets"), ({"output": {"labels_by_score": [{"min": 1}]}}, "labels_by_score"), ({"search": {"city": 1}}, "city"), ({"output": {"mode": "x"}}, "mode"),
    ],
)
def test_faults_name_the_key(change, key):
    with pytest.raises(R.RulesError, match=key):
        R.validate(RULES | change)


def test_loading_and_override(tmp_path):
    p = tmp_path / "rules.yaml"
    p.write_text("search: {city: Bratislava, districts: [A]}\nfilters: {min_area_m2: 40}\n")
    over = base64.b64encode(b"filters: {max_floor: 3}").decode()
    got = R.load_rules(str(p), {R.OVERRIDE_VARIABLE: over})
    assert got["filters"] == {"min_area_m2": 40, "max_floor": 3}
    for bad in ("###", base64.b64encode(b"[1]").decode()):
        with pytest.raises(R.RulesError, match=R.OVERRIDE_VARIABLE):
            R.load_rules(str(p), {R.OVERRIDE_VARIABLE: bad})
    with pytest.raises(R.RulesError):
        R.load_rules(str(tmp_path / "none.yaml"), {})
    a = {"x": {"y": 1}}
    assert R.deep_merge(a, {"x": {"z": 2}}) == {"x": {"y": 1, "z": 2}} and a == {"x": {"y": 1}}
