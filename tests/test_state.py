import datetime as dt

from pyspark.sql import functions as F

from lodeworks.operators import state as S

def DAY():
    return F.lit("2026-07-05")


def _now(spark, rows):
    return spark.createDataFrame([(i, *r, "u") for i, r in enumerate(rows)], "seq long, id string, fingerprint string, price_eur long, url string")


def _run(spark, rows, known, content, day="2026-07-05"):
    c = S.classify(_now(spark, rows), known, content)
    status = {r.seq: (r.status, r.previous_price) for r in c.collect()}
    return status, *S.remember(c, known, content, F.lit(day))


def _none(spark):
    return spark.createDataFrame([], S.LISTINGS), spark.createDataFrame([], S.CONTENT)


def test_new_seen_and_price_changes(spark):
    s1, known, content = _run(spark, [("a", "f", 100_000), ("b", None, 200_000), ("c", None, None)], *_none(spark))
    assert {s for s, _ in s1.values()} == {"new"}
    rows = [("a", "f", 101_500), ("b", None, 180_000), ("c", None, 50_000), ("d", "f", 101_000), ("e", "f", 90_000), ("g", "g", 1)]
    s2, known, content = _run(spark, rows, known, content, "2026-07-06")
    assert [s2[i][0] for i in range(6)] == ["seen", "price_change", "seen", "seen", "price_change", "new"]
    assert s2[1][1] == 200_000 and s2[4][1] == 101_000
    first = {r.id: r.first_seen for r in known.collect()}
    assert first["a"] == first["d"] == first["e"] == dt.date(2026, 7, 5) and first["g"] == dt.date(2026, 7, 6)
    assert {r.fingerprint: r.price_eur for r in content.collect()} == {"f": 90_000, "g": 1}


def test_exactly_two_percent_is_no_change_and_null_prices_overwrite(spark):
    _, known, content = _run(spark, [("a", None, 100)], *_none(spark))
    s, known, content = _run(spark, [("a", None, 102)], known, content)
    assert s[0][0] == "seen"
    s, known, content = _run(spark, [("a", None, None)], known, content)
    assert known.first().price_eur is None


def test_matches_a_sequential_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), rng.choice([None, "f", "g", "h"]), rng.choice([None, 100, 101, 110, 130])) for _ in range(60)]
    got, known, content = _run(spark, rows, *_none(spark))
    by_id, by_fp, want = {}, {}, {}
    for i, (id_, fp, price) in enumerate(rows):
        old = by_id.get(id_) or (by_fp.get(fp) if fp else None)
        moved = bool(old and old[0] and price and abs(price - old[0]) / old[0] > 0.02)
        want[i] = ("new" if old is None else "price_change" if moved else "seen", old[0] if old else None)
        by_id[id_] = (price,)
        if fp:
            by_fp[fp] = (price,)
    assert got == want
    assert {r.id: r.price_eur for r in known.collect()} == {k: v[0] for k, v in by_id.items()}


def test_prune_is_strict_at_120_days(spark):
    d = lambda n: dt.date(2026, 7, 5) - dt.timedelta(n)
    rows = [("a", d(300), d(120)), ("b", d(300), d(121)), ("c", d(10), None), ("d", None, None)]
    df = spark.createDataFrame(rows, "id string, first_seen date, last_seen date")
    assert {r.id for r in S.prune(df, DAY()).collect()} == {"a", "c"}


def test_health_streaks_and_alerts(spark):
    health = spark.createDataFrame([], S.HEALTH)
    for n, error in ((0, None), (5, "late failure"), (0, None)):
        runs = spark.createDataFrame([("p", n, error, dt.datetime(2026, 7, 5))], "portal string, count int, error string, at timestamp_ntz")
        health = spark.createDataFrame(S.record_health(runs, health).collect(), S.HEALTH)
    assert [(r.portal, r.zero_streak) for r in S.alerts(health).collect()] == [("p", 3)]
    good = spark.createDataFrame([("p", 1, None, dt.datetime(2026, 7, 6)), ("q", 0, None, dt.datetime(2026, 7, 6))], "portal string, count int, error string, at timestamp_ntz")
    after = {r.portal: r.zero_streak for r in S.record_health(good, health).collect()}
    assert after == {"p": 0, "q": 1}


def test_projects_seed_silently_then_tell(spark):
    P = "slug string, name string, url string, status string, district string"
    known = spark.createDataFrame([], S.PROJECTS)
    first = spark.createDataFrame([("a", "A", "u", "intention", None), ("b", "B", "u", "success", None)], P)
    assert S.project_updates(first, known, None, seeding=True).count() == 0
    known = S.remember_projects(first, known, DAY())
    now = spark.createDataFrame([("a", "A", "u", "construction", None), ("b", "B", "u", "cancelled", None), ("c", "C", "u", "intention", "X")], P)
    got = {r.slug: r.previous_status for r in S.project_updates(now, known, ["construction", "intention"], seeding=False).collect()}
    assert got == {"a": "intention", "c": None}
    after = S.remember_projects(now.where("slug <> 'b'"), known, F.lit("2026-07-06"))
    assert {r.slug: r.status for r in after.collect()} == {"a": "construction", "b": "success", "c": "intention"}
