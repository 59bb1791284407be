import json

import pytest
from pyspark.sql import functions as F

from lodeworks import cli
from lodeworks.functions import text as T
from lodeworks.operators import enrich, extract, rules as R
from lodeworks.plans import pipeline, publish, report
from lodeworks.queries.common import RULES
from lodeworks.sources import pages as P, store
from lodeworks.streaming import changes

CARD = '<div class="inzeraty"><h2><a href="/inzerat/{id}/x.php">{title}</a></h2><div class="popis">{text}</div><div class="inzeratycena">{price}</div><div class="inzeratylok">Bratislava I</div></div>'
OPEN_RULES = {"search": {"city": "Bratislava"}, "filters": {"max_price_eur": 500000}, "output": {"mode": "digest"}}
PAGE = "portal string, page_no int, url string, status int, html string"


def _page(*cards, portal="bazos", no=1, status=200):
    return (portal, no, "u", status, "".join(CARD.format(**dict(zip(("id", "title", "text", "price"), c))) for c in cards))


def test_parsers(spark):
    cases = ["3 izbový byt, 68,5 m², 185 000 € (2 701 €/m²), 5/8 posch", "Garsónka, prízemie, bez  balkónov 185.000,- EUR", "Cena dohodou 9 €", "5-izbový 2. NP lodžia 1 200 m2", "", None, "90 m³ 5 min"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    n = T.normalise(F.col("t"))
    got = [tuple(r) for r in df.select(T.price(F.col("t")), T.area(F.col("t")), T.rooms(n), T.floor_of(n), T.balcony(n)).collect()]
    assert got[0] == (185000, 68.5, "3", 8, None) and got[1] == (185000, None, "1", 0, False)
    assert got[2][0] is None and got[3] == (5, 200.0, "4+", 1, True)
    assert got[4] == got[5] == (None,) * 5 and got[6][1] is None


def test_accent_table_matches_unicodedata(spark):
    words = ["Obchodná", "Čunovo", "Ľubľana", "ÅÉîø", "m²", "a b", "Łódź", "ß"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(T.normalise(F.col("t"))).collect()]
    assert got == [T.plain(w) for w in words]


def test_general_numbers_and_rounding(spark):
    xs = [68.5, 68.0, 0.1, 123456.7, 1234567.0, 2e-5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(T.general(F.col("x"))).collect()]
    assert got == [f"{x:g}" for x in xs]


@pytest.mark.parametrize("portal", list(extract.EXTRACTORS))
def test_junk_gives_no_cards(portal):
    for junk in ("", "<html><div", "<a href='/x'>y</a>", "<div class='inzeraty'>"):
        assert list(extract.EXTRACTORS[portal](extract.parse(junk))) == []


def test_neighbours_price_is_never_taken():
    html = "<div><div><a href='/byt/1234567'>Prvý byt</a></div><div><a href='/byt/7654321'>Druhý byt</a><b>100 000 €</b></div><div><a href='/byt/5555555'>Tretí</a><b>200 000 €</b></div></div>"
    got = {c["raw_id"]: c["price_text"] for c in extract.byty_cards(extract.parse(html))}
    assert "100 000" in got["7654321"] and got["1234567"] == ""


def test_runs_over_days(spark, tmp_path):
    root = str(tmp_path / "state")
    pages = spark.createDataFrame([_page((11111, "3-izbový byt", "68 m², novostavba", "185 000 €"), (22222, "2-izbový byt", "50 m²", "900 000 €")), _page(portal="byty", status=503)], PAGE)
    done = pipeline.run(pages, None, store.load_state(spark, root), OPEN_RULES, "2026-07-05")
    (item,) = done.items.collect()
    assert (item.id, item.price_eur, item.area_m2, item.rooms, item.condition, item.status) == ("bazos:11111", 185000, 68.0, "3", "novostavba", "new")
    assert {r.label: r.n for r in done.dropped.collect()} == {"price too high": 1}
    assert {r.portal: (r.zero_streak, r.last_error) for r in done.state["health"].collect()} == {"bazos": (0, None), "byty": (1, "blocked: HTTP 503")}
    to = report.Recorder()
    pipeline.publish(done, OPEN_RULES, to, "2026-07-05")
    assert to.issues[0][0] == "1 new Bratislava flat(s) - 2026-07-05" and "| 0 | 185 000 € | 68 m² | 3 |" in to.issues[0][1] and len(to.messages) == 1
    store.append_archive(done.items, str(tmp_path / "archive"), "2026-07-05")
    assert "185 000 €" in store.archive_page(spark, str(tmp_path / "archive"), "2026-07")
    store.save_state(done.state, root)
    done.close()
    again = spark.createDataFrame([_page((33333, "3-izbový byt", "68 m², novostavba", "170 000 €"))], PAGE)
    done = pipeline.run(again, None, store.load_state(spark, root), OPEN_RULES, "2026-07-06")
    (item,) = done.items.collect()
    assert item.status == "price_change" and (item.price_change.old, item.price_change.new) == (185000, 170000) and item.labels == ["price-drop"]
    done.close()


def test_stream_of_pages(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([_page((11111, "3-izbový byt", "68 m²", "185 000 €"))], PAGE).write.parquet(src)
    seen = []
    q = changes.watch(spark.readStream.schema(PAGE).parquet(src), str(tmp_path / "s"), str(tmp_path / "c"), OPEN_RULES, lambda: "2026-07-05", lambda items, n: seen.append(items.count()))
    q.awaitTermination(100)
    assert seen == [1] and store.load_state(spark, str(tmp_path / "s"))["listings"].count() == 1


def test_enrichment_fills_gaps_only(spark):
    S = "id string, title string, price_eur long, area_m2 double, rooms string, street string, district string, floor int, condition string, balcony boolean"
    rows = [(k, "t", p, None, None, None, None, None, "unknown", None) for k, p in (("a", None), ("b", 5), ("c", None), ("d", None))]
    answers = [("a", json.dumps({"price_eur": 10, "condition": "novostavba", "balcony": False, "summary": "s" * 400})), ("b", json.dumps({"price_eur": 9, "condition": "odd"})), ("c", "[1]"), ("d", json.dumps({"price_eur": -1}))]
    got = {r.id: r for r in enrich.merge(spark.createDataFrame(rows, S), spark.createDataFrame(answers, "id string, json string")).collect()}
    assert (got["a"].price_eur, got["a"].condition, got["a"].balcony, len(got["a"].ai.summary)) == (10, "novostavba", False, 300)
    assert got["b"].price_eur == 5 and got["b"].condition == "unknown" and got["c"].price_eur is None and got["d"].price_eur is None
    calls = []
    assert enrich.ask([("x", "t")] * 9, lambda t: calls.append(t) or 1 / 0) == [] and len(calls) == 3


def test_page_loop(spark):
    rows = [("p", 1, "a"), ("p", 1, "a"), ("p", 2, "a"), ("p", 2, "b"), ("p", 3, "b"), ("q", 1, "a"), ("q", 2, "a"), ("q", 3, "z")]
    got = sorted(tuple(r) for r in P.paged(spark.createDataFrame(rows, "portal string, page_no int, id string")).select("portal", "page_no", "id").collect())
    assert got == [("p", 1, "a"), ("p", 1, "a"), ("p", 2, "b"), ("q", 1, "a")]


def test_sources(spark):
    assert P.search_url("bazos", RULES, 3).endswith("/40/?hledat=Bratislava&cenado=250000")
    assert P.robots_allow("http://x/y", None) and not P.robots_allow("http://x/y", "User-agent: *\nDisallow: /")
    fetch = lambda portal, page: ("u", 200, "h") if page == 1 else None
    spark.dataSource.register(P.page_source(fetch))
    assert spark.read.format("captured_pages").load().count() == len(extract.PORTALS)


def test_legacy_state_is_read(spark):
    t = store.import_json(spark, json.dumps({"bazos:1": {"first_seen": "2026-01-01", "url": "u", "price_eur": 5}}))
    assert t["listings"].first().price_eur == 5 and t["content"].count() == 0
    assert store.import_json(spark, "[]")["listings"].count() == 0


def test_broken_markup_loses_only_its_card(spark):
    good = CARD.format(id=11111, title="3-izbový byt", text="68 m²", price="185 000 €")
    assert [c["raw_id"] for c in extract.bazos_cards(extract.parse("<![foo[ bar" + good))] == ["11111"]
    cards = "".join(f'<div class="project-list-result intention"><h3><a href="{h}">P</a></h3></div>' for h in ("http://[x/y", "/projekt/b"))
    assert [c.get("slug") for c in extract.project_cards(extract.parse(cards))] == [None, "b"]
    out = extract.projects(spark.createDataFrame([(cards,), ("<![x[",), (None,)], "html string")).collect()
    assert [r.slug for r in out] == ["b"]


def test_cards_that_cannot_be_cut_are_counted(spark, monkeypatch):
    def bad(root):
        return extract.each(root.all("div"), lambda n: 1 / 0 if n.attrs.get("id") else {"url": "u"})

    monkeypatch.setitem(extract.EXTRACTORS, "bazos", bad)
    pages = spark.createDataFrame([("bazos", 1, "u", 200, "<div></div><div id=x></div><div id=y></div>")], PAGE)
    assert extract.cards(pages).count() == 1 and [tuple(r) for r in extract.broken_cards(pages).collect()] == [("bazos", 2)]


def test_text_mined_without_a_price():
    html = "<div><div><p><a href='/byt/1234567'>Prvý byt</a></p><i>3 izby 70 m2</i></div><div><a href='/byt/7654321'>Druhý byt</a> 1 € 2 €</div></div>"
    got = {c["raw_id"]: c["info_text"] for c in extract.byty_cards(extract.parse(html))}
    assert got == {"1234567": "Prvý byt 3 izby 70 m2", "7654321": "Druhý byt"}


class Session:
    """Answers of an HTTP session, by the end of the address."""

    def __init__(self, **answers):
        self.answers, self.calls = answers, []

    def _answer(self, url, **k):
        self.calls.append((url, k))
        got = self.answers[url.rsplit("/", 1)[1]]
        if isinstance(got, Exception):
            raise got
        status, body = got
        return type("Answer", (), {"status_code": status, "json": lambda self: body})()

    get = post = _answer


ENV = {"GITHUB_TOKEN": "t", "GITHUB_REPOSITORY": "a/b", "TELEGRAM_BOT_TOKEN": "k", "TELEGRAM_CHAT_ID": "7"}


def test_services_send_or_say_that_they_did_not():
    s = Session(labels=(422, {}), issues=(201, {"number": 5}), sendMessage=(200, {}))
    to = publish.Services(s, ENV)
    to.ensure_labels([("hot", "E11D48", "x"), ("hot", "E11D48", "x")])
    assert to.create_issue("t", "b", ["hot"]) == 5 and to.send_message("m") and len(s.calls) == 3
    assert s.calls[0][0].endswith("/repos/a/b/labels") and s.calls[2][1]["json"]["chat_id"] == "7"
    for session, env in ((Session(labels=(500, {}), issues=(500, {}), sendMessage=(400, {})), ENV), (Session(labels=OSError(), issues=OSError(), sendMessage=OSError()), ENV), (None, {})):
        to = publish.Services(session, env)
        to.ensure_labels([("hot", "E11D48", "x")])
        assert to.create_issue("t", "b", []) is None and to.open_titles("x") == [] and not to.send_message("m") and not to.done


def test_open_alerts_are_looked_up(spark):
    to = publish.Services(Session(issues=(200, [{"title": "bazos: 0 listings"}])), ENV)
    titles = spark.createDataFrame([(t,) for t in to.open_titles("scraper-broken")], "title string")
    alerts = spark.createDataFrame([("bazos", 3), ("byty", 4)], "portal string, zero_streak int")
    assert [r.portal for r in report.unreported(alerts, titles).collect()] == ["byty"]


def test_a_polite_fetcher_asks_robots_and_waits():
    asked, slept = [], []

    def get(url, timeout):
        asked.append((url, timeout))
        if url.endswith("robots.txt"):
            if "bazos" in url:
                raise OSError
            return (200, "User-agent: *\nDisallow: /byty/") if "byty.sk" in url else (404, "")
        if "topreality" in url:
            raise OSError
        return 200, "h"

    fetch = P.PoliteFetcher(get, RULES, sleep=slept.append, draw=lambda a, b: a)
    assert [fetch("bazos", k)[1] for k in (1, 2, 3)] == [200, 200, 200] and slept == [3.0, 3.0]
    assert fetch("byty", 1)[1] == P.DISALLOWED and fetch("topreality", 1)[1] == P.UNREACHABLE
    assert sum(u.endswith("robots.txt") for u, _ in asked) == 3 and {t for _, t in asked} == {30.0}


def test_providers_are_asked_by_schema(spark):
    body = {"candidates": [{"content": {"parts": [{"text": '{"rooms": "3"}'}]}}]}
    s = Session(x=(200, body))
    provider = enrich.http_provider(s.post, "http://h/x", "key")
    df = spark.createDataFrame([("a", "Byt", "Pekný", {"info": "70 m2", "locality": ""})], "id string, title string, description_snippet string, raw map<string,string>")
    assert [tuple(r) for r in enrich.answers(df, provider).collect()] == [("a", '{"rooms": "3"}')]
    sent = s.calls[0][1]["json"]
    assert "Byt Pekný 70 m2" in sent["contents"][0]["parts"][0]["text"] and sent["generationConfig"]["responseSchema"]["properties"]["floor"] == {"type": "integer", "nullable": True}
    assert enrich.answers(df, enrich.http_provider(Session(x=(500, {})).post, "http://h/x", "key")).count() == 0 and enrich.answers(df, None).count() == 0


def test_command_line(spark, tmp_path):
    rules = tmp_path / "rules.yaml"
    rules.write_text(json.dumps(OPEN_RULES))
    spark.createDataFrame([_page((11111, "3-izbový byt", "68 m², novostavba", "185 000 €"))], PAGE).write.parquet(str(tmp_path / "pages"))
    args = ["--rules", str(rules), "--pages", str(tmp_path / "pages"), "--state", str(tmp_path / "state"), "--archive", str(tmp_path / "archive")]
    go = lambda more, to, env=None: cli.run(cli.arguments([*args, *more]), lambda: spark, to, env or {}, today="2026-07-05")
    assert go(["--validate-rules"], None) == 0
    to = report.Recorder()
    assert go(["--dry-run"], to) == 0 and go([], to, {"DRY_RUN": "yes"}) == 0 and not to.issues and not (tmp_path / "state").exists()
    assert go([], to) == 0 and len(to.issues) == 1 and (tmp_path / "archive").exists()
    assert go([], to) == 0 and len(to.issues) == 1  # seen by now
    rules.write_text("filters: 5")
    assert go([], to) == 2


def test_first_of_equal_tiers_counts(spark):
    tiers = spark.createDataFrame([(5, "first"), (9, "high"), (5, "second")], "min int, label string").coalesce(1)
    got = {r.score: r.label for r in R.tier_join(spark.createDataFrame([(4,), (5,), (9,), (None,)], "score int"), tiers).collect()}
    assert got == {4: None, 5: "first", 9: "high", None: None}
