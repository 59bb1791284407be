import itertools
import time

from lodeworks.llm import html_wrappers as hw

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><header class="site-header"><a href="/">Home</a></header>
<div id="cookie-notice">We use cookies</div><main><article><h1>Title {n} &amp; more</h1><p>Some   text {n}<p>Other <a href=x>link</a> text.<ul><li>one<li>two</ul>
<aside>Side</aside><div class="share-buttons">Share</div><form><label>Mail</label><input></form></article><section id="comments"><h2>Comments</h2><p>bad comment</p></section></main>
<div class="sidebar"><p>sb</p></div><footer>f</footer></body></html>"""
WANT = "Title {n} & more\nSome text {n}\nOther link text.\none\ntwo"


def test_article_alone_is_read(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.replace("{n}", str(i)), "t") for i in range(12)]
    rows += [(100, None, None, None), (101, "http://b.example", "", None), (102, "x", "<p>a<", None), (103, "http://c.example/", "<div>" * 5000 + "deep", None)]
    out = {r.page_id: r for r in hw.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)).collect()}
    assert all(out[i].text == WANT.replace("{n}", str(i)) for i in range(12))
    assert out[100].text == "" and out[101].text == "" and out[102].text == "a<" and out[103].text == "deep"


def _wrapper(pages):
    w = ({}, set(), 0)
    for page in pages:
        w = hw.widened(w, (*hw.aligned(page), 1))
    return w


def test_alignment_makes_optional_repeated_and_groups():
    w = _wrapper(["<div><h1>x</h1><p>1</p></div>", "<div><h1>x</h1><p>1</p><p>2</p><i>z</i></div>"])
    assert hw.expression(*w) == "div[h1[#] p[#]+ i[#]?]"
    w = _wrapper(["<div><h2>a</h2><p>1</p><h2>b</h2><p>2</p></div>", "<div><h2>a</h2><p>1</p></div><footer>f</footer>"])
    assert hw.expression(*w) == "div[(h2[#]+ p[#]+)+] footer?"


def test_any_order_of_pages_gives_the_same_wrapper():
    pages = ["<div><h1>x</h1><p>a</p></div>", "<div><p>b</p><i>c</i></div>", "<div><i>d</i><h1>x</h1></div>", PAGE.replace("{n}", "1"), "<p>e<p>f", ""]
    want = _wrapper(pages)
    for order in itertools.permutations(pages):
        w = _wrapper(order)
        assert w == want and hw.kept_parts(*w) == hw.kept_parts(*want)
    assert hw.widened(_wrapper(pages[:3]), _wrapper(pages[3:])) == want


def test_partitions_and_copies_change_nothing(spark):
    page = "<html><body><div class=top>Same on all</div><div class=text><p>Own words of page {0}.</p><dl><dt><a href=x>Term {0}</a></dt><dd>What it means {0}.</dd><dt><a href=y>Other {0}</a></dt><dd>And this {0}.</dd></dl></div></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(i)) for i in range(8)] * 2
    for parts in (1, 3, 7):
        out = hw.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
        assert len(out) == 16 and all(r.text == f"Own words of page {r.page_id}.\nTerm {r.page_id}\nWhat it means {r.page_id}.\nOther {r.page_id}\nAnd this {r.page_id}." for r in out)


def test_names_of_the_page_do_not_drop_the_article(spark):
    inner = "<article class='post comments-open'><header class='entry-header'><h1>Title {0}</h1></header><p>Text {0}</p><div class='post-footer'>F</div></article><div class='widget-area sidebar-primary'>S</div>"
    bodies = ["<body class='single no-sidebar'>", "<body class='has-sidebar'>", "<body class='sidebar'>", "<body><div class='menu-open more'>", "<body><div class='sidebar-layout'>"]
    assert _texts(spark, [b + inner.format(i) for i, b in enumerate(bodies)]) == {i: f"Title {i}\nText {i}" for i in range(len(bodies))}


def test_elements_of_any_depth(spark):
    deep = "<div>" * 300 + "<nav>MENU</nav><p>text</p><aside>SIDE</aside>" + "</div>" * 300 + "<p>after</p>"
    assert _texts(spark, [deep, "<section>" * 20_000 + "x", "</b>" * 1000 + "<b>" * 5000 + "y"]) == {0: "text\nafter", 1: "x", 2: "y"}


def test_many_siblings_take_linear_time():
    page = "<div>" + "".join(f"<p class={'ab'[i % 2]}>t{i}</p>" for i in range(20_000)) + "</div>"
    began = time.process_time()
    w = _wrapper([page, page + "<i>z</i>"])
    assert len(hw.kept_parts(*w)) == 3 and time.process_time() - began < 5


def test_clashing_columns_stay(spark):
    names = ["slots", "host", "key", "doc", "salt", "rows"]
    df = spark.createDataFrame([(1, "https://h/", "<p>t", *range(6))], "page_id long, url string, html string, " + ", ".join(f"{n} int" for n in names))
    r = hw.main_text(df).first().asDict()
    assert r["text"] == "t" and [r[n] for n in names] == list(range(6))


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    page = "<html><body><ul><li><a href=/>Home</a></li></ul><div class=text><p>Text {0}.</p></div></body></html>"
    monkeypatch.setattr(hw, "BROADCAST_BYTES", 0)
    assert _texts(spark, [page.format(i) for i in range(9)]) == {i: f"Text {i}." for i in range(9)}


def test_empty(spark):
    assert hw.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(spark, pages):
    rows = [(i, f"https://h.example/{i}", page) for i, page in enumerate(pages)]
    out = hw.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return {r.page_id: r.text for r in out}


def test_every_layout_of_a_host_keeps_its_article(spark):
    bodies = ["<article class='post category {}'><p>{}</p></article>", "<main><p>{1}</p></main>", "<div class=content><p>{1}</p></div>", "<div class=text><p>{1}</p></div>"]
    words = [f"Words of page {i} that are its own and long enough" * 3 for i in range(24)]
    pages = ["<html><body><div class=x>" + bodies[i % 4].format(("news", "sport")[i // 4 % 2], w) + "</div><footer>f</footer></body></html>" for i, w in enumerate(words)]
    assert _texts(spark, pages) == dict(enumerate(words))


def test_an_article_keeps_its_lead(spark):
    page = "<html><body><div class=intro>Not in it {0}</div><article><p>Lead of {0}.</p><div class=body><p>" + "Long text of {0}. " * 20 + "</p></div><section><p>Second part of {0}.</p></section></article></body></html>"
    out = _texts(spark, [page.format(i) for i in range(12)])
    assert all(t.startswith(f"Lead of {i}.\nLong text of {i}.") and t.endswith(f"\nSecond part of {i}.") for i, t in out.items())


def test_inline_links_stay_without_an_article(spark):
    page = "<html><body><ul><li><a href=/>Home</a></li><li><a href=/b>Page {0}</a></li></ul><div class=text><p>Other <a href=x>link</a> text {0}.</p><p>See <a href=y>there {0}</a> for all of it.</p></div></body></html>"
    assert _texts(spark, [page.format(i) for i in range(12)]) == {i: f"Other link text {i}.\nSee there {i} for all of it." for i in range(12)}
