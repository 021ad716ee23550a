import html
import re

from geotables.llm.html_text import extract_main_text, main_text
from geotables.llm.queries import op9_html_extraction

SF = "/root/testdata/sf0.01"


def test_given_pages_against_their_article_elements(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", "\n", inner))
        want[r.page_id] = " ".join(html.unescape(inner).split())
    got = {r.page_id: r for r in op9_html_extraction(spark, SF).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_parts_that_are_no_article():
    page = """<html><body class="page with-sidebar"><header><h1>Site</h1></header><form><div class="cookie-notice">We use</div>
      <div class=ad>Buy<main><h1>T&eacute;st &amp; x</h1><p>Body <i>te</i>xt<p>more&nbsp;text
      <script>var a="<p>no</p>"</script><aside>rel</aside><form><input>name</form><section id="comments"><article>nope
      </article></section><select><option>1</select><noscript>js</noscript></main></form><footer>f</footer>"""
    assert main_text(page, frozenset()) == "Tést & x Body text more text"
    assert main_text("plain &lt; <3 text", frozenset()) == "plain < <3 text"
    assert main_text("", frozenset()) == main_text(None, frozenset()) == ""
    assert main_text("<article>" + "<p>word " * 20_000, frozenset()) == " ".join(["word"] * 20_000)
    assert main_text('<article><p title="a>b">x</p><br>y<!-- z --></article>', frozenset()) == "x y"


def test_template_of_a_host_names_the_main_slot(spark):
    def page(i, words):
        return (f'<html><body><div class="top"><a href="/">home {i}</a></div><div class="x1"><div class="x2"><p>{words}</p>'
                f'</div></div><div class="x3">imprint and more of it, the same on every page, and long as well {i % 2}</div>')

    rows = [(i, f"https://u@Host.example:80/{i}", page(i, f"text {i} " * 40), "old", 1) for i in range(6)]
    short = (99, "http://host.example/z", page(9, "short"), "old", 1)
    df = spark.createDataFrame([*rows, short, short, (7, None, None, "old", 1)],
                               "page_id bigint, url string, html string, text string, main int")
    out = extract_main_text(df).collect()
    assert len(out) == 9
    for r in out:
        want = "" if r.page_id == 7 else "short" if r.page_id == 99 else " ".join(f"text {r.page_id}" for _ in range(40))
        assert r.text == want and r.n_chars == len(want)
    assert extract_main_text(df.limit(0)).collect() == []


def test_salted_join_gives_the_same(spark, monkeypatch):
    import geotables.llm.html_text as module
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60)
    want = sorted(map(tuple, extract_main_text(pages).collect()))
    monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, extract_main_text(pages).collect())) == want


def test_names_are_hints_for_small_parts():
    body = "<p>" + "real text " * 20 + "</p>"
    text = " ".join(["real text"] * 20)
    for name in ("content with-sidebar", "no-comments", "has-widget", "related-topic", "comments", "sidebar", "widget"):
        assert main_text(f'<body><div class="{name}">{body}</div></body>', frozenset()) == text
        assert main_text(f'<body><div class="{name}"><article>{body}</article></div></body>', frozenset()) == text
    assert main_text(f"<body><form><div>{body}</div></form></body>", frozenset()) == text
    for name in ("commentary", "social-history", "search", "alert", "banner"):
        assert main_text(f'<article>{body}<p class="{name}">more</p></article>', frozenset()) == f"{text} more"
    for name in ("comments", "comment-list", "cookie-notice", "share-buttons", "related-posts"):
        assert main_text(f'<article>{body}<div class="{name}">no</div></article>', frozenset()) == text


def test_sibling_containers_and_recurring_slots(spark):
    def siblings(i):
        return (f'<html><body><div class="y1"><a href="/">home {i}</a></div><div class="y2"><p>lead {"one " * 30}{i}</p></div>'
                f'<div class="y3"><p>body {"two " * 60}{i}</p></div><div class="y4">imprint of it</div></body></html>')

    def article(i):
        notice = "another" if i == 9 else "Subscribe to our letter"
        return f'<html><body><article><h1>t {i}</h1><div class="z1">{notice}</div><p>text {"word " * 30}{i}</p></article>'

    hosts = {"siblings": (siblings, 6), "article": (article, 20), "copies": (lambda i: article(1), 6),
             "few": (siblings, 1)}
    rows = [(f"{h}-{i}", f"https://{h}.example/{i}", make(i)) for h, (make, n) in hosts.items() for i in range(n)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id string, url string, html string"))
           .collect()}
    lead, body, text = "lead " + "one " * 30, "body " + "two " * 60, "text " + "word " * 30
    for i in range(6):
        assert got[f"siblings-{i}"] == f"{lead}{i} {body}{i}"
    for i in range(20):
        assert got[f"article-{i}"] == (f"t {i} another {text}{i}" if i == 9 else f"t {i} {text}{i}")
    assert lead in got["few-0"] and body in got["few-0"]
    assert all(got[f"copies-{i}"] == f"t 1 Subscribe to our letter {text}1" for i in range(6))
