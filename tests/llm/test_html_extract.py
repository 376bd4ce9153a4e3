"""Extraction against a plain reading of the test pages, a host without meaningful markup, broken pages, edge cases."""

import html
import random
import re

from facadelake.llm import html_extract as h

ROOT = "/root/testdata/sf0.01"


def test_whole_table(spark):
    pages = spark.read.parquet(f"{ROOT}/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert got[r.page_id] == "\n\n".join(b for b in want if b)


def page(rng, i, nav, body):
    """A host's page without telling names: a link list, a slogan, the story, a closing."""
    links = "".join(f'<li><a href="/{x}">{x} {x}s</a></li>' for x in nav[: rng.randrange(3, 9)])
    story = "".join(f"<p>{b}</p>" for b in body)
    return f'<html><body><div id="x1"><ul>{links}</ul></div><div id="x2">Best site in town</div><div id="q{i % 3}"><div id="x3"><h2>{body[0][:20]}</h2>{story}<p>Thank you for reading us</p></div></div><div id="x4">Call &amp; ask</div></body></html>'


def test_template_without_names(spark):
    rng = random.Random(3)
    nav = [f"topic{j}" for j in range(9)]
    bodies = [[" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(8, 60))) for _ in range(rng.randrange(1, 6))] for _ in range(40)]
    rows = [(i, f"https://plain.example.org/p{i}", page(rng, i, nav, b)) for i, b in enumerate(bodies)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).selectExpr("*", "1 AS host", "2 AS key", "3 AS main")
    template = h.templates(docs).first()
    assert template.host == "plain.example.org" and template.main.endswith("div.x")  # names lose their digits
    for r in h.extract(docs).collect():
        assert r.text == "\n\n".join([bodies[r.page_id][0][:20].strip(), *bodies[r.page_id]]), r.page_id


def test_markup():
    parts = '<h1>T &lt;1&gt;</h1><p class="lead">a<b>b</b>\n c&nbsp;d<br/>e<div class="share-buttons">tweet</div><aside>x</aside><p>f<ul><li>g<li>h</ul><form><p>no</form><section id="comments"><p>me too</section>'
    source = f'<!doctype html><head><title>no</title><style>p{{}}</style><body class="with-sidebar"><!-- <p>no --><header><p>no</header><nav>no</nav><main>{parts}</main><div class="cookie-notice">no</div><script>"<p>no</p>"</script><footer>no'
    assert h.main_text(source) == "T <1>\n\nab c d e\n\nf\n\ng\n\nh"
    assert h.main_text("plain words only") == "plain words only"
    assert h.main_text("<p>open <i>tag <p>a < b & c > d</p") == "open tag\n\na < b & c > d"
    assert h.main_text('<div hidden>x</div><div style="display: none">y</div><p title="a > b">z</p>') == "z"
    assert h.main_text("<div " * 3000 + "x") == h.main_text("<a title='" * 3000) == ""
    assert h.main_text("<script>never closed <p>no") == ""
    assert len(h.main_text("<div>" * 5000 + "deep" + "</div>" * 5000)) == 4


def test_edges(spark):
    rows = [(1, "http://a.example/x", None), (2, None, ""), (3, "no host", "<p>one</p>"), (3, "no host", "<p>one</p>"), (None, "http://a.example/y", "<p>" + "é " * 300_000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.url or "", len(r.text)) for r in h.extract(docs).collect()))
    assert got == [(0, "http://a.example/y", 599_999), (1, "http://a.example/x", 0), (2, "", 0), (3, "no host", 3), (3, "no host", 3)]
    assert h.extract(docs.limit(0)).count() == 0


def test_template_inside_article(spark):
    """Boilerplate in the article goes by the host's template, on a host of six pages, too: a slogan, a list of links, one closing text."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(6):
        body = [" ".join(f"w{rng.randrange(900)}" for _ in range(30)) for _ in range(3)]
        links = "".join(f'<li><a href="/{j}">other{i}{j} piece</a></li>' for j in range(4))
        rows.append((i, f"https://six.example.org/p{i}", f"<html><body><main><div class=a>Best site</div><article><h1>{body[0][:9]}</h1>{''.join(f'<p>{b}</p>' for b in body)}<ul>{links}</ul><p>Thank you all</p></article></main></body></html>"))
        want[i] = "\n\n".join([body[0][:9].strip(), *body])
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(docs).collect()} == want
    copies = docs.where("page_id = 0").selectExpr("explode(sequence(1, 8)) AS page_id", "url", "html")
    assert all(body in r.text for r in h.extract(copies.selectExpr("cast(page_id AS long) AS page_id", "url", "html")).collect() for body in want[0].split("\n\n"))


def test_layouts(spark):
    """Three layouts on one host, an empty page, and one page of another body class: each large layout keeps its template."""
    rng = random.Random(7)
    nav = [f"topic{j}" for j in range(9)]
    bodies = [[" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(8, 60))) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    rows = [(i, f"https://big.example.org/p{i}", page(rng, i, nav, b).replace("<body>", f'<body class="{"abc"[i % 3]}">')) for i, b in enumerate(bodies)]
    rows += [(100, "https://big.example.org/e", ""), (101, "https://big.example.org/o", '<html><body class="z"><div>alone</div></body></html>')]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got.pop(100) == "" and got.pop(101) == "alone"
    assert got == {i: "\n\n".join([b[0][:20].strip(), *b]) for i, b in enumerate(bodies)}


def test_one_empty_page(spark):
    """Text without telling names keeps its template beside an empty page and a page of few elements."""
    rng = random.Random(9)
    bodies = [[" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(3)] for _ in range(40)]
    rows = [(i, f"https://plain.example.org/p{i}", page(rng, i, ["a", "b", "c", "d"], b)) for i, b in enumerate(bodies)]
    rows += [(50, "https://plain.example.org/e", "")]
    template = h.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(template) == 1 and template[0].pages == 40 and template[0].main.endswith("div.x")
