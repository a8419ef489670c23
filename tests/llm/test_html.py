import pytest

from docloom.llm import html_tree
from docloom.llm.html_tree import Page


def text(html):
    return Page(html).main_text()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a>Home</a></header>
<nav><ul><li>Menu</li></ul></nav><!-- ad --><div class="ad">Buy</div><aside>Side</aside><div id="cookie-notice">Cookies</div>
<article><h1>Title &amp; more</h1><p><b>One&nbsp;  two.<br><p>Three &copy; four</p><div class="comments"><p>First!</p></div><form><input>Go</form></article>
<section id="comments"><p>Reader says</p></section><footer>Foot</footer></body></html>"""


def test_article_alone():
    assert text(PAGE) == "Title & more\nOne two.\nThree © four"


def test_edges():
    assert text("") == ""
    assert text("plain  text") == "plain text"
    assert text("<p>a<p>b") == "a\nb"
    assert text("<p>1 < 2 and &am &amp x") == "1 < 2 and &am & x"
    assert text("<article><p>open") == "open"
    assert text("<ul><li>a<li>b</ul>") == "a\nb"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text('<p title="a>b">x</p>') == "x"
    assert text("<p>a</p></div></p><p>b") == "a\nb"
    assert text("<script>if (a<b) {}") == ""
    assert text("<div " + "a" * 10000) != None  # noqa: E711


def test_names():
    assert text('<div class="content with-sidebar no-ads"><article><p>Kept</p></article></div>') == "Kept"
    assert text('<article><header class="article-header"><h1>T</h1><p>By me</p></header><p>x</p></article>') == "T\nx"
    assert text('<article><div class="post-header"><h2>T</h2><span>date</span></div><h3 class="header">U</h3><p>x</p></article>') == "T\nU\nx"
    assert text('<article><p>x</p><div class="shareButtons sharing">Share</div><div class="loading">y</div><article class="comment"><p>z</p></article></article>') == "x\ny"
    assert text('<div role="banner">B</div><p hidden>h</p><p style="display: none">n</p><p>x</p>') == "x"


def test_main_without_article():
    assert text("<body><div>Noise</div><main><p>Kept</p></main></body>") == "Kept"


def test_tree_removes_templates(spark):
    # a styled branch that all pages of a host repeat, with no telling name, goes; bodies stay, even where pages are copies
    pages = [(i, f"http://h.example/{i}", f'<body><div class="zz9">Same words everywhere</div><div class="yy8"><p>Own text {i % 40} of the page</p></div></body>') for i in range(60)]
    pages += [(100, "http://other.example/", "<div class='zz9'>Same words everywhere</div>"), (101, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_tree.main_texts(df).collect()}
    assert got[3] == "Own text 3 of the page" and got[43] == "Own text 3 of the page"
    assert got[100] == "Same words everywhere" and got[101] == ""
    tree = html_tree.style_tree(df).collect()
    assert all(-1e-9 <= r["importance"] <= 1 + 1e-9 for r in tree)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_tree.main_texts(df).count() == 0


@pytest.mark.parametrize("url,host", [("https://u@A.example:8/x", "a.example"), ("nonsense", ""), (None, "")])
def test_host(spark, url, host):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(html_tree.host_of(F.col("u"))).first()[0] == host


def brute_tree(rows):
    """(host, path) to importance by counting, from the same parse."""
    import math

    pages = {}
    for _, url, html in rows:
        p = Page(html or "", tree=True, known=set())
        pages.setdefault((url.split("/")[2], p.main_text()), p)
    out = {}
    for host in {h for h, _ in pages} | {None}:
        own = [p for (h, _), p in pages.items() if host in (None, h)]
        hosts = [h for h, _ in pages if host in (None, h)]
        chains = {k: c for p in own for k, (c, _) in p.chains.items()}
        for path in chains:
            kinds, texts = {}, {}
            for h, p in zip(hosts, own):
                if path in p.kinds:
                    kinds["|".join(p.kinds[path])] = kinds.get("|".join(p.kinds[path]), 0) + 1
                for leaf, mark in p.features:
                    if path in chains[leaf]:
                        texts[leaf, mark] = texts.get((leaf, mark), 0) + 1
            n = sum(kinds.values())
            look = 1.0 if n <= 1 else -sum(k / n * math.log(k / n) for k in kinds.values()) / math.log(n)
            said = sum(k * (1 - min(1, math.log(k) / math.log(html_tree.REPEATED))) for k in texts.values()) / sum(texts.values()) if texts else 0.0
            out[host, path] = (n, round(look, 9), round(said, 9), round(0.1 * look + 0.9 * said, 9))
    return out


def test_importance_equals_brute_force(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(90):
        ads = f'<div class="q{r.randint(0, 2)}"><p>Ad {r.randint(0, 6)}</p>{"<ul><li>x<li>y</ul>" * r.randint(0, 1)}</div>'
        body = "".join(f"<p>{'<b>Note</b> ' * r.randint(0, 1)}Words {r.randint(0, 300)}</p>" for _ in range(r.randint(0, 5)))
        rows.append((i, f"http://h{r.randint(0, 3)}.example/{i}", f"<html><body><nav>Menu {r.randint(0, 1)}</nav>{ads}<article><h1>T{i}</h1>{body}</article>tail {i % 3}</body></html>"))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(10)]
    got = {(x["host"], x["path"]): (x["pages"], round(x["presentation"], 9), round(x["content"], 9), round(x["importance"], 9)) for x in html_tree.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_tree(rows)
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k]))


def texts_of(spark, pages, **more):
    return {r["page_id"]: r["text"] for r in html_tree.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string"), **more).collect()}


def test_unnamed_templates_beside_and_in_articles(spark):
    html = lambda i: f"""<html><body><div class="k1"><p>Our shop {i % 2}</p></div><div><ul><li>One</li><li>Two {i % 3}</li></ul></div>
      <article><h1>Title {i}</h1><h2>Summary</h2><p>Text {i}.</p><div class="k2"><p>Read our rules</p></div><p>More {i}.</p><ul><li>Send</li><li>Print</li></ul></article><section class="k3">End {i % 2}</section></body></html>"""  # noqa: E731
    got = texts_of(spark, [(i, f"http://h.example/{i}", html(i)) for i in range(80)])
    assert all(t == f"Title {i}\nSummary\nText {i}.\nMore {i}." for i, t in got.items())
    # the same without articles
    plain = lambda i: html(i).replace("<article>", '<div class="z">').replace("</article>", "</div>")
    got = texts_of(spark, [(i, f"http://h.example/{i}", plain(i)) for i in range(80)])
    assert all(t == f"Title {i}\nSummary\nText {i}.\nMore {i}." for i, t in got.items())


def test_small_hosts_borrow_from_all(spark):
    # two pages a host, a few shared unnamed templates
    html = lambda i: f'<html><body><div class="k1">Offer {i % 7}</div><div class="z"><p>Own {i}</p><p>Also {i}</p></div></body></html>'
    got = texts_of(spark, [(i, f"http://h{i // 2}.example/{i}", html(i)) for i in range(160)])
    assert all(t == f"Own {i}\nAlso {i}" for i, t in got.items())


def test_marked_branches_and_text_outside_articles(spark):
    # a marked branch whose texts and make-up are each page's own stays, as does such text beside the article; templates go
    part = lambda i, k: "".join(f"<p>{k} {i} {j}</p>" + "<ul><li>a</ul>" * (j % 3 == i % 3) for j in range(1 + i % 6))
    html = lambda i: f'<html><body><nav><a>Home</a></nav><div class="story sidebar">{part(i, "Story")}</div><article><p>Main {i}</p></article><div id="comments"><p>Reader {i}</p></div><footer>Us</footer></body></html>'
    got = texts_of(spark, [(i, f"http://h.example/{i}", html(i)) for i in range(300)])
    assert all(f"Main {i}" in t and "Home" not in t and "Us" not in t and "Reader" not in t for i, t in got.items())
    # few pages: marks and the article decide
    got = texts_of(spark, [(i, f"http://h{i}.example/{i}", html(i)) for i in range(4)])
    assert all(t == f"Main {i}" for i, t in got.items())


def test_tree_decides_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    on = {r["page_id"]: r["text"] for r in html_tree.main_texts(pages).collect()}
    off = {r["page_id"]: r["text"] for r in html_tree.main_texts(pages, low=-1.0, marked=-1.0, outside=-1.0).collect()}
    assert sum(on[i] != off[i] for i in on) > 0.9 * len(on)


def test_main_around_articles():
    assert text("<body><div>Noise</div><main><p>Lead</p><article><p>Body</p></article><p>End</p></main><div>Noise</div></body>") == "Lead\nBody\nEnd"


def test_deep_nesting():
    assert text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    p = Page("<div>" * 3000 + "x", tree=True, known=set())
    assert max(len(c) for c, _ in p.chains.values()) <= html_tree.DEPTH
