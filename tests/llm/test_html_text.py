import html
import re
import time

from pyspark.sql import functions as F

from vecroute.llm.html_text import blocks_of, decide, extract, features_used, labelled_blocks, main_text, train_tree
from vecroute.llm.q_html import op6_html_text

SF = "/root/testdata/sf0.001"
ARTICLE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><nav><ul><li><a href="/">Home</a></ul></nav><main><article><h1>Top &amp; all</h1>
<p>One <a href="#">two</a> three.<p>Four&nbsp;five &lt;six&gt;<div class="adSlot">Buy!</div><form><label>Name</label><input></form>
<aside>side</aside><ul><li>item<li>item2</ul><script>var x="<p>no</p>";</script><!-- <p>no</p> --><section id="comments"><p>nice</p></section>
<p hidden>not shown</p><p>la<b>st</b></article></main><footer>foot</footer>"""
PLAIN = """<body><div id=header>Name of site</div><ul class='menu'><li><a href=/>Home</a></ul><div id=content><h1>Title here</h1>
<p>One two three four five six seven eight nine ten. <a href=#>two</a> three.</p><p>Short.</p></div><div class=sidebar>side words</div></body>"""


def test_pages_of_both_kinds(spark):
    tree = train_tree(spark)
    rows = [(1, ARTICLE), (2, PLAIN), (3, None), (4, ""), (5, "no tags at all in this text, just words"), (6, "<p>cut <b"), (1, ARTICLE)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = df.select("page_id", extract(tree, F.col("html")).alias("t")).collect()
    assert len(got) == 7
    found = {r["page_id"]: r["t"] for r in got}
    assert found[1] == "Top & all One two three. Four five <six> item item2 last"
    assert found[2] == "Title here One two three four five six seven eight nine ten. two three. Short."
    assert found[3] == found[4] == ""
    assert found[5] == "no tags at all in this text, just words"
    assert df.limit(0).select(extract(tree, F.col("html"))).count() == 0


def test_hints_on_containers(spark):
    tree = train_tree(spark)
    page = """<body class="has-ads"><main class="page-with-sidebar" data-id="ad-1"><article class="long-form related-none"><p>kept</p></article>
<article class="post has-comments" data-id="comment 7"><p>kept too</p><div class="noSidebar">and this</div></article>
<article class="comment"><p>reader words</p></article><div id="respond" role="complementary">not this</div></main>"""
    assert main_text(page.replace("related-none", ""), tree) == "kept kept too and this"


def test_very_long_page(spark):
    body = "".join(f"<p>paragraph number {i} with some words" for i in range(20_000))
    text = main_text(f"<article>{body}</article>", train_tree(spark))
    assert text.startswith("paragraph number 0 with") and text.endswith("19999 with some words")


def test_all_pages_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op6_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", article).replace("<b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_tree_asks_for_words_and_neighbours(spark):
    tree = train_tree(spark)
    assert {"words", "link_density", "link_density_before", "link_density_after"} <= features_used(tree)
    rows = labelled_blocks()
    assert sum(decide(tree, r[:-1]) == bool(r[-1]) for r in rows) >= 0.97 * len(rows)


def test_pages_without_article_elements(spark):
    """Nothing in these pages names its part: words and links of a block and its neighbours decide."""
    tree = train_tree(spark)
    prose = lambda n, link=0: " ".join(f"w{i}" for i in range(n)) + (f" <a href=#>{' '.join(f'l{i}' for i in range(link))}</a>" if link else "")
    plain = lambda t: " ".join(re.sub("<[^>]*>", "", t).split())
    menu = "".join(f"<div><a href=#>menu{i}</a></div>" for i in range(6))
    body = [prose(9), prose(80), prose(45, 4), prose(120), prose(60, 9), prose(33)]
    foot = "<div>Small print <a href=#>terms of use</a></div><div><a href=#>up</a></div>"
    page = f"<body>{menu}<div><h1>{body[0]}</h1>{''.join(f'<p>{b}</p>' for b in body[1:])}</div>{foot}</body>"
    assert main_text(page, tree) == " ".join(map(plain, body))
    beside = f"<body>{menu}<article><p>Four words in here</p></article><div>{''.join(f'<p>{b}</p>' for b in body[1:])}</div>{foot}</body>"
    assert " ".join(map(plain, body[1:])) in main_text(beside, tree)
    advert = f"<body><div>{prose(66)} buy</div><article><h1>Title</h1>{''.join(f'<p>{b}</p>' for b in body[1:])}</article></body>"
    assert "buy" not in main_text(advert, tree)


def test_runs_of_links_inside_an_article(spark):
    tree = train_tree(spark)
    words = " ".join(f"w{i}" for i in range(40))
    links = "".join(f"<li><a href=#>more about thing {i}</a></li>" for i in range(5))
    assert main_text(f"<article><p>{words}</p><ul>{links}</ul><p>{words}</p></article>", tree).count("thing") <= 1
    assert main_text(f"<article><p>{words}</p><p><a href=#>one link alone</a></p><p>{words}</p></article>", tree) == f"{words} one link alone {words}"


def test_time_is_linear():
    for page in ("<select>" * 20_000, "<b>" * 3000 + "</i>" * 20_000, "<b>" * 3000 + "<div>" + "</b><b>" * 20_000, "<i>" * 20_000 + "<div></div>" * 20_000, "<a href='" * 20_000):
        began = time.perf_counter()
        blocks_of(page)
        assert time.perf_counter() - began < 2
