import random
import time

import numpy as np
import pytest

from verdictlake.llm import html_extract as h

PAGE = (
    '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First   sentence of\nthe text, which is long enough.<br>More &eacute; text follows here.<p>Second one.</p></article>'
    '<section class="comments"><p>I liked this.</p><p>Me too, thanks.</p></section><footer>&copy; someone</footer></body></html>'
)


def test_page():
    assert h.main_text(PAGE, h.trained()) == "A & B\nFirst sentence of the text, which is long enough. More é text follows here.\nSecond one."


def test_held_out_generated_pages():
    rng, right, total = random.Random(4242), 0, 0
    for _ in range(150):
        nodes, labels = h.labelled(h._generated(rng))
        kept = set(h.decode(nodes, h.trained().probabilities(h.features(nodes))))
        for i, x in enumerate(nodes):
            if x.tag == "#text":
                total += 1
                right += (i in kept) == (labels[i] == h.KEEP)
    assert right / total > 0.97


def test_decoding_against_all_labellings():
    """Small trees of any shape: the decoding is the most probable labelling without contradictions."""
    rng, random_p, tried = random.Random(5), np.random.default_rng(1), 0
    for _ in range(400):
        nodes = [h.Node("html", -1, 0)]
        for i in range(1, rng.randint(2, 8)):
            parent = rng.randrange(i)
            if nodes[parent].tag == "#text":
                parent = 0
            nodes[parent].children.append(i)
            nodes.append(h.Node(rng.choice(["div", "#text"]), parent, 0, "", [], "x"))
        nodes = _in_page_order(nodes)
        p = random_p.dirichlet([1, 1, 1], len(nodes))
        scores = sorted(_assignments(nodes, p, 0), key=lambda x: -x[0])
        assert set(h.decode(nodes, p)) == scores[0][1]
        tried += len(scores) > 1
    assert tried > 300


def _in_page_order(nodes):
    out = []

    def walk(i, parent):
        x = nodes[i]
        out.append(h.Node(x.tag, parent, 0, "", [], x.text))
        at = len(out) - 1
        for c in x.children:
            out[at].children.append(walk(c, at))
        return at

    walk(0, -1)
    return out


def _assignments(nodes, p, i):
    import math

    below = [j for j in range(i, len(nodes)) if _under(nodes, j, i)]
    for k in (h.KEEP, h.DROP):
        yield sum(math.log(p[j][k]) for j in below), {j for j in below if nodes[j].tag == "#text" and k == h.KEEP}
    if nodes[i].children:
        best = [max(_assignments(nodes, p, c), key=lambda x: x[0]) for c in nodes[i].children]
        yield math.log(p[i][h.MIXED]) + sum(b[0] for b in best), set().union(*(b[1] for b in best))


def _under(nodes, j, i):
    while j > i:
        j = nodes[j].parent
    return j == i


def test_malformed_pages_do_not_fail():
    for page in ("", "<", "<p", '<p title="a>b">x', "<script>if(a<b)", "<ul><li>a<li>b</ul>", "</div></div>x", "<!-- open", "<table><tr><td>a<td>b<tr><td>c", "<div>" * 3000 + "x", "&#0;&#x110000;&bogus;"):
        assert isinstance(h.main_text(page, h.trained()), str)
    assert [x.text for x in h.parse("<table><tr><td>a<td>b<tr><td>c") if x.tag == "#text"] == ["a", "b", "c"]


def test_query_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "", 1), (3, "w", PAGE * 50, 1)], "page_id long, url string, html string, text int")
    rows = h.extract(pages).collect()
    assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["text"] for r in rows if r["page_id"] in (2, None)} == {""}
    assert h.extract(pages.limit(0)).count() == 0


# Pages written by hand, not by the generator that the trees learn from: (html, main text).
BY_HAND = [
    (
        "<!doctype html><html><head><title>No end of the head</title><body><nav><a href=/>Home</a> <a href=/a>About</a></nav>"
        "<article><h1>Rain in spring</h1><p>It rained for three days, and the river rose.<p>On the fourth day the sun came out.</article><footer>&copy; 2020 The Paper</footer>",
        "Rain in spring\nIt rained for three days, and the river rose.\nOn the fourth day the sun came out.",
    ),
    (
        '<body><header class="site-header"><h1>Journal</h1></header><main><article class="post-content"><h1>Energy</h1>'
        "<p>Energy equals <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as <button>we</button> know.</p>"
        '<div class="related-work"><h2>Related work</h2><p>Others have measured this before, with larger errors, and in other units.</p></div>'
        '<p class="notice">Readers should note that the units of the table are metres, not feet.</p></article></main>'
        '<aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></aside></body>',
        "Energy\nEnergy equals mc2 as we know.\nRelated work\nOthers have measured this before, with larger errors, and in other units.\n"
        "Readers should note that the units of the table are metres, not feet.",
    ),
    (
        '<html><body><div id="cookie-banner"><p>We use cookies to improve the site. <a href="#">Accept</a></p></div><div class="menu"><ul><li><a href="/x">X</a></li><li><a href="/y">Y</a></li></ul></div>'
        '<div class="entry-content"><h2>A recipe</h2><p>Mix flour and water, then wait for an hour.</p><svg width="1"/><ul><li>200 g of flour</li><li>100 g of water</li></ul><p>Bake it until it is brown, and serve it warm.</p></div>'
        '<form class="newsletter"><p>Get our mail</p><input name="m"></form><div class="footer">Copyright, all rights reserved. <a href="/legal">Legal</a></div></body></html>',
        "A recipe\nMix flour and water, then wait for an hour.\n200 g of flour\n100 g of water\nBake it until it is brown, and serve it warm.",
    ),
    (
        '<body><article><h1>Bridge opens</h1><p>The bridge was opened on Monday, after two years of work.</p><div class="ad">Buy shoes now, cheap and good.</div>'
        '<p>Thousands walked over it, some of them twice.</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>Great news, well done.</p></div><div class="comment"><p>It took long enough.</p></div></section>'
        "<script>document.write('<p>never</p>')</script></body>",
        "Bridge opens\nThe bridge was opened on Monday, after two years of work.\nThousands walked over it, some of them twice.",
    ),
    (
        "<article><h1>Tables</h1><p>Two rows are in it: first &lt;b&gt;, then &#8364;&nbsp;5.</p><table><tr><td>a<td>1<tr><td>b<td>2</table><p>An open <select><option>x</select> list and an <svg><path d=''> image, left open."
        "<p>The text goes on after it, and ends here.</article>",
        "Tables\nTwo rows are in it: first <b>, then € 5.\na\n1\nb\n2\nAn open list and an image, left open.\nThe text goes on after it, and ends here.",
    ),
]


@pytest.mark.parametrize("html, text", BY_HAND)
def test_pages_written_by_hand(html, text):
    assert h.main_text(html, h.trained()) == text


def test_time_grows_with_the_length():
    n = 20_000
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<div>" * n + "<li>" * n + "<hr>" * n, "<svg>" * n + "<title>" * n, "<p" * n, "<a '>" * n, "<!--" * n):
        start = time.process_time()
        h.parse(page)
        assert time.process_time() - start < 5


def test_pages_table():
    """Every page of the test table gives its article and nothing else."""
    import duckdb

    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        assert h.main_text(page, h.trained()) == "\n".join(x.text for x in h.parse(article) if x.tag == "#text")
