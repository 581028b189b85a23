import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from cuemill.functions.web import domain_in, page_blocks, unescape, url_host
from cuemill.operators.sentences import html_article_text, html_paragraphs


def test_url_host(column):
    urls = ["https://www.reuters.com/a?b#c", "http://a.b:8080/x", "reuters.com/x", "//cdn.x.org/a", "",
            "ftp://www.www.x.com", "https://u:p@host/x", "mailto:a@b.c", "http://x.com?q", None]
    assert column(urls, url_host("t")) == [
        None if u is None else urlparse(u).netloc.replace("www.", "") for u in urls]
    assert column(["https://www.cnbc.com/x", "https://x.cnbc.com"], domain_in("t", ["cnbc.com"])) == [
        True, False]


def test_unescape(column):
    texts = ["a &amp; b", "&amp;lt;", "&lt;p&gt;", "&#8364;&#x20AC;x &#xe9;", "&#; &#xZZ; &#55296;",
             "&quot;&nbsp;&copy;", "plain", None, "&#0000065;&#1114111;&#x10FFFF;", "&#1114112;&#x110000;&#0;",
             "&#99999999999999999999999;&#x0000000000041;"]
    assert column(texts, unescape("t")) == [
        "a & b", "&lt;", "<p>", "€€x é", "&#; &#xZZ; �", '"\xa0©', "plain", None, "A\U0010ffff\U0010ffff", "���", "�A"]


PAGE = """<html><head><script>var a = "<p>never see these six words here</p>";</script></head><body>
<!-- <p>nor any of these six words</p> -->
<article><p>One two three <b>four</b> five six.</p><br><p class="x">Seven eight nine, ten &amp; eleven twelve</p>
<p>too short</p>
<P>Please sign up for free right now today</P>
A line of its own with words
</article><section>Section text of six words here</section></body></html>"""


def test_html_paragraphs(spark):
    df = spark.createDataFrame([(1, "u,1", "T,x", PAGE), (2, "u2", None, None), (3, "u3", "t", "")],
                               "page_id int, url string, title string, html string")
    rows = [(r["page_id"], r["text"]) for r in
            html_paragraphs(df).orderBy("page_id", "pos").collect()]
    texts = [t for _, t in rows]
    assert texts[0] == "One two three four five six."
    assert texts[1] == "Seven eight nine, ten & eleven twelve"
    # The article is one line, since no line break lies inside a text node; a phrase drops it whole.
    assert texts[2:] == ["Section text of six words here"]
    assert not any("never" in t or "nor any" in t or "sign up" in t.lower() or t == "too short"
                   for t in texts)
    # Without phrases, paragraph text comes again in the line of its block.
    again = [r["text"] for r in html_paragraphs(df, phrases=("nothing",)).collect()]
    assert sum("One two three" in t for t in again) == 2
    assert len(html_paragraphs(df, blocks=False).collect()) == 2

    full = {r["page_id"]: r for r in html_article_text(df).collect()}
    assert full[1]["title"] == "T x" and full[1]["url"] == "u,1"
    assert "," not in full[1]["text"] and "\n" not in full[1]["text"]
    assert full[1]["text"] == " ".join(texts).replace(",", " ")
    assert full[3]["text"] == ""


def test_page_jobs_do_not_shuffle(spark):
    df = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                               F.lit("t").alias("title"), F.lit(PAGE).alias("html"))
    for out in (html_paragraphs(df), html_article_text(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_block_lines(spark):
    """Tags go before lines are cut; only a line break inside a text node cuts."""
    html = """<article><b>one two three</b>
<i>four five six</i> <a
href="http://x.example/y">seven</a> eight
nine ten © eleven twelve thirteen fourteen<br>

</article><section>&nbsp;<b>&lt;one two&gt; three</b> four five six</section>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = [r["text"] for r in html_paragraphs(df, phrases=("©",)).orderBy("pos").collect()]
    assert rows == ["one two three four five six seven eight", "<one two> three four five six"]


def stack_blocks(html):
    """Text of every p, then article, then section, by a stack of open elements."""
    nodes, tags = re.split("<[^>]*>", html), re.findall("<[^>]*>", html)
    open_, found = [], []
    for i, tag in enumerate(tags, 1):
        name = re.match(r"</?([A-Za-z][^\s/>]*)?", tag)[1]
        if not name or tag.endswith("/>") or name.lower() in ("br", "hr", "img"):
            continue
        name = name.lower()
        if tag[1] != "/":
            open_.append((name, i))
        elif name in [n for n, _ in open_]:
            while True:
                inner, first = open_.pop()
                found.append((inner, first, i))
                if inner == name:
                    break
    found += [(n, i, len(tags) + 1) for n, i in open_]
    text = lambda a, b: " ".join(t.strip() for t in nodes[a:b] if t.strip())
    return [text(a, b) for kind in ("p", "article", "section") for n, a, b in sorted(found, key=lambda f: f[1]) if n == kind]


@pytest.mark.parametrize("html, wanted", [
    ("<section>a<section>b</section>c</section>", ["a b c", "b"]),
    ("<p>a<p>b</p>c", ["a b c", "b"]),
    ("<div><p>a</div>b</p>c", ["a"]),
    ("<p>x<div><p>a</div>b</p>c", ["x a b", "a"]),
    ("<article><p>a<b>b<p>c</p>d</article>e<p/>f", ["a b c d", "c", "a b c d"]),
    ("</p></p>a<P class='x'>b<BR>c", ["b c"]), ("plain", []), ("<p></p>", [""])])
def test_nested_and_unclosed_elements(column, html, wanted):
    assert stack_blocks(html) == wanted
    assert column([html], page_blocks("t")) == [wanted]


def test_random_markup_equals_a_stack(column):
    rng = random.Random(4)
    tags = ["<p>", "</p>", "<article>", "</article>", "<section x>", "</section>", "<div>", "</div>", "<b>", "</b>", "<br>", "<p/>", "a", "b ", " "]
    pages = ["".join(rng.choice(tags) for _ in range(rng.randrange(40))) for _ in range(400)]
    found = column(pages, page_blocks("t"))
    assert found == [[" ".join(t.split()) for t in stack_blocks(p)] for p in pages]
    long = "<p>" * 2000 + "x" + "</p>" * 1999
    assert [len(v) for v in column([long], page_blocks("t"))] == [2000]
