"""Main text of pages: the reader on odd markup, classes against literal vectors, templates."""

from __future__ import annotations

import collections
import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from haulcost.llm import extraction, markup

SCHEMA = "page_id long, url string, html string"
SHELL = (
    "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t='</p><p>no';</script></head><body>"
    "<header><a href=/>Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class='cookie-banner'>We use cookies</div>"
    "%s<aside>Side</aside><form><label>Mail<input name=x></label></form><section id=comments><article class=comment><p>First!</p></article></section>"
    "<footer>&copy; all</footer></body></html>"
)


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<article><h1>Head</h1><p>One &lt;b&gt; &amp;amp; two<p>Three<br>four</article>", "Head\n\nOne <b> &amp; two\n\nThree four"),
        ("<main><div class=ad>Buy</div><p>In <b>bo</b>ld <span class='ad-slot'>x</span>text</p></main>", "In bold text"),
        ("<article><header><h1>H</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "H\n\na\n\nb\n\nc\n\nd"),
        ("<div><p>No mark at all, but plain words &nbsp; here</p><ul><li><a>x</a></li></ul></div>", "No mark at all, but plain words here"),
        ("<article><!-- <p>gone</p> --><p>a < b and 1<2 &bogus; &#x41;</p></article>", "a < b and 1<2 &bogus; A"),
        ("<article class='post has-sidebar'><p title='a>b' data-x=\"<p>\">t</p><script>x('<p>')</script></article>", "t"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article></article>", ""),
    ],
)
def test_reading(inside, text):
    assert markup.article(markup.Page(SHELL % inside)) == text


def test_nothing_and_damaged_pages():
    read = lambda x: markup.article(markup.Page(x))
    assert read("<") == "<" and read("") == read("<!-- open") == read("<script>x") == read("<p") == ""
    assert read("plain text") == "plain text"
    assert read('<p class="open>x</p><p>after</p>').endswith("after")
    assert read("</p></div></b>text</article>") == "text"
    assert read("<p>a\x00b \ud800 c</p>") == "a\x00b \ud800 c"


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, "<a " * 300_000, "<a \"" * 300_000, "<p>x" * 200_000, "</div>" * 200_000, "<!-" * 300_000,
     "<b><p>" * 100_000, "<li>" * 200_000, "<" * 900_000, "<div><span class=ad>" * 60_000, "<script>" * 100_000, "x " * 1_000_000],
    ids=lambda x: x[:12],
)
def test_time_is_in_proportion_to_the_page(page):
    begin = time.monotonic()
    markup.article(markup.Page(page))
    assert time.monotonic() - begin < 20


def site(n, notice="Sign up for our letter today", host="h.example.org"):
    body = "<html><body><div><p>%s</p></div><article><h1>Title %d</h1>%s<p>%s</p></article></body></html>"
    return [
        (i, f"http://{host}/{i}", body % ("Top words of all pages", i, "".join(f"<p>words {i} of paragraph {k}, which is long</p>" for k in range(1 + i % 4)), notice))
        for i in range(n)
    ]


def test_template_text_goes_and_copies_stay(spark, tmp_path):
    rows = site(20) + [(100 + i, f"https://copies.example.org/{i}", site(1)[0][2]) for i in range(30)]
    rows += [(200, None, site(1)[0][2]), (201, "http://few.example.org/", site(1)[0][2])]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r for r in extraction.op13_html_extraction(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i in range(20):
        want = [f"Title {i}"] + [f"words {i} of paragraph {k}, which is long" for k in range(1 + i % 4)]
        assert found[i].text == "\n\n".join(want), "the notice stands on every page of the host"
        assert found[i].n_chars == len(found[i].text)
    whole = "Title 0\n\nwords 0 of paragraph 0, which is long\n\nSign up for our letter today"
    assert {found[i].text for i in (*range(100, 130), 200, 201)} == {whole}


def test_classes_against_literal_vectors(spark):
    rows = site(12) + site(9, "Other", "g.example.org") + [(90, "http://h.example.org/odd", "<html><body>odd</body></html>")]
    vectors = collections.defaultdict(collections.Counter)
    for i, (_, url, html) in enumerate(rows):
        name = re.sub("^http://|/.*", "", url[7:])
        page = markup.Page(html)
        vectors[name, 0][i] += 1
        for token, tag in page.tags.items():
            vectors[name, token][i] += tag.n
        for block in page.blocks:
            vectors[name, block.token][i] += 1
    want = collections.defaultdict(set)
    for (name, token), vector in vectors.items():
        if len(vector) >= 8:
            want[name, frozenset(vector.items())].add(token)
    found = extraction.cut_lineage(extraction.classes(extraction.tokens(spark.createDataFrame(rows, SCHEMA).repartition(3))))
    made = collections.defaultdict(set)
    for r in found.collect():
        made[r.host, r.vector].add(r.token)
    assert sorted(map(sorted, made.values())) == sorted(map(sorted, want.values()))
    nested = [r for r in extraction.nested(found).collect() if r.host == "h.example.org"]
    page = next(r for r in nested if "<body>" in r.labels)
    article = next(r for r in nested if "<article>" in r.labels)
    assert page.valid and page.around is None and article.valid and article.around == page.vector
    assert article.labels.index("<article>") < article.labels.index("<h1>") < article.labels.index("</article>")


def test_test_pages_give_their_article(spark):
    import os

    folder = os.environ.get("HAULCOST_TESTDATA", "/root/testdata/sf0.01")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in extraction.op13_html_extraction(spark, folder).collect():
        inside = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("</?b>", "", inside.replace("<br>", " ")))
        assert r.text == "\n\n".join(filter(None, (" ".join(unescape(b).split()) for b in blocks)))


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "no url", "<p>x</p>"), (3, "http://", "<p>y</p>"),
            (4, "HTTP://User@H.example.org:80/x", "<p>" + "long " * 400_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {x: F.lit("other") for x in ("host", "token", "page", "text", "fixed", "menus", "n", "label", "first")}
    )
    hosts = {r.page_id: r.host for r in frame.select("page_id", extraction.host(F.col("url")).alias("host")).collect()}
    assert hosts == {None: None, 1: None, 2: None, 3: None, 4: "h.example.org"}
    for name, data in (("odd", frame), ("empty", frame.limit(0))):
        data.write.parquet(str(tmp_path / name / "pages.parquet"))
        found = extraction.op13_html_extraction(spark, str(tmp_path / name))
        assert found.columns == ["page_id", "url", "text", "n_chars"]
        texts = collections.Counter((r.page_id, r.n_chars) for r in found.collect())
        want = {(None, 0): 1, (1, 0): 2, (2, 1): 1, (3, 1): 1, (4, 1_999_999): 1}
        assert texts == (want if name == "odd" else {})
