"""Main text of web pages, by templates deduced from equivalence classes of tokens.

A page's tokens are its tags, told apart by the elements around them, and its blocks of
text. A token's occurrence vector says how often it stands on each page of its host.
Tokens that share a vector form a class: what a template writes, it writes together.
A class is valid if it is large (some tags), frequent (some pages) and nests: the
elements around its outermost tokens all belong to one other class. The text tokens of
valid classes are text of the template; what is left are its slots.

Vectors are never put together in one place. A vector is summarised by two sums of
hashes of (page, count), which are added up like any sum, map-side first; equal vectors
have equal sums. So a host of a third of all pages is no larger a group than any other.
Templates are small: a class needs pages, so a host has at most a page's worth of
tokens for every few pages. They meet the pages in a join that Spark plans by size.

Of the slots, the article's are those that elements or class names mark, without what
is set apart (menus, notices, forms, comments and so on), and on pages without any mark
all but lists of links. See :mod:`haulcost.llm.markup`.

Defined cases: a NULL or empty html gives an empty text; a page without a host in its
url is judged by itself, as are hosts with few pages; repeated rows and NULL ids are
rows of their own; an empty table gives no rows. Pages that are copies of one article
keep it: template text is only taken away where it is the smaller part of a page. Only
page_id, url and html are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcost.llm.markup import Page, article, key
from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage

#: Pages and tags that a class needs.
FREQUENT = 8
LARGE = 3
#: Pages a task reads at a time, as a page's tags are larger than the page.
_STEP = 256
_TOKEN = "page long, token long, parent long, label string, n int, chars long, linked long, first long"


def host(url: Column) -> Column:
    """The host of a url in lower case, NULL if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def tokens(pages: DataFrame) -> DataFrame:
    """Every page's tokens with their number on it; pages without a host are left out.

    A text token has no label, and its parent is the element it lies in. The page
    itself is the token 0. ``chars`` and ``linked`` are what text and links an
    element holds itself.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset in range(0, batch.num_rows, _STEP):
                part = batch.slice(offset, _STEP)
                at, rows = [], []
                for i, html in enumerate(part.column("html").to_pylist()):
                    number = key(html or "")
                    page = Page(html or "")
                    own = [(number, 0, None, "", 1, 0, 0, 0)]
                    for token, t in page.tags.items():
                        own.append((number, token, t.parent, t.label, t.n, t.chars, t.linked, t.first))
                    texts: dict[int, list[int]] = {}
                    for block in page.blocks:
                        texts.setdefault(block.token, [block.place, 0])[1] += 1
                    own += [(number, x, place, None, n, 0, 0, 0) for x, (place, n) in texts.items()]
                    rows += own
                    at += [i] * len(own)
                columns = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int32()] + [pa.int64()] * 3
                names = ["page", "token", "parent", "label", "n", "chars", "linked", "first"]
                yield pa.RecordBatch.from_arrays(
                    [part.column("host").take(pa.array(at, pa.int32()))]
                    + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                    names=["host", *names],
                )

    known = take(pages, url="url", html="html").select(host(F.col("url")).alias("host"), "html")
    return known.filter("host is not null").mapInArrow(read, f"host string, {_TOKEN}")


def classes(found: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The tokens of a host that stand on enough pages, with their class.

    ``vector`` is the same for tokens with the same occurrence vector. 31 bits of a
    hash a page leave room to add up two billion pages.
    """

    def summary(seed: int) -> Column:
        return F.sum(F.pmod(F.xxhash64("page", "n", F.lit(seed)), F.lit(1 << 31)))

    return (
        found.groupBy("host", "token", "parent", "label")
        .agg(
            F.count("*").alias("pages"),
            F.sum("n").alias("n"),
            F.sum("chars").alias("chars"),
            F.sum("linked").alias("linked"),
            (F.sum("first") / F.count("*")).alias("first"),
            summary(0).alias("one"),
            summary(1).alias("two"),
        )
        .filter(F.col("pages") >= frequent)
        .withColumn("vector", F.xxhash64("pages", "n", "one", "two"))
        .drop("one", "two")
    )


def nested(found: DataFrame, large: int = LARGE) -> DataFrame:
    """host and vector of every class with the class around it, and whether it is valid.

    ``around`` is NULL for the class of the page itself. A class is not nested where
    its outermost tokens lie in elements of several others, or of one that is too rare
    to have a class. A text only counts as part of what surrounds it.
    """
    around = found.select("host", F.col("token").alias("parent"), F.col("vector").alias("around"))
    tags = found.filter("label is not null").join(around, ["host", "parent"], "left")
    outer = F.when(~F.coalesce(F.col("around") == F.col("vector"), F.lit(False)) & (F.col("token") != 0), F.col("around"))
    unknown = F.col("around").isNull() & (F.col("token") != 0) & F.col("parent").isNotNull()
    labels = F.sort_array(F.collect_list(F.struct("first", "label")))["label"]
    return (
        tags.groupBy("host", "vector")
        .agg(
            F.count("*").alias("tags"),
            F.first("pages").alias("pages"),
            F.min(outer).alias("around"),
            (
                (F.count("*") >= large)
                & F.coalesce(F.min(outer) == F.max(outer), F.lit(True))
                & ~F.max(unknown)
            ).alias("valid"),
            labels.alias("labels"),
        )
    )


def templates(found: DataFrame, large: int = LARGE) -> DataFrame:
    """A row for each host with what its pages need: template text and lists of links.

    ``fixed`` are text tokens of valid classes that stand once on each of their
    pages, ``menus`` elements most of whose text is links.
    """
    valid = nested(found, large).filter("valid").select("host", "vector")
    fixed = found.filter("label is null and n = pages").join(valid, ["host", "vector"])
    menus = found.filter("label is not null and 2 * linked > chars")
    both = fixed.select("host", "token", F.lit(True).alias("text")).unionByName(
        menus.select("host", "token", F.lit(False).alias("text"))
    )
    listed = [
        F.sort_array(F.collect_set(F.when(which, F.col("token")))).alias(name)
        for which, name in ((F.col("text"), "fixed"), (~F.col("text"), "menus"))
    ]
    return both.groupBy("host").agg(*listed)


def extracted(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page, given the templates of the hosts."""
    docs = take(pages, page_id="page_id", url="url", html="html")
    kinds = [docs.schema[x].dataType.simpleString() for x in ("page_id", "url")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
            texts = []
            for i, html in enumerate(batch.column("html")):
                name = batch.column("host")[i].as_py()
                if name not in known:
                    lists = [batch.column(x)[i].as_py() or () for x in ("fixed", "menus")]
                    known[name] = tuple(map(frozenset, lists))
                texts.append(article(Page(html.as_py() or ""), *known[name]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    with_host = docs.withColumn("host", host(F.col("url")))
    return with_host.join(hosts, "host", "left").mapInArrow(
        extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    )


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, with templates from all pages of their hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = cut_lineage(classes(tokens(pages)))
    return extracted(pages, cut_lineage(templates(found)))
