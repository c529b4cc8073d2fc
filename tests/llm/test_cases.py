"""NULLs, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haulcost.llm import jaccard, licenses, lines, mixing, neighbours, packing, quality, sharding, surrogates, warc

#: Names that operators use inside; tables may have them too.
CLASHING = ["version", "doc", "size", "key", "class", "root", "rank", "n_words", "_copies", "row", "length", "rate", "kept"]
LONG = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"t{k}" for k in range(80))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every odd kind."""
    rows = [
        (None, WORDS, "en", "a", 1),
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t\x0b ", "en", "b", 4),
        (4, WORDS, "en", "b", 1),
        (5, WORDS, "en", None, 1),
        (6, WORDS + " more", None, "b", 1),
        (7, LONG, "en", "c", len(LONG)),
        (8, "two words", "en", "c", 9),
        (8, "other words under one id", "en", "c", 9),
        (9, "repeated row with more words", "en", "d", 9),
        (9, "repeated row with more words", "en", "d", 9),
        (10, "x" * 300_000, "en", "d", 300_000),
        (11, "ß é 中文 😀 mail@corp.com Licensed under CC BY-NC 4.0.", "de", "e", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({name: F.lit("other") for name in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (4, 0, 0), (None, 0, 0), (7, None, 1), (5, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(frame, column="doc_id"):
    return collections.Counter(r[column] for r in frame.collect())


def test_licenses(spark, odd, clashing, empty):
    model = licenses.train(["plain words of a text"], rounds=60)
    assert [(r.doc_id, r.family) for r in licenses.scan(clashing, model).collect()] == [(11, "CC-BY-NC")]
    assert licenses.background(empty) == [] and licenses.scan(empty, model).count() == 0
    assert licenses.background(odd)


def test_surrogates(odd, clashing, empty):
    out = surrogates.with_surrogates(clashing, "k")
    assert out.columns == [*clashing.columns, "_entities"]
    assert counted(out) == counted(odd)
    found = {r.doc_id: r for r in out.collect()}
    assert found[1].text is None and found[2].text == "" and found[7].text == LONG
    assert "mail@corp.com" not in found[11].text and found[11].text.startswith("ß é 中文 😀 ")
    assert surrogates.with_surrogates(empty, "k").count() == 0


def test_mixing(odd, clashing, empty):
    mixed = mixing.mix(clashing).collect()
    assert counted(mixing.mix(odd)) == counted(odd)
    sizes = {r.doc_id: r["size"] for r in mixed}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[7] == 72_000
    assert all(0 <= r.copies <= 3 for r in mixed)
    assert mixing.mix(empty).count() == 0
    made = mixing.mixed_documents(clashing)
    assert made.columns == clashing.columns
    assert made.count() == sum(r.copies for r in mixed)


def test_quality(odd, clashing, labels, empty):
    rules = quality.learn(clashing, labels)
    rows = quality.judged(clashing, rules).collect()
    assert counted(quality.judged(odd, rules)) == counted(odd)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0 and by_id[1].base_failed
    assert by_id[4].kept and by_id[7].kept and not by_id[8].kept
    assert by_id[10].word_chars == 300_000
    kept = quality.kept_documents(clashing, rules)
    assert kept.columns == clashing.columns
    assert counted(kept) == collections.Counter(r.doc_id for r in rows if r.kept)
    assert quality.learn(odd, labels.limit(0)) == [] and quality.learn(empty, labels) == []
    assert quality.judged(empty, []).count() == 0


def test_sharding(odd, clashing, empty):
    rows = sharding.shards(clashing, 3).collect()
    assert sorted(r.number for r in rows) == list(range(14))
    assert [r["size"] for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert [r.text_crc32 for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert next(r.number for r in rows if r.doc_id is None) == 0
    assert sharding.shards(empty).count() == 0


def test_lines(odd, clashing, empty):
    out = lines.deduped(clashing)
    assert out.columns == [*clashing.columns, "_compared", "_gone"]
    assert counted(out) == counted(odd)
    texts = collections.defaultdict(set)
    for r in out.collect():
        texts[r.doc_id].add(r.text)
    assert texts[1] == {None} and texts[2] == {""} and texts[3] == {" \n\t\x0b "}
    assert texts[None] == {WORDS} and texts[4] == texts[5] == texts[6] == {""}
    assert texts[7] == {LONG.split("\n")[0]} or texts[7] == {LONG}
    assert texts[8] == {"two words", "other words under one id"}
    assert sorted(r.text for r in out.collect() if r.doc_id == 9) == ["", "repeated row with more words"]
    assert lines.deduped(empty).count() == 0


def test_documents_with_a_line_left_stay(spark):
    notice = "Copyright of all these lines is ours"
    rows = [(1, notice), (2, f"{notice}\nmilk\nbread"), (3, f"milk\n{notice}\n \nbread"), (4, "\n"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame, "").collect()}
    assert kept == {1: notice, 2: "milk\nbread", 4: "\n", 5: None}


def test_jaccard(odd, clashing, empty):
    rows = jaccard.jaccard_components(clashing).collect()
    assert collections.Counter(r.doc_id for r in rows) == counted(odd)
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert by_id[1] == {(0, 1)} and by_id[2] == {(0, 2)} and by_id[3] == {(0, 3)}
    assert by_id[4] == {(76, 4)} == by_id[5] and by_id[None] == {(76, 4)} and by_id[6] == {(77, 4)}
    assert by_id[8] == {(1, 8)} and by_id[9] == {(1, 9)} and by_id[10] == {(1, 10)}
    kept = jaccard.one_of_each(clashing)
    assert kept.columns == clashing.columns
    found = counted(kept)
    assert found == collections.Counter([None, 1, 2, 3, 7, 8, 8, 9, 10, 11])
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_archives(spark):
    schema = "page_id long, url string, html string, payload string, digest string"
    big = "z" * 1500
    rows = [(None, None, big, "p", "d"), (1, "u", big, "p", "d"), (1, "u", big, "p", "d"), (2, "u", None, None, None), (3, "u", "", "p", "d"), (4, "v", "é" * 2_000_000, "p", "d")]
    pages = spark.createDataFrame(rows, schema)
    records = warc.page_records(pages).collect()
    assert collections.Counter(r.record_type for r in records) == {"response": 5, "revisit": 1}
    from haulcost.sources.scratch import new_folder

    for frame, n in ((pages, 6), (pages.limit(0), 0)):
        folder = new_folder(spark)
        warc.write_archives(warc.page_records(frame), folder)
        assert warc.read_archives(spark, folder).count() == n


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (10, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, id string, dim int")
    vectors = neighbours.usable(frame, "vec_id", "embedding")
    assert sorted(r.id for r in vectors.collect()) == [1, 2, 9, 9, 10]
    found = neighbours.nearest(vectors, vectors, 5).collect()
    nine = [(9, 1, 1, 0.5), (9, 2, 2, 0.5), (9, 3, 9, 0.5)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted([
        (1, 1, 2, 1.0), (1, 2, 9, 0.5), (1, 3, 9, 0.5), (2, 1, 1, 1.0), (2, 2, 9, 0.5), (2, 3, 9, 0.5), *nine, *nine,
    ])
    none = vectors.limit(0)
    assert neighbours.nearest(none, none).count() == 0


def test_packing(odd, clashing, empty):
    rows = packing.packed(packing.pieces(clashing)).collect()
    assert {r.doc_id for r in rows} == set(counted(odd))
    ends = [r for r in rows if r.doc_id in (1, 2)]
    assert [r.length for r in ends] == [1, 1]
    taken = collections.defaultdict(int)
    for r in rows:
        taken[r.sequence_id] += r.length
    assert max(taken.values()) <= 2048
    assert packing.packed(packing.pieces(empty)).count() == 0


def test_every_stage(spark, odd, clashing, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (clashing, empty):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            before = kept
            kept = stage(spark, before, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert kept.columns == docs.columns
                assert [t for _, t in kept.dtypes] == [t for _, t in docs.dtypes]
            path = str(tmp_path / f"{name} {len(docs.columns)} {docs is empty}")
            kept.write.parquet(path)
            kept = spark.read.parquet(path)
        assert kept.isEmpty() == (docs is empty)
        for _, stage in corpus_pipeline.STAGES:  # each on the odd rows themselves
            stage(spark, docs, str(tmp_path)).count()
