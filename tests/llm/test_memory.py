"""What an executor's Python workers hold at once."""

from __future__ import annotations

import pyarrow as pa
import pytest

from haulcost.llm import jaccard, packing, quality
from haulcost.sources import scratch


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def documents(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:79], "other"]), "few words", None]
    rows = [(i, text, "s", 7) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")


def test_kept_documents_hand_only_texts_to_python(documents):
    kept = quality.kept_documents(documents, [])
    shown = plan(kept)
    assert "MapInArrow" not in shown  # it takes whole rows there and back
    assert shown.count("ArrowEvalPython") == 1  # each text is counted once
    assert kept.columns == documents.columns
    wanted = [tuple(r) for r in documents.filter("doc_id < 2").collect()]
    assert sorted(tuple(r) for r in kept.collect()) == sorted(wanted)


def test_places_of_pieces_start_no_python_workers(documents):
    packed = packing.packed(packing.stored_pieces(documents))
    shown = plan(packed)
    assert "LocalTableScan" in shown and "ExistingRDD" not in shown
    assert sorted(r.doc_id for r in packed.collect()) == [0, 1, 2, 3]


def test_text_batches_bound_rows_and_end(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def most():
        rows = spark.range(0, 3 * scratch.TEXT_ROWS, 1, 1).mapInArrow(sizes, "n long").collect()
        assert sum(r.n for r in rows) == 3 * scratch.TEXT_ROWS
        return max(r.n for r in rows)

    before = spark.conf.get(scratch.ARROW_ROWS)
    try:
        for now, wanted in (("10000", scratch.TEXT_ROWS), ("0", scratch.TEXT_ROWS), ("10", 10)):
            spark.conf.set(scratch.ARROW_ROWS, now)
            with scratch.text_batches(spark):
                assert most() == wanted
            assert spark.conf.get(scratch.ARROW_ROWS) == now
    finally:
        spark.conf.set(scratch.ARROW_ROWS, before)


def test_operators_on_texts_use_text_batches(spark, documents, monkeypatch):
    seen = []

    def recorded(frame):
        if "MapInArrow" in plan(frame):
            seen.append(int(spark.conf.get(scratch.ARROW_ROWS)))
        return scratch.cut_lineage(frame)

    monkeypatch.setattr(jaccard, "cut_lineage", recorded)
    monkeypatch.setattr(packing, "cut_lineage", recorded)
    assert jaccard.one_of_each(documents).count() == 3
    packing.packed(packing.stored_pieces(documents))
    assert len(seen) >= 4  # statistics, sets, verified pairs and pieces
    assert max(seen) <= scratch.TEXT_ROWS
    assert int(spark.conf.get(scratch.ARROW_ROWS)) > scratch.TEXT_ROWS
