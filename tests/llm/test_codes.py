"""Vector codes, against plain Lloyd rounds in whole numbers."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from haulcost.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(vectors, positions, entries, rounds):
    """Codes and codebooks of (id, whole numbers) by plain loops."""
    vectors = sorted(vectors, key=lambda v: (v[0] is None, v[0], v[1]))
    width = len(vectors[0][1]) // positions
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in vectors[:entries]] for p in range(positions)]
    away = lambda x, y: sum((i - j) ** 2 for i, j in zip(x, y, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (away(cut(v, p), books[p][e]), e)) for p in range(positions)] for _, v in vectors]

    for _ in range(rounds):
        found = assign()
        for p in range(positions):
            for e in range(len(books[p])):
                members = [cut(v, p) for (_, v), code in zip(vectors, found, strict=True) if code[p] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = assign()
    errors = [sum(away(cut(v, p), books[p][c[p]]) for p in range(positions)) for (_, v), c in zip(vectors, found, strict=True)]
    return vectors, found, errors, books


@pytest.mark.parametrize("positions, entries, rounds, dimension", [(2, 3, 2, 4), (4, 5, 3, 8), (1, 2, 0, 3)])
def test_against_plain_rounds(spark, positions, entries, rounds, dimension):
    draw = random.Random(positions)
    rows = [(i, [draw.choice([-1.5, -0.3, 0.0, 0.2, draw.uniform(-2, 2)]) for _ in range(dimension)], i % 2) for i in range(60)]
    rows += [(100 + i, [0.25] * dimension, None) for i in range(40)]  # a hot vector
    rows.append((3, rows[7][1], 1))  # a repeated id
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = codes.whole_vectors(frame, "vec_id", "embedding", "label")
    coded, books = codes.compressed(whole, positions, entries, rounds)
    made = collections.Counter((r.vec_id, tuple(r.code), r.error) for r in whole.join(coded, "row").collect())
    numbers = [(r.vec_id, list(r.whole)) for r in whole.collect()]
    vectors, found, errors, want = lloyd(numbers, positions, entries, rounds)
    assert books == want
    assert made == collections.Counter((v[0], tuple(c), e) for v, c, e in zip(vectors, found, errors, strict=True))


def test_only_members_that_change_are_moved(spark):
    rows = [(i, [float(i % 7), float(i % 5)], 0) for i in range(200)]
    whole = codes.whole_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
    parts = whole.select("row", F.posexplode(F.array("whole")).alias("position", "part"), F.lit(0).alias("entry"))
    books = [[[0, 0], [1500, 900]]]
    assigned = codes._assigned(parts, books)
    settled = codes._settled(assigned, 4, 2)
    plan = settled._jdf.queryExecution().optimizedPlan().toString()
    union = plan[plan.index("Union") :]
    assert union.count("RepartitionByExpression") == 1 and "RepartitionByExpression" in union.split("MapInArrow")[1]
    assert settled.count() == 200
    changed = assigned.filter("nearest <> entry").count()
    assert 0 < changed < 200
    assert {(r.position, r.entry) for r in settled.collect()} == {(0, 0), (0, 1)}


def test_floors_go_down(spark):
    frame = spark.createDataFrame([(1, [-0.001, 0.001, -1.0, 0.999], 0)], SCHEMA)
    assert codes.whole_vectors(frame, "vec_id", "embedding", "label").first().whole == [-1, 0, -256, 255]


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (None, [1.0, 1.0], 1), (1, [1.0, 2.0], None), (1, [1.0, 2.0], None), (2, None, 1), (3, [nan, 1.0], 1),
        (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 2.0, 3.0], 1), (7, [], 1), (8, [1e30, 0.0], 1), (9, [0.0, 0.0], 2),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {x: F.lit("other") for x in ("row", "position", "part", "entry", "nearest", "error", "code", "whole")}
    )
    whole = codes.whole_vectors(frame, "vec_id", "embedding", "label")
    coded, books = codes.compressed(whole, 2, 64)
    made = collections.Counter(r.vec_id for r in whole.join(coded, "row").collect())
    assert made == {None: 1, 1: 2, 9: 1}
    assert [len(b) for b in books] == [4, 4]
    for nothing in (frame.limit(0), frame.filter("vec_id = 2")):
        none = codes.whole_vectors(nothing, "vec_id", "embedding", "label")
        assert codes.compressed(none)[0].count() == 0
    empty_vectors = codes.whole_vectors(frame.filter("vec_id = 7"), "vec_id", "embedding", "label")
    coded = codes.compressed(empty_vectors, 2)[0].collect()
    assert [(r.code, r.error) for r in coded] == [([0, 0], 0)]


def test_query_of_an_empty_and_a_labelled_table(spark, tmp_path):
    rows = [(i, [i / 10.0] * 16, None if i % 2 else 1) for i in range(6)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        found = codes.op12_vector_code_compression(spark, str(tmp_path / name)).collect()
        assert sorted(r.vec_id for r in found) == [r[0] for r in data]
        assert all(len(r.code) == 32 and r.error == 0 and r.label_error == 0 for r in found)
