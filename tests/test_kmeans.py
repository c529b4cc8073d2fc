"""Clustering by transfers against a plain version of the same rounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from haulcost.operators import kmeans
from haulcost.sources import scratch

MEASURES = ["a", "b", "c"]


def plain(points, k, seed, rounds):
    """Clusters and sum of squares, point by point."""

    def key(p):
        return hashlib.md5("|".join(map(str, [seed, *p])).encode()).hexdigest(), p

    starts = sorted({tuple(p) for p in points}, key=key)[:k]

    def square(p, m):
        total = 0.0
        for x, y in zip(p, m, strict=True):
            total += (x - y) * (x - y)
        return total

    def within(own):
        out = 0.0
        for c in set(own):
            part = np.array([p for p, o in zip(points, own, strict=True) if o == c], float)
            out += ((part - part.mean(0)) ** 2).sum()
        return out

    own = [min((square(p, s), c) for c, s in enumerate(starts))[1] for p in points]
    best = within(own)
    for _ in range(rounds):
        groups = [[p for p, o in zip(points, own, strict=True) if o == c] for c in range(len(starts))]
        means = [[sum(x) / len(g) for x in zip(*g, strict=True)] if g else None for g in groups]
        moved = []
        for p, o in zip(points, own, strict=True):
            costs = []
            for c, g in enumerate(groups):
                n = len(g)
                if c == o:
                    costs.append((square(p, means[c]) * n / (n - 1) if n > 1 else 0.0, False, c))
                elif n:
                    costs.append((square(p, means[c]) * n / (n + 1), True, c))
            moved.append(min(costs)[2])
        if within(moved) >= best:
            break
        own, best = moved, within(moved)
    return own, best


def frame_of(spark, values, parts=3):
    rows = [(i, *[float(x) for x in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(parts)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 3))
    drawn = centres[rng.integers(5, size=90)] + 0.6 * rng.normal(size=(90, 3))
    return np.vstack([drawn, drawn[:20]])  # repeated rows


def test_equals_plain_rounds_for_all_numbers_at_once(spark, values):
    points = [[round(x * kmeans.UNIT) for x in v] for v in values]
    numbers = [1, 2, 3, 4, 7]
    for parts in (1, 5):
        fitted, within = kmeans.fit(frame_of(spark, values, parts), MEASURES, numbers, 123, 4)
        found = {r.id: list(r.now) for r in fitted.collect()}
        for i, k in enumerate(numbers):
            own, best = plain(points, k, 123, 4)
            assert [found[j][i] for j in range(len(values))] == own
            assert within[i] == pytest.approx(best / kmeans.UNIT**2)


def test_all_at_once_costs_as_alone_and_nothing_is_left_behind(spark, values):
    frame = frame_of(spark, values)
    before = list(scratch._folders)
    together, all_within = kmeans.fit(frame, MEASURES, [2, 5], 1)
    alone, within = kmeans.fit(frame, MEASURES, [5], 1)
    assert all_within[1] == within[0] and all_within[0] > all_within[1]
    assert sorted((r.id, r.now[1]) for r in together.collect()) == sorted((r.id, r.now[0]) for r in alone.collect())
    assert len(set(scratch._folders) - set(before)) == 2, "only the results are stored"


def test_a_round_that_does_no_good_is_taken_back(spark):
    # Both middle points prefer the other cluster, and changing places helps neither.
    values = np.array([[0, 0, 0], [4, 0, 0], [5, 0, 0], [9, 0, 0], [4.5, 1, 0]], float)
    points = [[round(x * kmeans.UNIT) for x in v] for v in values]
    for seed in range(12):
        fitted, within = kmeans.fit(frame_of(spark, values, 2), MEASURES, [2, 3], seed, 6)
        found = {r.id: list(r.now) for r in fitted.collect()}
        for i, k in enumerate((2, 3)):
            own, best = plain(points, k, seed, 6)
            assert [found[j][i] for j in range(5)] == own
            assert within[i] == pytest.approx(best / kmeans.UNIT**2)
        if seed > 3:
            break


def test_few_points_nulls_and_nothing(spark):
    frame = spark.createDataFrame([(1, 1.0, None, 0.0), (2, 1.0, 0.0, 0.0), (3, None, None, None)], "id int, a double, b double, c double")
    fitted, within = kmeans.fit(frame, MEASURES, [1, 2, 6], 3)
    found = {r.id: list(r.now) for r in fitted.collect()}
    assert found[1] == found[2] and found[1][2] != found[3][2] and found[1][0] == found[3][0]
    assert within[0] == pytest.approx(2 / 3) and within[1] == within[2] == 0
    assert kmeans.fit(frame.limit(0), MEASURES, [1, 2], 3) == (None, [])
