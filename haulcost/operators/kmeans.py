"""Clusters by transfers of single points, for many numbers of clusters in one scan.

A round looks at every point with the counts and sums of all clusters as the round
began. A point leaves its cluster a for b if that lowers the sum of squares, by
``d(b)^2 n(b) / (n(b) + 1) < d(a)^2 n(a) / (n(a) - 1)``, where d is the distance from
the cluster's mean; all such points move together. A number of clusters whose sum of
squares did not fall by a round takes that round back and is done. The first
clusters are those of the nearest of the starting points, which are the first distinct
points by a keyed hash.

All numbers of clusters advance together: a round is a scan that writes each point's
clusters, and an aggregation of what was written. The driver holds a count and the
sums of each cluster, a hundred or so rows.

Points are whole numbers, so that sums do not depend on the order of rows, and a task
that runs again gives the same clusters.

Defined cases: a measure that is NULL counts as 0; of fewer distinct points than
clusters each is a cluster of its own; without points there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcost.sources.scratch import cut_lineage, release

#: Whole steps of a measure for each unit.
UNIT = 1_000_000
#: Rounds unless asked otherwise, as published.
ROUNDS = 10
_STATE = "state array<struct<open boolean, back boolean, clusters array<struct<n double, mean array<double>>>>>"


@dataclass
class Clusters:
    """Counts and sums by cluster, for one number of clusters, and what the last round did."""

    n: list[int]
    sums: list[list[int]]
    within: float = float("inf")
    open: bool = True
    back: bool = False

    def means(self) -> list[tuple[float, list[float]]]:
        return [(float(n), [float(s) / n for s in sums] if n else []) for n, sums in zip(self.n, self.sums, strict=True)]


def point(measures: list[str]) -> Column:
    """The measures as whole numbers of steps."""
    steps = [F.round(F.coalesce(F.col(c), F.lit(0.0)) * UNIT).cast("long") for c in measures]
    return F.array(*steps)


def starting_points(points: DataFrame, number: int, seed: int) -> list[list[int]]:
    """The first distinct points by a hash."""
    text = F.concat_ws("|", F.lit(seed).cast("string"), F.transform("point", lambda x: x.cast("string")))
    drawn = points.select("point").distinct().orderBy(F.md5(text.cast("binary")), "point").limit(number)
    return [list(row.point) for row in drawn.collect()]


def _moved(own: Column, at: Column, first: bool) -> Column:
    """The cluster of a point after a round."""

    def score(cluster: Column, number: Column) -> Column:
        square = F.aggregate(
            F.zip_with("point", cluster["mean"], lambda x, m: (x - m) * (x - m)),
            F.lit(0.0),
            lambda total, x: total + x,
        )
        n, mine = cluster["n"], number == own
        cost = square
        if not first:
            leaving = F.when(n > 1, F.try_divide(square * n, n - 1)).otherwise(0.0)
            cost = F.when(mine, leaving).otherwise(square * n / (n + 1))
        cost = F.when(n > 0, cost).otherwise(float("inf"))
        return F.struct(cost.alias("cost"), (~mine).alias("other"), number.alias("number"))

    return F.array_min(F.transform(at["clusters"], score))["number"]


def _settled() -> Column:
    """Clusters after the last round was taken back where it did no good."""
    return F.transform(
        "now", lambda own, i: F.when(F.col("state")[i]["back"], F.col("before")[i]).otherwise(own)
    )


def _with_state(members: DataFrame, states: list[Clusters]) -> DataFrame:
    rows = [([(s.open, s.back, s.means()) for s in states],)]
    return members.crossJoin(F.broadcast(members.sparkSession.createDataFrame(rows, _STATE)))


def _count(members: DataFrame, states: list[Clusters], squares: float, width: int) -> None:
    """Take the counts of the clusters as they now are, or close those that got no better."""
    found = (
        members.select(F.posexplode("now").alias("i", "cluster"), "point")
        .groupBy("i", "cluster")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("point")[d]).alias(f"s{d}") for d in range(width)])
        .collect()
    )
    counted = {(r.i, r.cluster): (r.n, [r[f"s{d}"] for d in range(width)]) for r in found}
    for i, state in enumerate(states):
        state.back = False
        if not state.open:
            continue
        size = len(state.n)
        new = [counted.get((i, c), (0, [0] * width)) for c in range(size)]
        explained = 0.0
        for n, sums in new:
            if n:
                total = 0.0
                for s in sums:
                    total += float(s) * float(s)
                explained += total / n
        within = squares - explained
        if within < state.within:
            state.n, state.sums, state.within = [n for n, _ in new], [s for _, s in new], within
        else:
            state.open, state.back = False, True


def fit(
    rows: DataFrame, measures: list[str], numbers: list[int], seed: int, rounds: int = ROUNDS
) -> tuple[DataFrame | None, list[float]]:
    """The rows with ``now``, a cluster for each of ``numbers``, and each one's sum of squares.

    The frame is stored, see :func:`haulcost.sources.scratch.cut_lineage`.
    """
    points = rows.withColumn("point", point(measures))
    starts = starting_points(points, max(numbers), seed)
    if not starts:
        return None, []
    width = len(measures)
    exact = [F.col("point")[d].cast("decimal(19,0)") for d in range(width)]
    squares = points.agg(F.sum(sum((x * x for x in exact[1:]), exact[0] * exact[0]))).first()[0]
    states = [Clusters([1] * min(k, len(starts)), starts[:k]) for k in numbers]
    none = F.array_repeat(F.lit(-1), len(numbers))
    first = F.transform(none, lambda own, i: _moved(own, F.col("state")[i], True))
    stored = cut_lineage(
        _with_state(points, states).withColumns({"before": none, "now": first}).drop("state")
    )
    _count(stored, states, float(squares), width)
    for _ in range(rounds):
        settled = _with_state(stored, states).withColumn("before", _settled())
        now = F.transform(
            "before",
            lambda own, i: F.when(
                F.col("state")[i]["open"], _moved(own, F.col("state")[i], False)
            ).otherwise(own),
        )
        following = cut_lineage(settled.withColumn("now", now).drop("state"))
        release(stored)
        stored = following
        _count(stored, states, float(squares), width)
        if not any(s.open for s in states):
            break
    settled = _with_state(stored, states).withColumn("now", _settled()).drop("state", "before")
    return settled, [s.within / UNIT**2 for s in states]
