"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Candidates belong to the nearest of a bounded number of pivots, which are rows of
the table; the cell of a pivot is dealt to shards by a hash of the row, so that a
crowded cell is many shards. A shard adds one coordinate to its vectors so that all
have the same length; the largest inner product is then the smallest distance, and
the triangle inequality holds. Its tree splits vectors by their median distance from
a vantage point. Queries come in blocks that walk the tree together, each leaving out
subtrees that cannot hold a nearer vector: those whose bound, times ``factor``,
exceeds its worst distance so far. A factor of one is exact; larger ones look at
fewer leaves and may miss some.

A query first searches one shard of its best cell. Its last neighbour there tells
which cells can still hold a nearer one: an inner product with a vector of a cell is
at most that with the pivot, plus the query's length times the cell's radius. Only
those are searched, and with that score as the start. Candidates are copied only as
often as a shard has blocks of queries. How many cells a query needs depends on the
vectors: few where they lie in groups, all of them where they do not.

Defined cases: vectors that are NULL, empty or zero or hold NULL or a non-finite
component take no part, nor do rows without id; vectors are compared with those of
the same length only; rows that share an id are rows of their own, as candidates and
as queries, and only a query's own row is left out; ties go to the smaller id; a
query has as many neighbours as there are candidates, up to ``k``; without any, it
has no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage

#: Vectors of a shard, and queries of a block, on average.
SHARD_ROWS = 4096
BLOCK_ROWS = 2048
#: Pivots at most; they are all that the driver and every task hold of the table.
PIVOTS = 1024
#: Vectors in a leaf, which are compared without further pruning.
LEAF = 64
#: How much tighter than the triangle inequality subtrees are pruned.
FACTOR = 1.0
_KEYS = ["dim", "cell", "shard"]
_RESULT = "query_row long, query_id long, vec_id long, score double"


@dataclass
class Node:
    rows: np.ndarray
    vantage: int = -1
    radius: float = 0.0
    low: float = 0.0
    high: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


def build(points: np.ndarray, rows: np.ndarray, seed: int = 0) -> Node:
    """A vantage-point tree; vectors that a distance cannot split share a leaf."""
    if len(rows) <= LEAF:
        return Node(rows)
    vantage = int(rows[np.random.default_rng(seed).integers(len(rows))])
    away = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(1))
    radius = float(np.median(away))
    near = away <= radius
    if near.all():
        near = away < radius
        if not near.any():
            return Node(rows)
        radius = float(away[near].max())
    return Node(
        rows,
        vantage,
        radius,
        float(away[~near].min()),
        float(away.max()),
        build(points, rows[near], 2 * seed + 1),
        build(points, rows[~near], 2 * seed + 2),
    )


class Search:
    """The ``k`` nearest of a block of queries within one shard."""

    def __init__(self, ids, rows, vectors, query_rows, queries, least, k: int, factor: float):
        self.ids, self.own, self.vectors = ids, rows, vectors
        self.query_rows, self.queries, self.least = query_rows, queries, least
        norms = (vectors**2).sum(1)
        top = norms.max()
        self.points = np.hstack([vectors, np.sqrt(np.maximum(top - norms, 0))[:, None]])
        self.places = np.hstack([queries, np.zeros((len(queries), 1))])
        # squared distance = |q|^2 + top - 2 <q, x>
        self.shift = (queries**2).sum(1) + top
        # a little room, so that rounding prunes nothing that is not farther
        self.room = 1e-9 * (1 + np.sqrt(self.shift))
        self.k, self.factor = k, factor
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)

    def worst(self, active: np.ndarray) -> np.ndarray:
        last = np.maximum(self.scores[active, -1], self.least[active])
        return np.sqrt(np.maximum(self.shift[active] - 2 * last, 0)) + self.room[active]

    def leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        """Merge a leaf's vectors into the best of the active queries.

        A fast product, which may be off in the last digits, picks the queries that
        have something to gain; their scores are then computed in a fixed order.
        """
        step = max(1, (1 << 20) // max(1, len(rows)))
        vectors = self.vectors[rows]
        for start in range(0, len(active), step):
            part = active[start : start + step]
            rough = (self.queries[part] @ vectors.T).max(1)
            last = np.maximum(self.scores[part, -1], self.least[part])
            part = part[rough >= last - self.room[part] ** 2 - 1e-9 * np.abs(rough)]
            score = sequential(self.queries[part], vectors)
            score[self.own[rows][None, :] == self.query_rows[part][:, None]] = -np.inf
            scores = np.hstack([self.scores[part], score])
            found = np.hstack([self.found[part], np.broadcast_to(rows, score.shape)])
            ids = np.where(found >= 0, self.ids[found], np.iinfo(np.int64).max)
            order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.scores[part] = np.take_along_axis(scores, order, 1)
            self.found[part] = np.where(
                np.isneginf(self.scores[part]), -1, np.take_along_axis(found, order, 1)
            )

    def walk(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.inner is None:
            self.leaf(node.rows, active)
            return
        away = np.sqrt(((self.places[active] - self.points[node.vantage]) ** 2).sum(1))
        inside = away <= (node.radius + node.low) / 2
        for nearer_first in (True, False):
            for child, mine in ((node.inner, inside), (node.outer, ~inside)):
                going = mine if nearer_first else ~mine
                who, at = active[going], away[going]
                bound = (
                    at - node.radius
                    if child is node.inner
                    else np.maximum(node.low - at, at - node.high)
                )
                self.walk(child, who[bound * self.factor <= self.worst(who)])


def sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components.

    The order makes a score the same whatever block or shard it is computed in.
    """
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += a[:, i : i + 1] * b[:, i]
    return total


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, double vector and row number of the rows that take part, stored so that numbers stay."""
    rows = take(vectors, id=id_column, vector=vector_column).select(
        F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")
    )
    good = (
        F.col("id").isNotNull()
        & F.forall(
            "vector",
            lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)),
        )
        & F.exists("vector", lambda x: F.coalesce(x != 0, F.lit(False)))
    )
    return cut_lineage(rows.filter(good).withColumn("row", F.monotonically_increasing_id()))


@dataclass
class Pivots:
    """Pivots by length of vector, and the radius of each one's cell once it is known."""

    by_dim: dict[int, np.ndarray]
    radii: dict[int, np.ndarray]

    @staticmethod
    def of(candidates: DataFrame, number: int) -> Pivots:
        """The first so many vectors by a hash, of all candidates."""
        order = F.xxhash64("vector", "row")
        drawn = candidates.select("vector").orderBy(order, "row").limit(number).distinct().collect()
        by_dim: dict[int, list] = {}
        for vector in sorted(r.vector for r in drawn):
            by_dim.setdefault(len(vector), []).append(vector)
        return Pivots({d: np.array(v) for d, v in by_dim.items()}, {})

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and distance from its pivot."""
        pivots = self.by_dim[vectors.shape[1]]
        rough = (pivots**2).sum(1) - 2 * (vectors @ pivots.T)
        cell = rough.argmin(1)
        return cell, np.sqrt(((vectors - pivots[cell]) ** 2).sum(1))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """No inner product with a vector of a cell is larger."""
        pivots, radii = self.by_dim[vectors.shape[1]], self.radii[vectors.shape[1]]
        length = np.sqrt((vectors**2).sum(1))[:, None]
        reach = np.sqrt((pivots**2).sum(1)) + np.where(radii < 0, 0, radii)
        room = 1e-9 * (1 + length * reach)
        return np.where(radii < 0, -np.inf, vectors @ pivots.T + length * radii + room)


def _by_dim(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of the vectors of a batch, some at a time."""
    dims = frame["vector"].map(len).to_numpy()
    for dim in np.unique(dims):
        places = np.flatnonzero(dims == dim)
        for start in range(0, len(places), 1024):
            at = places[start : start + 1024]
            yield int(dim), at, np.stack(frame["vector"].to_numpy()[at])


def _in_cells(frame: DataFrame, pivots: Pivots) -> DataFrame:
    """Rows with the length and cell of their vector and its distance from the pivot.

    Lengths without a pivot make one cell, -1, which has no bound.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims, cell = np.zeros(len(batch), int), np.full(len(batch), -1)
            away = np.zeros(len(batch))
            for dim, at, vectors in _by_dim(batch):
                dims[at] = dim
                if dim in pivots.by_dim:
                    cell[at], away[at] = pivots.nearest(vectors)
            yield batch.assign(dim=dims, cell=cell, away=away)

    columns = "id long, vector array<double>, row long, dim int, cell int, away double"
    return frame.select("id", "vector", "row").mapInPandas(place, columns)


def _routed(queries: DataFrame, pivots: Pivots, first: bool) -> DataFrame:
    """Queries with the cells to search: the best one, or all that can hold better than ``least``."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = batch["least"].to_numpy()
            for dim, at, vectors in _by_dim(batch):
                if dim in pivots.by_dim:
                    bound = pivots.bounds(vectors)
                    best = bound.argmax(1)
                    open_ = (bound > -np.inf) & (bound >= least[at][:, None])
                    query, cell = (np.arange(len(at)), best) if first else np.nonzero(open_)
                else:
                    query, cell = np.arange(len(at)), np.full(len(at), -1)
                    best = cell
                yield batch.iloc[at[query]].assign(dim=dim, cell=cell, home=best[query])

    columns = "id long, vector array<double>, row long, least double, dim int, cell int, home int"
    return queries.select("id", "vector", "row", "least").mapInPandas(route, columns)


def _searched(candidates: DataFrame, routed: DataFrame, k: int, factor: float) -> DataFrame:
    """The ``k`` best of each query within each shard that it is sent to.

    A task holds a shard and a block of its queries. It grows the shard's tree, some
    thirteen distances a vector, against the thousands that a block may look at.
    """

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        left, right = left.sort_values(["id", "row"]), right.sort_values("row")
        ids, vectors = left["id"].to_numpy(), np.stack(left["vector"].to_numpy())
        query_ids, query_rows = right["id"].to_numpy(), right["row"].to_numpy()
        run = Search(
            ids,
            left["row"].to_numpy(),
            vectors,
            query_rows,
            np.stack(right["vector"].to_numpy()),
            right["least"].to_numpy(),
            k,
            factor,
        )
        run.walk(build(run.points, np.arange(len(ids))), np.arange(len(query_ids)))
        at, rank = np.nonzero(run.found >= 0)
        return pd.DataFrame(
            {
                "query_row": query_rows[at],
                "query_id": query_ids[at],
                "vec_id": ids[run.found[at, rank]],
                "score": run.scores[at, rank],
            }
        )

    load = routed.groupBy(*_KEYS).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("row", F.lit(1)), "blocks").cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = candidates.join(load, _KEYS).select(*_KEYS, every, "id", "vector", "row")
    right = routed.join(load, _KEYS).select(*_KEYS, block, "id", "vector", "row", "least")
    keys = [*_KEYS, "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _RESULT)


def nearest(
    candidates: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest candidates.

    Both frames have an id, a vector and a row number, as of :func:`usable`; a
    query's own row is not its neighbour.
    """
    number = min(PIVOTS, -(-candidates.count() // SHARD_ROWS))
    pivots = Pivots.of(candidates, number)
    placed = cut_lineage(_in_cells(candidates, pivots))
    cells = placed.groupBy("dim", "cell").agg(
        F.max("away").alias("radius"),
        F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"),
    )
    # A row for each pivot at most.
    for dim, matrix in pivots.by_dim.items():
        pivots.radii[dim] = np.full(len(matrix), -1.0)
    for r in cells.filter("cell >= 0").collect():
        pivots.radii[r.dim][r.cell] = r.radius
    own_shard = F.pmod(F.xxhash64("row"), "shards").cast("int")
    shards = cells.select("dim", "cell", "shards")
    dealt = placed.join(shards, ["dim", "cell"]).withColumn("shard", own_shard)

    start = queries.withColumn("least", F.lit(float("-inf")))
    home = _routed(start, pivots, True).join(shards, ["dim", "cell"]).withColumn("shard", own_shard)
    first = cut_lineage(_searched(dealt, home, k, factor))
    full = first.groupBy(F.col("query_row").alias("row")).agg(
        F.min("score").alias("last"), F.count(F.lit(1)).alias("n")
    )
    least = F.when(F.col("n") >= k, F.col("last")).otherwise(float("-inf"))
    known = queries.join(full, "row", "left").select("id", "vector", "row", least.alias("least"))
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    others = (
        _routed(known, pivots, False)
        .join(shards, ["dim", "cell"])
        .select("*", every)
        .filter((F.col("cell") != F.col("home")) | (F.col("shard") != own_shard))
    )
    found = first.unionByName(_searched(dealt, others, k, factor))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(vectors, vectors.filter("id % 20 = 0"))


OP9_SQL = """
with v as materialized (
  select row_number() over () as row, vec_id, embedding::double[] as vector from embeddings
  where vec_id is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0
),
scored as (
  select q.row, q.vec_id as query_id, c.vec_id, list_inner_product(q.vector, c.vector) as score
  from v q join v c on c.row <> q.row and len(c.vector) = len(q.vector)
  where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by row order by score desc, vec_id) as rank from scored
) where rank <= 20
"""
