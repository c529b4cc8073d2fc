"""Packing documents into sequences of a fixed number of tokens, by minimum bin slack.

A document is its ids and one end id. Longer ones than a sequence are cut so that
all pieces but the first are full. What remains to be packed is described by a
histogram of lengths, which has no more entries than a sequence has tokens. From
it the patterns follow: each takes the largest length left, and a subset-sum over
the available lengths, with bits for the reachable sums, finds what fills the
sequence best. The combination is used as often as its lengths last, and removed.

Pieces then find their place by their rank among those of their length. No piece
is moved to be packed: ranks and patterns are numbers.

Defined cases: a NULL or empty text is the end id alone; repeated rows are packed
each; ids and repeated ids do not matter for the packing; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulcost.llm.tokens import encoder, token_ids
from haulcost.llm.words import square_root_buckets, take
from haulcost.sources.scratch import cut_lineage, text_batches

#: Tokens of a sequence, and the id that ends every document.
CAPACITY = 2048
END = 0
_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(
    documents: DataFrame,
    capacity: int = CAPACITY,
    ranks_file: str | None = None,
    pattern: str | None = None,
    with_ids: bool = False,
    tokenizer_file: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_file, pattern, tokenizer_file)
        end = np.array([END], "<u4")
        for batch in batches:
            # A few documents at a time, as their ids are several times as large.
            for offset in range(0, batch.num_rows, 512):
                part = batch.slice(offset, 512)
                rows, found, ids = [], [], []
                for i, text in enumerate(part.column("text")):
                    all_ids = np.concatenate([token_ids(text.as_py() or "", coder), end])
                    first = len(all_ids) % capacity or capacity
                    starts = [0, *range(first, len(all_ids), capacity)]
                    for piece, start in enumerate(starts):
                        own = all_ids[start : starts[piece + 1] if piece + 1 < len(starts) else None]
                        rows.append(i)
                        found.append((piece, start, len(own), zlib.crc32(own.tobytes())))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                columns = list(zip(*found, strict=True)) or [()] * 4
                arrays = [
                    part.column("doc_id").take(pa.array(rows, pa.int32())),
                    pa.array(columns[0], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in columns[1:]],
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    docs = take(documents, doc_id="doc_id", text="text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return docs.mapInArrow(cut, f"doc_id {kind}, {_PIECE}{ids}")


def stored_pieces(documents: DataFrame, *what, **how) -> DataFrame:
    """The pieces, cut once and stored."""
    with text_batches(documents.sparkSession):
        return cut_lineage(pieces(documents, *what, **how))


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, largest first, whose sum comes closest to ``capacity`` without exceeding it.

    Bit s of ``reach`` says that some of the lengths so far add up to s. Lengths are
    added one copy at a time until the full sum is reachable, then traced back.
    """
    if capacity <= 0:
        return []
    limit = (1 << (capacity + 1)) - 1
    reach = 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            grown = (reach | reach << length) & limit
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> capacity & 1:
                break
        if reach >> capacity & 1:
            break
    left = reach.bit_length() - 1
    chosen = []
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return sorted(chosen, reverse=True)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many sequences use each; they use up the histogram."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    made = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        chosen = [largest, *fullest({k: n for k, n in counts.items() if n}, capacity - largest)]
        counts[largest] += 1
        uses = {length: chosen.count(length) for length in set(chosen)}
        times = min(counts[length] // use for length, use in uses.items())
        for length, use in uses.items():
            counts[length] -= times * use
            if not counts[length]:
                del counts[length]
        made.append((chosen, times))
    return made


def places(made: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, which ranks go to which pattern, and where in its sequences.

    A row per pattern and different length: ranks from ``first`` on, ``uses`` per
    sequence, in sequences from ``sequence`` on, at ``offset`` within them.
    """
    rows, next_rank, sequence = [], {}, 0
    for chosen, times in made:
        offset = 0
        for length in sorted(set(chosen), reverse=True):
            uses = chosen.count(length)
            first = next_rank.get(length, 0)
            rows.append((length, first, first + times * uses, uses, sequence, offset))
            next_rank[length] = first + times * uses
            offset += uses * length
        sequence += times
    names = ["of", "first", "beyond", "uses", "sequence", "at"]
    return pd.DataFrame(rows, columns=names, dtype="int64")


def ranked(cut: DataFrame, rows: int) -> DataFrame:
    """Pieces with ``rank``, their place among those of the same length, from 0.

    Pieces of a length are dealt to buckets by hash; a rank is the place in the
    bucket after the buckets before it. There are about as many buckets as rows in
    each, so a length that most pieces have does not meet in a task.
    """
    buckets = square_root_buckets(rows)
    dealt = cut.withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    )
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n")).drop("_n")
    place = F.row_number().over(
        Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    )
    return (
        dealt.withColumn("_place", place)
        .join(before, ["length", "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_place") - 1)
        .drop("_bucket", "_place", "_before")
    )


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences are numbered from 0.

    The histogram (at most ``capacity`` numbers) comes to the driver, where the
    patterns follow from it; their table is as bounded, and broadcast.
    """
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(patterns(histogram, capacity))
    schema = "of long, first long, beyond long, uses long, sequence long, at long"
    # As Arrow it becomes a local relation; rows of pandas would start Python workers for the transport.
    table = pa.Table.from_pandas(table, preserve_index=False)
    where = F.broadcast(spark.createDataFrame(table, schema))
    rows = sum(histogram.values())
    since = F.col("rank") - F.col("first")
    return (
        ranked(cut, rows)
        .join(where, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
        .withColumn("sequence_id", F.col("sequence") + F.floor(since / F.col("uses")))
        .withColumn("offset", F.col("at") + F.pmod(since, F.col("uses")) * F.col("length"))
        .drop("rank", "of", "first", "beyond", "uses", "sequence", "at")
    )


def sequences(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids in order."""
    cut = stored_pieces(documents, capacity, with_ids=True)
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        packed(cut, capacity)
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    cut = stored_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed(cut).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
