"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered by (doc_id, text checksum, size). A keyed Feistel network
permutes the numbers, cycle walking brings it to their exact range, and the
permuted number alone gives shard (remainder) and slot (quotient): any reader
can compute where a row is, and counts differ by at most one.

Defined cases: a NULL text has size 1 and checksum 0, like an empty one; NULL ids
are numbered first; rows that are repeated entirely are interchangeable and get a
number each; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage

#: Rounds of the network.
ROUNDS = 4
#: Most steps of a walk; few numbers need a second one, see :func:`permuted`.
WALK = 256


def feistel(pair: str, left: int, right: int, key: str) -> str:
    """SQL for a keyed bijection of pairs ``{l, r}`` with l < left and r < right.

    Each round adds a hash of one half to the other, modulo that half's size,
    which can be undone. ``aggregate`` carries the pair through the rounds.
    """
    hashed = "cast(conv(substring(md5(concat('{key}:', i, ':', {half})), 1, 15), 16, 10) as bigint)"
    by_right = hashed.format(key=key, half="p.r")
    by_left = hashed.format(key=key, half="p.l")
    return (
        f"aggregate(sequence(1, {ROUNDS}), {pair}, (p, i) -> if(i % 2 = 1,"
        f" named_struct('l', pmod(p.l + {by_right}, {left}L), 'r', p.r),"
        f" named_struct('l', p.l, 'r', pmod(p.r + {by_left}, {right}L))))"
    )


def permuted(number: str, rows: int, key: str) -> Column:
    """The number's place in a keyed permutation of ``[0, rows)``.

    The network permutes a rectangle of the two smallest near-square sides that
    hold all rows, so fewer than sqrt(rows) + 1 places lie outside the range. A
    number sent outside is sent on until it is inside. Such a walk meets another
    outside place each step: ``WALK`` steps are a proven bound up to 60,000 rows,
    beyond which a step stays outside with a chance below 1/250.
    """
    left = max(1, math.isqrt(max(0, rows - 1)) + 1)
    right = max(1, -(-rows // left))
    steps = min(WALK, left * right - rows + 1)
    value = f"(x.l * {right}L + x.r)"
    start = f"named_struct('l', {number} div {right}L, 'r', pmod({number}, {right}L))"
    step = feistel("x", left, right, key)
    first = feistel(start, left, right, key)
    inside = f"{value} < {rows}L"
    walked = f"aggregate(sequence(1, {steps}), x, (x, j) -> if({inside}, x, {step}))"
    # transform over one element names the first result, so that it is computed once
    return F.expr(
        f"element_at(transform(array({first}), x -> if({inside}, {value},"
        f" element_at(transform(array({walked}), x -> if({inside}, {value},"
        " cast(raise_error('a walk did not end') as bigint))), 1))), 1)"
    )


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with ``number``, their place in a total order from 0, and how many there are.

    Ranges of the order are sorted apart and stored; a range's rows are numbered
    from the sum of the counts before it. One row per range meets in a task.
    """
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut_lineage(
        ranges.select(
            "*",
            F.spark_partition_id().alias("_range"),
            # Spark numbers a partition's rows upwards in the low 33 bits.
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
    )
    counts = stored.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    total = offsets.agg(F.sum("_rows")).first()[0] or 0
    # A row per range, as many as the job has partitions.
    numbered_ = stored.join(F.broadcast(offsets), "_range").withColumn(
        "number", F.col("_before") + F.col("_place")
    )
    return numbered_.drop("_range", "_place", "_rows", "_before"), total


def shards(documents: DataFrame, shard_count: int = 16, key: str = "shuffle-1") -> DataFrame:
    """doc_id, size, text_crc32, number, shard and slot of every document.

    Only ids, sizes and checksums are shuffled, never texts.
    """
    docs = take(documents, doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows, total = numbered(slim, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("place", permuted("number", total, key)) if total else rows.withColumn(
        "place", F.col("number")
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "number",
        F.pmod("place", F.lit(shard_count)).cast("int").alias("shard"),
        F.expr(f"place div {shard_count}L").alias("slot"),
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15."""
    placed = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
