"""Joins that cope with missing keys and with keys that hold very many rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(
    left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal columns where NULL matches NULL, keeping one copy of the keys."""
    keyed = right.select(
        *[F.col(name).alias(f"_right_{name}") for name in names],
        *[name for name in right.columns if name not in names],
    )
    condition = reduce(
        lambda a, b: a & b,
        [F.col(name).eqNullSafe(F.col(f"_right_{name}")) for name in names],
    )
    return left.join(keyed, condition, how).drop(*[f"_right_{name}" for name in names])


def join_hot(lines: DataFrame, summary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to a summary of one row per key, where one key may hold most rows.

    Adaptive execution splits the partition of a hot key if both inputs come
    straight from a shuffle. A summary grouped by the key alone is already in
    place and would be joined without one, so the key's hash joins as well:
    rows grouped by the key are not partitioned by both.
    """
    hashed = F.xxhash64(key)
    return (
        lines.withColumn("_hash", hashed)
        .join(summary.withColumn("_hash", hashed), [key, "_hash"], how)
        .drop("_hash")
    )
