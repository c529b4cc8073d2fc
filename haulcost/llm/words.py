"""Words, lines and row identities shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: the white space between words, one character of it.
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text, none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def take(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that others cannot clash."""
    return frame.select(*[frame[source].alias(name) for name, source in columns.items()])


def square_root_buckets(rows: int) -> int:
    """Buckets that hold about as many rows each as there are buckets.

    Ranks within a bucket, and sums over the buckets, then both fit a task.
    """
    return max(1, int(rows**0.5))
