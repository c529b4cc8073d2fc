"""Compression of vectors into codes, with codebooks by Lloyd's rounds over resident members.

A vector of whole numbers is cut into equal parts, and each position has a codebook.
The rows of the members table are parts. They are partitioned by (position, entry,
salt): the owner of an entry holds its members, and a hot entry, one vector repeated
by a third of all rows, say, is spread over its salts. A round updates the entries
from the sums of their residents, compares every resident with the new entries where
it lies, and moves only those that change their entry: they alone go through the
round's shuffle, to their new owners; the others are written where they are read.

What reaches the driver and goes back to the tasks is the codebooks: positions x
entries x components of a part, whose number is fixed by parameters and the dimension.
All arithmetic is on whole numbers, so neither partitioning nor order changes a result.

Defined cases: vectors that are NULL, or hold a NULL or non-finite component, take no
part; neither do components of 65,536 or more in size, whose squared distances would
leave 64 bits, nor vectors of another length than that of the smallest kept id, or of
one that cannot be cut into the positions; empty vectors have codes of zeros and no
error. NULL ids come after all others and are kept; repeated rows are rows of their
own, and the smaller vector comes first where ids tie. Fewer rows than entries make
fewer entries. An empty table gives no rows. Only the three named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage, release

POSITIONS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components below this size only; see the defined cases.
LARGEST = 65_536.0
#: Members that one owner should hold.
RESIDENTS = 100_000

Codebooks = list[list[list[int]]]


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """row, vec_id, label and the components ``floor(256 * x)`` of the rows that take part."""
    rows = take(vectors, vec_id=id_column, label=label_column, vector=vector_column)
    fit = F.forall(
        "vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False))
    )
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = rows.filter(F.col("vector").isNotNull() & fit).select("vec_id", "label", whole.alias("whole"))
    # The number is stored with the row, so that it stays when a task runs again.
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


def first_entries(rows: DataFrame, positions: int, entries: int) -> tuple[Codebooks, int]:
    """Codebooks from the parts of the smallest ids, and the length of a vector."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole")
    head = first.limit(1).collect()
    length = len(head[0]["whole"]) if head else 0
    if length % positions:
        length = 0
    fitting = first.filter(F.size("whole") == length).limit(entries).collect()
    width = length // positions
    return [
        [list(row["whole"][p * width : (p + 1) * width]) for row in fitting] for p in range(positions)
    ], length


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part, ties to the lower index, and its squared distance."""
    best = np.zeros(len(parts), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for i, entry in enumerate(entries):
        away = ((parts - entry) ** 2).sum(1)
        nearer = away < least
        best[nearer], least[nearer] = i, away[nearer]
    return best, least


def _assigned(members: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Members with the entry that is nearest now, and its squared distance."""
    arrays = [np.array(book, np.int64) for book in codebooks]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = batch.column("position").to_numpy()
            flat = batch.column("part").flatten().to_numpy().astype(np.int64)
            parts = flat.reshape(len(positions), -1) if len(flat) else np.zeros((len(positions), 0), np.int64)
            best = np.zeros(len(positions), np.int64)
            least = np.zeros(len(positions), np.int64)
            for p in np.unique(positions):
                at = np.flatnonzero(positions == p)
                best[at], least[at] = nearest_entries(parts[at], arrays[p])
            columns = [batch.column(x) for x in ("row", "position", "part", "entry")]
            columns += [pa.array(best, pa.int32()), pa.array(least, pa.int64())]
            names = ["row", "position", "part", "entry", "nearest", "error"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return members.mapInArrow(
        assign,
        "row long, position int, part array<int>, entry int, nearest int, error long",
    )


def _settled(assigned: DataFrame, owners: int, salts: int) -> DataFrame:
    """Members at the owners of their entries; only those whose entry changed are moved."""
    kept = [F.col(x) for x in ("row", "position", "part")]
    same = F.col("nearest").eqNullSafe(F.col("entry"))
    stay = assigned.filter(same).select(*kept, "entry")
    salt = F.pmod(F.xxhash64("row"), F.lit(salts))
    move = assigned.filter(~same).select(*kept, F.col("nearest").alias("entry"))
    return stay.unionByName(move.repartition(owners, "position", "entry", salt))


def _updated(members: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Entries replaced by the floor of the mean of their members; unused ones stay."""
    width = len(codebooks[0][0])
    total = [F.sum(F.get("part", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]
    sums = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *total).collect()
    made = [list(book) for book in codebooks]
    for row in sums:
        made[row["position"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return made


def _written(codebooks: Codebooks) -> str:
    return hashlib.sha256(
        ",".join(str(x) for book in codebooks for entry in book for x in entry).encode()
    ).hexdigest()


def compressed(
    rows: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """(row, code as an array of entries, error) of the rows of :func:`whole_vectors`, and the codebooks."""
    codebooks, length = first_entries(rows, positions, entries)
    width = length // positions
    fitting = rows.filter(F.size("whole") == length) if codebooks[0] else rows.limit(0)
    if width == 0:  # nothing to tell vectors apart by
        zeros = F.array_repeat(F.lit(0), positions).alias("code")
        return fitting.select("row", zeros, F.lit(0).cast("long").alias("error")), codebooks
    parts = fitting.select(
        "row",
        F.posexplode(
            F.array(*[F.slice("whole", p * width + 1, width) for p in range(positions)])
        ).alias("position", "part"),
        F.lit(None).cast("int").alias("entry"),
    )
    vectors = fitting.count()
    salts = -(-vectors // RESIDENTS)
    owners = max(rows.sparkSession.sparkContext.defaultParallelism, -(-vectors * positions // RESIDENTS))
    members = None
    for _ in range(rounds):
        assigned = cut_lineage(_assigned(parts if members is None else members, codebooks))
        settled = cut_lineage(_settled(assigned, owners, salts))
        release(*[x for x in (assigned, members) if x is not None])
        members = settled
        codebooks = _updated(members, codebooks)
    last = _assigned(parts if members is None else members, codebooks)
    coded = last.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("position", "nearest"))).alias("places"),
        F.sum("error").alias("error"),
    )
    return coded.select("row", F.col("places.nearest").alias("code"), "error"), codebooks


def hex_code(code: Column, positions: int) -> Column:
    """Two hex digits for every entry of a code."""
    digits = [F.lower(F.lpad(F.hex(F.get(code, F.lit(p))), 2, "0")) for p in range(positions)]
    return reduce(lambda a, b: F.concat(a, b), digits)


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with errors by vector and by label and the codebooks' digest."""
    rows = whole_vectors(
        spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label"
    )
    coded, codebooks = compressed(rows)
    found = cut_lineage(
        rows.join(coded, "row").select(
            "vec_id", "label", hex_code(F.col("code"), POSITIONS).alias("code"), "error"
        )
    )
    # Labels are summed up before they meet the rows; a hot label can be split, as its
    # hash joins as well.
    hashed = F.xxhash64("label")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = by_label.select(F.col("label").alias("_label"), "label_error", hashed.alias("_hash"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_hash") == F.col("_also"))
    return (
        found.withColumn("_also", hashed)
        .join(by_label, same)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            "code",
            "error",
            "label_error",
            F.lit(_written(codebooks)).alias("codebooks_sha256"),
        )
    )


#: Parts, entries and rounds as in the operator; every round is written out.
_ASSIGN = """
{name} as (
  select row, label, vec_id, pos, part, idx, dist from (
    select p.*, b.idx, list_sum(list_transform(list_zip(p.part, b.entry),
        lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as dist,
      row_number() over (partition by p.row, p.pos order by dist, b.idx) as rn
    from parts p join {books} b on b.pos = p.pos
  ) where rn = 1
)"""
_UPDATE = """
{name} as (
  select b.pos, b.idx, coalesce(m.entry, b.entry) as entry from {books} b left join (
    select pos, idx, list(mean order by k) as entry from (
      select pos, idx, k, (s - ((s % n) + n) % n) // n as mean from (
        select pos, idx, k, sum(part[k])::bigint as s, count(*)::bigint as n
        from {assigned}, range(1, 1 + len(part)) as r(k) group by pos, idx, k
      )
    ) group by pos, idx
  ) m on m.pos = b.pos and m.idx = b.idx
)"""

OP12_SQL = (
    """
with kept as (
  select row_number() over (order by vec_id nulls last, whole) as row, vec_id, label, whole from (
    select vec_id, label, [floor(256 * x::double)::bigint for x in embedding] as whole
    from embeddings where embedding is not null
      and len([x for x in embedding if x is null or not isfinite(x) or abs(x) >= 65536]) = 0
  )
),
parts as (
  select row, vec_id, label, p::int as pos, whole[p * len(whole) // 16 + 1 : (p + 1) * len(whole) // 16] as part
  from kept, range(0, 16) as r(p)
),
books0 as (select pos, row - 1 as idx, part as entry from parts where row <= 64),"""
    + ",".join(
        [
            _ASSIGN.format(name="assigned0", books="books0"),
            _UPDATE.format(name="books1", books="books0", assigned="assigned0"),
            _ASSIGN.format(name="assigned1", books="books1"),
            _UPDATE.format(name="books2", books="books1", assigned="assigned1"),
            _ASSIGN.format(name="assigned2", books="books2"),
        ]
    )
    + """,
coded as (
  select row, vec_id, label, string_agg(printf('%02x', idx), '' order by pos) as code, sum(dist)::bigint as error
  from assigned2 group by row, vec_id, label
)
select vec_id, code, error,
  sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(array_to_string(entry, ','), ',' order by pos, idx)) from books2) as codebooks_sha256
from coded
"""
)
