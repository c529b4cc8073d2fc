"""N-gram Jaccard self-join of documents: a size-aware heavy-light join.

Documents are sets of five-word shingles. Two link when their Jaccard similarity
is at least 0.8. Equal sets are one class from the start.

* Light: two small sets that link share one of their subsets of a fixed size, the
  overlap which their two sizes demand. Small sets emit all such subsets as keys.
* Heavy: for a pair with a larger set, each set emits the few shingles that come
  first in a common order; sets that link share one, so inverted lists of these
  suffice. Shingles that many documents have come last in that order, so that
  common passages do not make long lists.
* The boundary between small and large minimises the estimated work: subsets to
  emit against lists to scan, over the sizes that the corpus has.

A pair only counts at a key if, were this the first shingle that both sets share,
enough could still follow: what stands before it in both is in one of them only.
And every set has a sketch, bits that each of its shingles flips. Where the sketches
of two sets differ, a shingle is in one of them only, so the bits that differ are a
lower bound of such shingles. Pairs that cannot link by either bound are never rows.

A list is not expanded into all its pairs. Its members are first compared with a
few of them; verified links form components. Only members of one list that are
then still in different components are compared with each other, until nothing is
left, so no link between different sets is lost.

Defined cases: NULL or empty texts, and texts without words, have an empty set and
link with nothing; a text with fewer than five words is one shingle; NULL ids are
never a component's id unless it has no other; repeated rows are copies like any
other; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcost.llm.components import components
from haulcost.llm.shingles import overlap, set_hash, shingles
from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage, release, text_batches

#: A shingle that more documents have comes last in the order; any value gives the same links.
COMMON = 12
#: Bits that remember which shingles are common; too few make lists longer, never results wrong.
COMMON_BITS = 1 << 24
#: Share of a document's shingles, in hash order, that is searched for common ones. Sets
#: that link share one of their first ninth, so this is enough for documents of which at most
#: half is common. Documents with a larger share of common ones are searched whole.
SEARCHED = 0.25
MOSTLY = 0.5
#: Members of a list that all others are compared with (later times the square root of its
#: length), and rounds of that at most.
PIVOTS = 3
PIVOT_ROUNDS = 8
#: Lists with more members than this are compared with pivots again before pair by pair,
LONG_LIST = 64
#: unless the open pairs of all lists are at most this many times the comparisons with pivots,
ROUND_COST = 2
#: or the last round left more than this share of the open pairs.
LITTLE_GAIN = 0.75
#: So few open pairs in all are compared sooner than another round has started.
FEW_PAIRS = 20_000_000
#: Bits of the sketch of a set of so many shingles; larger sets have twice as many until they fit.
SKETCH_BITS = 512
#: Sizes that the boundary is chosen among.
MOST_SMALL = 24


def needed(a: int, b: int) -> int:
    """Least overlap of two linked sets of these sizes: 100 * overlap >= 80 * union."""
    return -(-4 * (a + b) // 9)


def partners(size: int) -> range:
    """Sizes that a set of this size can link with."""
    return range(-(-4 * size // 5), 5 * size // 4 + 1)


def prefix_length(size: int) -> int:
    return size - (-(-4 * size // 5)) + 1


def subset_count(size: int, boundary: int) -> int:
    return sum(comb(size, needed(size, t)) for t in partners(size) if t <= boundary)


def boundary_by_cost(sizes: dict[int, int], list_length: float) -> int:
    """The size up to which emitting subsets costs less than scanning lists."""

    def cost(boundary: int) -> float:
        return sum(
            n * (subset_count(s, boundary) if s <= boundary else prefix_length(s) * list_length)
            for s, n in sizes.items()
            if s <= MOST_SMALL
        )

    return min(range(MOST_SMALL + 1), key=lambda b: (cost(b), b))


def subset_keys(hashes: np.ndarray, boundary: int) -> list[int]:
    """Keys of a small set's subsets, for every size of small partner."""
    keys = []
    n = len(hashes)
    for t in partners(n):
        if t > boundary:
            continue
        tag = np.uint64((min(n, t) << 32) | (max(n, t) << 16) | 1)
        for chosen in combinations(hashes, needed(n, t)):
            keys.append(set_hash(np.array([tag, *chosen], np.uint64)))
    return keys


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits that the hashes of a set flip, as whole numbers of 64 bits.

    The two halves of a sketch, combined by xor, are the sketch of half as many bits.
    """
    bits = SKETCH_BITS
    while bits < len(hashes):
        bits *= 2
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, x in enumerate(batch.column("text").cast(pa.binary())):
        yield i, shingles(x.as_py())


def _documents(documents: DataFrame) -> DataFrame:
    return take(documents, doc_id="doc_id", text="text").withColumn("version", F.xxhash64("text"))


def _is_common(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(COMMON_BITS - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def shingle_statistics(documents: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """Counts over all documents: (kind, key, n, squares).

    Kind 0 is a common shingle, folded, 1 a set size, 2 all other shingles together.

    With a bitmap of common shingles, the rest of the shingles of the documents that
    mostly consist of those; they repeat each other, so counts of a batch are few.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found, sizes = [np.empty(0, np.uint32)], []
            for _, h in _texts(batch):
                searched = int(len(h) * SEARCHED) + 1
                if known is None:
                    sizes.append(min(len(h), MOST_SMALL + 1))
                    found.append(h[:searched].astype(np.uint32))
                elif len(h) and _is_common(h[:searched], known).mean() > MOSTLY:
                    found.append(h[searched:].astype(np.uint32))
            for kind, values in ((0, np.concatenate(found)), (1, np.array(sizes, np.uint32))):
                key, n = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(key), kind, np.int32)),
                        pa.array(key.view(np.int32)),
                        pa.array(n.astype(np.int64)),
                    ],
                    names=["kind", "key", "n"],
                )

    counted = _documents(documents).select("text").mapInArrow(count, "kind int, key int, n long")
    counted = counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    rare = F.expr(f"kind = 0 and n <= {COMMON}")
    return counted.groupBy(
        F.when(rare, 2).otherwise(F.col("kind")).alias("kind"), F.when(~rare, F.col("key")).alias("key")
    ).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))


def common_shingles(statistics: DataFrame) -> np.ndarray:
    """A bitmap of the common shingles: ``COMMON_BITS`` bits, whatever the corpus."""
    bit = F.pmod(F.col("key"), F.lit(COMMON_BITS)).cast("long")
    rows = (
        statistics.filter("kind = 0")
        .select(F.floor(bit / 32768).cast("long").alias("part"), F.pmod(bit, F.lit(32768)).alias("bit"))
        .groupBy("part")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
        .collect()
    )
    bitmap = np.zeros(COMMON_BITS // 8, np.uint8)
    for row in rows:
        bitmap[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def keyed_sets(documents: DataFrame, bitmap: np.ndarray, boundary: int) -> DataFrame:
    """doc_id, version, class, size, sketch, first shingles and subsets of every document with words."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)

    def first(h: np.ndarray) -> np.ndarray:
        n = len(h)
        if 5 * n // 4 <= boundary:
            return h[:0]  # no large set can be its partner
        common = _is_common(h, shared.value)
        return np.concatenate([h[~common], h[common]])[: prefix_length(n)]

    def lists(rows: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
        values = np.concatenate(rows) if rows else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64), pa.int64()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, classes, sizes, sketches, prefixes, subsets = [], [], [], [], [], []
            for i, h in _texts(batch):
                if len(h):
                    rows.append(i)
                    classes.append(set_hash(h))
                    sizes.append(len(h))
                    sketches.append(sketch(h))
                    prefixes.append(first(h))
                    small = subset_keys(h, boundary) if len(h) <= boundary else []
                    subsets.append(np.array(small, np.int64))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("version").take(at),
                    pa.array(classes, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    lists(sketches),
                    lists(prefixes),
                    lists(subsets),
                ],
                names=["doc_id", "version", "class", "size", "sketch", "prefix", "subsets"],
            )

    docs = _documents(documents)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        emit,
        f"doc_id {kind}, version long, class long, size int, sketch array<long>, prefix array<long>,"
        " subsets array<long>",
    )


def linked(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets truly link.

    The two texts meet and the shingles are counted; only texts of classes in some
    pair travel.
    """
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    places = classes.join(wanted, "class").select("class", "doc_id", "version")
    texts = cut_lineage(
        _documents(documents)
        .join(places.withColumnRenamed("doc_id", "of"), "version")
        .filter(F.col("doc_id").eqNullSafe(F.col("of")))
        .select("class", "text")
        .dropDuplicates(["class"])
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            texts = {c: batch.column(c).cast(pa.binary()) for c in ("a_text", "b_text")}
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                sets = []
                for key, column in ((x, "a_text"), (y, "b_text")):
                    if key not in last:
                        if len(last) > 64:
                            last.clear()
                        last[key] = shingles(texts[column][i].as_py())
                    sets.append(last[key])
                if 9 * overlap(*sets) >= 4 * (len(sets[0]) + len(sets[1])):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int32()))

    both = pairs.join(
        texts.select(F.col("class").alias("a"), F.col("text").alias("a_text")).hint("merge"), "a"
    ).join(texts.select(F.col("class").alias("b"), F.col("text").alias("b_text")).hint("merge"), "b")
    with text_batches(documents.sparkSession):
        found = cut_lineage(both.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a long, b long"))
    release(texts)
    return found


def shared_keys(sets: DataFrame) -> DataFrame:
    """(key, class, size, rank) of the members of keys that more than one class has.

    ``rank`` is the key's place in the set's order. A subset counts as a first one.
    The smaller set of a link has a key that it shares in its first ninth, so a key
    without such a member is of no use.
    """
    # Each key is once in ``several``, so its part of a shuffle is small enough to hash;
    # the members, of which a key may have many, are streamed and not sorted.
    members = sets.select(
        "class", "size", F.posexplode("prefix").alias("rank", "key")
    ).unionByName(sets.select("class", "size", F.lit(0).alias("rank"), F.explode("subsets").alias("key")))
    several = (
        members.groupBy("key")
        .agg(
            F.min("class").alias("_low"),
            F.max("class").alias("_high"),
            F.max(F.expr("9 * rank <= size")).alias("_early"),
        )
        .filter("_low < _high and _early")
    )
    also = F.hash("key").alias("_also")
    return (
        members.select("*", also)
        .join(several.select("key", also).hint("shuffle_hash"), ["key", "_also"], "left_semi")
        .select("key", "class", "size", "rank")
        .distinct()
    )


def _differing_bits() -> str:
    """SQL: in how many bits the sketches differ, the longer one folded."""
    words = SKETCH_BITS // 64
    short = " + ".join(f"bit_count(l.sketch[{i}] ^ r.sketch[{i}])" for i in range(words))

    def folded(a: str, b: str) -> str:
        halves = f"zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (x, y) -> x ^ y)"
        half = f"if(size({a}) = size({b}), {a}, {halves})"
        return f"aggregate(zip_with({half}, {b}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"

    return (
        f"case when size(l.sketch) = {words} and size(r.sketch) = {words} then {short}"
        f" when size(l.sketch) >= size(r.sketch) then {folded('l.sketch', 'r.sketch')}"
        f" else {folded('r.sketch', 'l.sketch')} end"
    )


def _possible() -> str:
    """SQL: sizes fit, and neither the key's places nor the sketches rule a link out.

    Sizes that fit are less than twice as large as each other, and so are sketches.
    """
    need = "(4 * (l.size + r.size) + 8) div 9"
    apart = f"l.size + r.size - 2 * ({need})"
    return (
        "5 * least(l.size, r.size) >= 4 * greatest(l.size, r.size)"
        f" and l.rank <= l.size - {need} and r.rank <= r.size - {need}"
        f" and l.rank + r.rank <= {apart} and l.root <> r.root"
        f" and {_differing_bits()} <= {apart}"
    )


def _pivots(lists: DataFrame, round_: int) -> DataFrame:
    """A few members of each list.

    At first the lowest after flipping the same bits everywhere. Later those with the
    lowest hashes, about ``PIVOTS`` times the square root of the list's length, so that
    a member is soon linked if it has links. Either way lists of the same members
    agree, and few pairs arise.
    """
    if round_ > 0:
        draw = F.pmod(F.xxhash64("class", F.lit(round_)), F.lit(1 << 31)) / (1 << 31)
        return lists.filter(draw * F.sqrt("_n") < PIVOTS)
    lowest = []
    for k in range(PIVOTS):
        flip = F.xxhash64(F.lit(k).cast("long"))
        lowest.append(F.min(F.col("class").bitwiseXOR(flip)).bitwiseXOR(flip))
    chosen = lists.groupBy("key").agg(F.array_distinct(F.array(*lowest)).alias("_chosen"))
    return lists.join(chosen.select("key", F.explode("_chosen").alias("class")), ["key", "class"])


def links(documents: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of every class that links with another; ``sets`` is released once it is read.

    Rounds compare the members of lists that are still in different components:
    with a few of their list first, and again while that costs less than each with
    each and brings members together. The last round leaves no possible pair untried:
    in each list, members outside its largest component are compared with all.
    """
    spark = documents.sparkSession
    keys = shared_keys(sets).withColumn("root", F.col("class"))
    lists = cut_lineage(keys.join(classes.select("class", "sketch"), "class"))
    release(sets)
    base, members = lists, lists.drop("root")
    tried = found = roots = before = None
    round_ = 0
    while True:
        also = F.hash("key").alias("_also")
        if round_ == 0:  # all lists are open
            left = lists.select("*", also)
            last = False
            if left.isEmpty():
                break
        else:
            parts = lists.groupBy("key", "root").agg(F.count("*").alias("m"))
            open_ = (
                parts.groupBy("key")
                .agg(F.sum("m").alias("_n"), F.max(F.struct("m", "root")).alias("_most"))
                .filter("_most.m < _n")
                .select("key", "_n", F.col("_most.m").alias("_m"), F.col("_most.root").alias("_major"))
            )
            open_ = cut_lineage(open_)
            n = F.col("_n").cast("double")
            cost = open_.agg(
                F.sum(n * (n - F.col("_m"))).alias("pairs"),
                F.sum(n * PIVOTS * F.sqrt(n)).alias("pivoted"),
                F.max("_n").alias("longest"),
            ).first()
            if cost.pairs is None:
                break
            last = (
                round_ >= PIVOT_ROUNDS
                or cost.longest <= LONG_LIST
                or cost.pairs <= FEW_PAIRS
                or cost.pairs <= ROUND_COST * cost.pivoted
                or (before is not None and cost.pairs > LITTLE_GAIN * before)
            )
            before = cost.pairs
            if last:
                release(base)
            left = cut_lineage(
                lists.select("*", also).join(
                    open_.select("key", "_n", "_major", also).hint("merge"), ["key", "_also"]
                )
            )
            release(open_, lists)
        # Of two members with different roots one at least is not of the list's main root.
        right = left.filter("root <> _major") if last else _pivots(left, round_)
        pairs = (
            left.alias("l")
            .join(right.alias("r").hint("merge"), ["key", "_also"])
            .filter(_possible())
            .select(
                F.least("l.class", "r.class").alias("a"), F.greatest("l.class", "r.class").alias("b")
            )
            .distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        good = linked(pairs, classes, documents)
        found = good if found is None else found.unionByName(good)
        tried = pairs if tried is None else tried.unionByName(pairs)
        roots = cut_lineage(components(found))
        release(left)
        if last:
            break
        lists = cut_lineage(
            members.join(
                roots.select(F.col("node").alias("class"), "root").hint("merge"), "class", "left"
            ).withColumn("root", F.coalesce("root", "class"))
        )
        round_ += 1
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return roots


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, version, n_shingles, root and component_id of every document.

    ``version`` is the hash of the text, so that rows which share an id stay apart;
    ``root`` names the component whatever the ids, and is NULL for empty sets.
    """
    spark = documents.sparkSession
    with text_batches(spark):
        statistics = cut_lineage(shingle_statistics(documents))
    bitmap = common_shingles(statistics)
    total = statistics.filter("kind = 2").agg(F.sum("squares").alias("pairs"), F.sum("n").alias("rows")).first()
    sizes = {r.key: r.n for r in statistics.filter("kind = 1 and key > 0").collect()}
    release(statistics)
    boundary = boundary_by_cost(sizes, 1 + (total.pairs or 0) / max(total.rows or 0, 1))
    with text_batches(spark):
        bitmap |= common_shingles(shingle_statistics(documents, bitmap))
        sets = cut_lineage(keyed_sets(documents, bitmap, boundary))
    place = F.min(F.struct("doc_id", "version"))
    classes = cut_lineage(
        sets.groupBy("class")
        .agg(F.min("size").alias("size"), F.first("sketch").alias("sketch"), place.alias("place"))
        .select("class", "size", "sketch", "place.*")
    )
    places = cut_lineage(sets.select("doc_id", "version", "class", "size"))
    roots = links(documents, sets, classes)
    ids = (
        places.groupBy("class")
        .agg(F.min("doc_id").alias("lowest"))
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    lowest = ids.groupBy("root").agg(F.min("lowest").alias("component_id"))
    ids = cut_lineage(
        ids.withColumn("_also", F.hash("root"))
        .join(lowest.withColumn("_also", F.hash("root")).hint("merge"), ["root", "_also"])
        .select("class", "root", "component_id")
    )
    slim = places.withColumn("_also", F.hash("class"))
    with_words = slim.join(ids.withColumn("_also", F.hash("class")).hint("merge"), ["class", "_also"])
    empty = _documents(documents).filter(
        ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    )
    return with_words.select(
        "doc_id", "version", F.col("size").cast("long").alias("n_shingles"), "root", "component_id"
    ).unionByName(
        empty.select(
            "doc_id",
            "version",
            F.lit(0).cast("long").alias("n_shingles"),
            F.lit(None).cast("long").alias("root"),
            F.col("doc_id").alias("component_id"),
        )
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents with one of each component: that with the smallest id.

    Documents without words have no component and stay.
    """
    found = jaccard_components(documents)
    first = (
        found.filter("root is not null")
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "version")).alias("first"))
        .select(F.col("first.doc_id").alias("_of"), F.col("first.version").alias("_same"))
    )
    # Rows travel as one column, so that no name of theirs meets a name used here.
    rows = documents.select(F.struct("*").alias("_row"))
    wordless = ~F.coalesce(F.col("_row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = (
        rows.filter(~wordless)
        .withColumn("_version", F.xxhash64("_row.text"))
        .withColumn("_id", F.col("_row.doc_id"))
        .join(
            first,
            (F.col("_version") == F.col("_same")) & F.col("_id").eqNullSafe(F.col("_of")),
            "left_semi",
        )
        .dropDuplicates(["_id", "_version"])
    )
    return chosen.select("_row.*").unionByName(rows.filter(wordless).select("_row.*"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their set and their component."""
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")
