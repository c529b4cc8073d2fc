"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times the mix wants it. The rates stay
as close to one as they can (least relative entropy) while each source's tokens
meet its target and no rate exceeds ``most``. The solution is an exponential
tilt, ``rate = min(most, exp(lambda * size / scale))`` with one ``lambda`` per
source, which distributed Newton iterations on the convex dual find. Rates then
become whole copies.

Defined cases: a NULL text has size 0; sources are ordered by code point with
NULL, a source like any other, last; a source without tokens has target 0; rows
of size 0 take 0; repeated rows are documents of their own; an empty table gives
an empty mix. Other columns do not matter: only the named ones are read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.llm.words import square_root_buckets, take, words
from haulcost.sources.scratch import cut_lineage, release

#: Relative distance from its target at which a source is done.
TOLERANCE = 1e-6
#: Newton steps are kept inside a bracket that halves otherwise, so this is never met in practice.
MOST_ROUNDS = 200


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), source and size in words of every document."""
    docs = take(documents, doc_id="doc_id", source="source", text="text")
    return docs.select(
        "doc_id",
        F.xxhash64("text").alias("version"),
        "source",
        F.size(words(F.col("text"))).cast("long").alias("size"),
    )


def ranked_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights that repeat over the sources in code-point order, NULL last.

    ``sources`` has a row per source, so this order fits a task.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights)).cast("int") + 1
    )
    return sources.withColumn("weight", choice)


def targets(sources: DataFrame, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """Tokens wanted from each source (a row each, with ``source_size`` and ``weight``).

    The sources share ``share`` of all tokens by weight; a source stops at
    ``most`` times its size, and the excess goes to the others by weight until
    none is above. That is one level ``t`` with ``target = min(cap, weight * t)``:
    with sources in the order in which they reach their cap, the level follows
    from sums over those before and those after.
    """
    reach = F.col("cap") / F.col("weight")
    order = Window.orderBy(reach, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    return (
        sources.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", level)
        # The first source that stays below its cap has the level, and those after it, which may
        # reach theirs together, a lower one; none does if all are full.
        .withColumn("at", F.max(F.when(F.col("level") <= reach, F.col("level"))).over(everything))
        .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("at"), "cap")))
        .select("source", "source_size", "documents", "weight", "target")
    )


def _tilt(exponent: Column, most: float) -> Column:
    # The exponent is cut before exp, so that no rate overflows.
    return F.exp(F.least(exponent, F.lit(math.log(most))))


def solve(histogram: DataFrame, goals: DataFrame, most: float = 3.0) -> DataFrame:
    """``lambda`` per source, by Newton's method on the dual.

    ``histogram`` has source, size and documents: rates depend on nothing else,
    so a round reads counts instead of documents. Each round evaluates all
    sources' gradients and second derivatives in one aggregation and moves every
    ``lambda``; only the number of sources that are not there yet returns to the
    driver. ``full`` marks sources whose target is their cap: the tilt has no
    finite solution there and every rate is ``most``.
    """
    top = math.log(most)
    scaled = goals.withColumn("scale", F.greatest(F.col("source_size") / F.col("documents"), F.lit(1.0)))
    state = cut_lineage(
        scaled.select(
            "source",
            "source_size",
            "target",
            "scale",
            (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("lam"),
            # Sizes are at least 1: at these values the mix is surely below and above the target.
            F.least(
                F.col("scale") * F.log(F.col("target") / F.col("source_size")), F.lit(0.0)
            ).alias("low"),
            (F.col("scale") * top).alias("high"),
            F.lit(False).alias("done"),
        )
    )
    for _ in range(MOST_ROUNDS):
        open_ = state.filter("not done and not full and source_size > 0")
        rate = _tilt(F.col("lam") * F.col("x"), most)
        inside = F.col("lam") * F.col("x") < top
        sums = (
            histogram.alias("h")
            .join(open_.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .withColumn("x", F.col("size") / F.col("scale"))
            .groupBy(F.col("s.source").alias("of"))
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
                F.sum(F.when(inside, F.col("n") * F.col("size") * F.col("x") * rate)).alias("slope"),
            )
        )
        gap = F.col("taken") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        # Newton's step for the logarithm of the constraint, nearly straight for a tilt.
        step = F.col("lam") + F.log(F.col("target") / F.col("taken")) * F.col("taken") / F.col("slope")
        there = F.coalesce(F.abs(gap) <= TOLERANCE * F.col("target"), F.lit(False))
        moved = (
            state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
            .withColumn("new_low", low)
            .withColumn("new_high", high)
            .withColumn("step", step)
            .select(
                state["source"],
                "source_size",
                "target",
                "scale",
                "full",
                F.when(F.col("taken").isNull() | there, F.col("lam"))
                .when((F.col("step") > F.col("new_low")) & (F.col("step") < F.col("new_high")), F.col("step"))
                .otherwise((F.col("new_low") + F.col("new_high")) / 2)
                .alias("lam"),
                F.when(F.col("taken").isNull(), F.col("low")).otherwise(F.col("new_low")).alias("low"),
                F.when(F.col("taken").isNull(), F.col("high")).otherwise(F.col("new_high")).alias("high"),
                (F.col("done") | F.col("taken").isNull() | there).alias("done"),
            )
        )
        before, state = state, cut_lineage(moved)
        release(before)
        if state.filter("not done").isEmpty():
            return state
    raise RuntimeError(f"entropy balancing did not converge in {MOST_ROUNDS} rounds")


def rates(sizes: DataFrame, state: DataFrame, most: float = 3.0) -> DataFrame:
    """Rows with source and size, with their source's target and their rate.

    Rows of size 0 give nothing to any target; they keep rate 1.
    """
    tilt = state.select(
        F.col("source").alias("of"), "target", "source_size", "scale", "full", "lam"
    )
    rate = (
        F.when(F.col("size") == 0, F.lit(1.0))
        .when(F.col("full"), F.lit(float(most)))
        .otherwise(_tilt(F.col("lam") * F.col("size") / F.col("scale"), most))
    )
    return (
        sizes.join(tilt, sizes["source"].eqNullSafe(tilt["of"]), "left")
        .withColumn("rate", rate)
        .drop("of", "scale", "full", "lam")
    )


def cell_copies(cells: DataFrame) -> DataFrame:
    """How many documents of each (source, size) get one copy more than the whole part.

    Sizes go from the largest to the smallest, and each takes as many as the words
    still wanted ask for, so what a size leaves over goes to the next smaller one:
    a source ends within about its smallest size of its target. A group holds the
    distinct sizes of a source, a summary that its rows hardly lengthen.
    """

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False)
        owed, extra = 0.0, []
        for size, n, fraction in zip(group["size"], group["n"], group["fraction"], strict=True):
            owed += n * fraction * size
            take = min(n if fraction > 0 else 0, max(0, math.floor(owed / size + 0.5)))
            owed -= take * size
            extra.append(take)
        return group[["source", "size"]].assign(extra=extra)

    return cells.groupBy("source").applyInPandas(spread, "source string, size long, extra long")


def copies(rated: DataFrame, cells: DataFrame, rows: int) -> DataFrame:
    """Whole copies of every document.

    Which documents of a cell get its extra copies is dealt by hash: buckets of
    the cell share them in proportion to their rows, and a bucket's first few rows
    take them, so a cell with very many rows never meets in a task.
    """
    buckets = square_root_buckets(rows)
    dealt = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    parts = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("rows"))
    so_far = F.sum("rows").over(
        Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    )
    share = lambda upto: F.floor(upto * F.col("extra") / F.col("n"))
    named = cells.select(F.col("source").alias("of"), F.col("size").alias("sized"), "n", "extra")
    parts = (
        parts.withColumn("so_far", so_far)
        .join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("sized")))
        .select(
            "of",
            "sized",
            F.col("bucket").alias("part"),
            (share(F.col("so_far")) - share(F.col("so_far") - F.col("rows"))).alias("extra"),
        )
        .filter("extra > 0")
    )
    place = F.row_number().over(
        Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "version")
    )
    return (
        dealt.withColumn("place", place)
        .join(
            parts,
            F.col("source").eqNullSafe(F.col("of"))
            & (F.col("size") == F.col("sized"))
            & (F.col("bucket") == F.col("part")),
            "left",
        )
        .withColumn(
            "copies",
            (
                F.floor("rate") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
            ).cast("long"),
        )
        .drop("bucket", "place", "of", "sized", "part", "extra")
    )


def mix(
    documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0
) -> DataFrame:
    """doc_id, version, source, size, source_size, target, rate and copies of every document."""
    sizes = cut_lineage(sized(documents))
    histogram = cut_lineage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")
    )
    goals = cut_lineage(targets(ranked_weights(sources, weights), most))
    state = solve(histogram.filter("size > 0"), goals, most)
    fraction = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0)
    cells = rates(histogram, state, most).withColumn("fraction", fraction)
    cells = cut_lineage(
        cells.select("source", "size", "n")
        .alias("c")
        .join(
            cell_copies(cells.filter("size > 0").select("source", "size", "n", "fraction")).alias("e"),
            F.col("c.source").eqNullSafe(F.col("e.source")) & (F.col("c.size") == F.col("e.size")),
        )
        .select("c.*", "extra")
    )
    release(histogram, goals)
    return copies(rates(sizes, state, most), cells, sizes.count())


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it has copies.

    Documents and copies meet by id, source and text; rows repeated entirely add up.
    """
    copied = mix(documents, **how).groupBy(
        F.xxhash64("doc_id", "source", "version").alias("_key"), F.col("doc_id").alias("_of")
    ).agg(F.sum("copies").alias("_copies"))
    # Rows travel as one column, so that no name of theirs meets a name used here.
    version = F.xxhash64("_row.text")
    rows = (
        documents.select(F.struct("*").alias("_row"))
        .withColumn("_key", F.xxhash64("_row.doc_id", "_row.source", version))
        .withColumn("_id", F.col("_row.doc_id"))
        .dropDuplicates(["_key", "_id"])
    )
    return (
        rows.join(
            copied.filter("_copies > 0").withColumnRenamed("_key", "_same"),
            (F.col("_key") == F.col("_same")) & F.col("_id").eqNullSafe(F.col("_of")),
        )
        .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        .select("_row.*")
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed: what each gives, in words."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "rate",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
