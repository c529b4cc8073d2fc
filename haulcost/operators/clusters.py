"""Fitted models: clusters of lanes, and the significance of the haul classes."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions.stats import two_sided_t
from haulcost.operators import energy, kmeans
from haulcost.operators.energy import FUEL_PAIR, LANE_KEYS, SCALED, TYPE
from haulcost.sources.scratch import cut_lineage


def fuel_features(scaled: DataFrame) -> DataFrame:
    """Lanes of the two fuel types, stored because every fit reads them.

    A measure that does not vary has no z-score; fits count it as 0, the mean, and no
    row is dropped for it.
    """
    return cut_lineage(scaled.where(F.col(TYPE).isin(FUEL_PAIR)))


def kmeans_elbow(
    features: DataFrame, max_k: int = 15, seed: int = 123, rounds: int = kmeans.ROUNDS
) -> DataFrame:
    """Sum of squares within clusters for 1 to ``max_k`` clusters, all in the same scans."""
    numbers = list(range(1, max_k + 1))
    _, within = kmeans.fit(features.select(*SCALED), SCALED, numbers, seed, rounds)
    found = [(k, float(ss)) for k, ss in zip(numbers, within, strict=False)]
    return features.sparkSession.createDataFrame(found, "k int, within_ss double").orderBy("k")


def lane_clusters(
    features: DataFrame, k: int = 4, seed: int = 123, rounds: int = kmeans.ROUNDS
) -> DataFrame:
    """The lanes and their features with the cluster of each."""
    fitted, _ = kmeans.fit(features, SCALED, [k], seed, rounds)
    if fitted is None:
        return features.withColumn("cluster", F.lit(0))
    return fitted.select(*features.columns, F.col("now")[0].alias("cluster"))


def principal_axes(
    features: DataFrame, measures: list[str] = SCALED, number: int = 2
) -> tuple[list[float], list[list[float]]]:
    """Means of the measures, and the loadings of the first principal components.

    One aggregation of whole numbers gives the covariances, a square of as many rows as
    there are measures, so they are the same on any partitioning. The largest loading
    of a component is positive. Fewer than two rows have loadings of 0.
    """
    width = range(len(measures))
    steps = [F.col("point")[d].cast("decimal(19,0)") for d in width]
    pairs = list(combinations_with_replacement(width, 2))
    found = (
        features.select(kmeans.point(measures).alias("point"))
        .agg(
            F.count("point").alias("n"),
            F.array(*[F.sum(x).cast("decimal(38,0)") for x in steps]).alias("sums"),
            F.array(*[F.sum(steps[i] * steps[j]) for i, j in pairs]).alias("products"),
        )
        .first()
    )
    n = found.n
    if n < 2:
        return [0.0 for _ in width], [[0.0 for _ in width] for _ in range(number)]
    sums, covariance = [int(s) for s in found.sums], np.zeros((len(measures),) * 2)
    for (i, j), product in zip(pairs, found.products, strict=True):
        covariance[i, j] = covariance[j, i] = (n * int(product) - sums[i] * sums[j]) / (n * (n - 1))
    _, vectors = np.linalg.eigh(covariance)
    axes = [vectors[:, -1 - place] for place in range(number)]
    axes = [axis * np.sign(axis[np.argmax(np.abs(axis))]) for axis in axes]
    return [s / n for s in sums], [[float(x) for x in axis] for axis in axes]


def kmeans_clusters(
    features: DataFrame, k: int = 4, seed: int = 123, rounds: int = kmeans.ROUNDS
) -> DataFrame:
    """Cluster of each lane, and its place on the first two principal components."""
    means, axes = principal_axes(features)
    placed = lane_clusters(features, k, seed, rounds).withColumn("point", kmeans.point(SCALED))

    def place(axis: list[float]) -> Column:
        parts = [(F.col("point")[d] - means[d]) * axis[d] for d in range(len(SCALED))]
        return sum(parts, F.lit(0.0)) / kmeans.UNIT

    return placed.select(
        *LANE_KEYS, "cluster", place(axes[0]).alias("pc1"), place(axes[1]).alias("pc2")
    )


def modal_cluster(clustered: DataFrame) -> DataFrame:
    """Most frequent cluster per charge type; ties give one row each."""
    by_size = Window.partitionBy(TYPE).orderBy(F.desc("lanes"))
    return (
        clustered.groupBy(TYPE, "cluster")
        .agg(F.count(F.lit(1)).alias("lanes"))
        .withColumn("place", F.rank().over(by_size))
        .where(F.col("place") == 1)
        .select(TYPE, "cluster")
    )


def loh_regression_p_values(lines: DataFrame, charge_type: str) -> DataFrame:
    """Two-sided p-value of each coefficient of ``energy.loh_regression``."""
    fitted = energy.loh_regression(lines, charge_type)
    p_value = two_sided_t(F.col("t_value"), F.col("residual_df"))
    return fitted.select("term", p_value.alias("p_value")).orderBy("term")
