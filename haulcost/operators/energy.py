"""Energy and fuel charges by lane: base rates, lane statistics, regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.joins import join_hot
from haulcost.functions.stats import (
    count_distinct_with_missing,
    exact_medians,
    mean,
    money_variance,
    ratio,
    trim_to_quantiles,
)
from haulcost.sources.scratch import cut_lineage

TYPE = "accessorial_charge_description"
AMOUNT = "accessorial_charge_amount"
BASE_TYPE = "BASE CHARGE"
# The two charge types under comparison, and the types charted by month.
FUEL_PAIR = ["FUEL CHARGE", "FUEL SURCHARGE"]
CHARTED_TYPES = [
    "ENERGY CHARGE",
    "ENERGY SURCHARGE",
    "ENERGY SURCHARGE (FUEL ADJUSTMENT FACTOR)",
    "FUEL",
    "FUEL CHARGE",
    "FUEL SURCHARGE",
    "FUEL OTHER",
]
LANE_KEYS = [TYPE, "mode", "origin_zip3", "dest_zip3", "LOH"]
TRIMMED = ["min", "max", "avg", "med", "pct_of_base", "pct_of_total"]
SCALED = ["min", "max", "avg", "med", "var", "range", "pct_of_base", "pct_of_total"]
# Result column and lane statistic of each median, in published order.
ROLLED_UP = {
    "med_min": "min",
    "med_max": "max",
    "med_avg": "avg",
    "med_med": "med",
    "med_pct_of_base": "pct_of_base",
    "med_pct_of_total": "pct_of_total",
    "med_range": "range",
    "med_var": "var",
}


def energy_ledger(
    ledger: DataFrame, ship_from: str = "2021-01-01", ship_to: str | None = None
) -> DataFrame:
    """Fuel, energy and base lines of a period with their type, mode, class and zip3s."""
    raw = F.col("accessorial_charge_description")
    last = F.current_date() if ship_to is None else F.lit(ship_to).cast("date")
    return (
        ledger.where(F.col("ship_date") >= F.lit(ship_from).cast("date"))
        .where(F.col("ship_date") <= last)
        .where(classify.like_any(F.upper(raw), ["%FUEL%", "%ENERGY%", "%BASE%"]))
        .select(
            "cass_shipment_id",
            "ship_date",
            "shipper_master_code",
            buckets.zip3(F.col("origin_postal_code")).alias("origin_zip3"),
            buckets.zip3(F.col("destination_postal_code")).alias("dest_zip3"),
            F.upper("system_type").alias("system_type"),
            buckets.mode_class(F.col("transportation_mode_description")).alias("mode"),
            buckets.haul_class(F.col("distance")).alias("LOH"),
            classify.energy_type(raw).alias(TYPE),
            "accessorial_charge_amount",
            "amount_paid",
        )
    )


def base_rate(lines: DataFrame) -> DataFrame:
    """Lines with their load's total, non-base sum and base rate.

    A load with base lines only has no such sums: they default to the line's
    own total and to zero. The lines are not filtered by type but summed
    conditionally, so the type is derived once and not again for a filter.
    """
    paid, is_other = F.col("amount_paid"), F.col(TYPE) != BASE_TYPE
    other_lines = F.count_if(is_other)
    other_paid = F.when(is_other, paid)
    loads = (
        lines.groupBy("cass_shipment_id")
        .agg(
            other_lines.alias("other_lines"),
            F.coalesce(F.sum(F.when(is_other, F.col(AMOUNT))), F.lit(0))
            .cast("decimal(28,2)")
            .alias("other_sum"),
            F.when(F.count(other_paid) == other_lines, F.max(other_paid)).alias("load_total"),
        )
        .where(F.col("other_lines") > 0)
    )
    return join_hot(lines, loads, "cass_shipment_id", "left").select(
        *lines.columns,
        F.coalesce("other_sum", F.lit(0)).cast("decimal(28,2)").alias("non_base_total"),
        F.coalesce("load_total", paid).alias("total"),
        F.coalesce(F.col("load_total") - F.col("other_sum"), paid)
        .cast("decimal(28,2)")
        .alias("base_rate"),
    )


def plausible_loads(rated: DataFrame) -> DataFrame:
    """Lines with a believable base rate and total, with the lane as text."""
    base, total = F.col("base_rate"), F.col("total")
    return rated.where(
        (base > 0) & (base <= 5000) & (total > 0) & (total <= 10000)
    ).withColumn("lane", buckets.lane_text())


def volume_lanes(loads: DataFrame, min_shippers: int = 3) -> DataFrame:
    """Lanes by mode, haul class and week with enough different shippers.

    The week is its number only, so the same week of several years is one.
    """
    return (
        loads.groupBy(
            "mode", "origin_zip3", "dest_zip3", "LOH", F.weekofyear("ship_date").alias("week")
        )
        .agg(
            F.count(F.lit(1)).alias("Load_Count"),
            count_distinct_with_missing(F.col("shipper_master_code")).alias("Carrier_Count"),
        )
        .where(F.col("Carrier_Count") >= min_shippers)
        .withColumn("lane", buckets.lane_text())
    )


def use_data(loads: DataFrame, min_shippers: int = 3) -> DataFrame:
    """Rows on a lane that has enough shippers in any mode, class or week."""
    lanes = volume_lanes(loads, min_shippers).select("lane").distinct()
    return join_hot(loads, lanes, "lane", "left_semi")


def studied_lines(
    ledger: DataFrame,
    ship_from: str = "2021-01-01",
    ship_to: str | None = None,
    min_shippers: int = 3,
) -> DataFrame:
    """Energy lines with base rates, plausible and on volume lanes.

    The plausible lines decide which lanes count and are then filtered by them;
    they are stored in between so their base rates are joined only once.
    """
    lines = energy_ledger(ledger, ship_from, ship_to)
    return use_data(cut_lineage(plausible_loads(base_rate(lines))), min_shippers)


def monthly_charges(lines: DataFrame, ship_to: str = "2022-09-15") -> DataFrame:
    """Count, median and sum of charges per month and charted type.

    One missing amount makes the median and the sum of its group missing.
    """
    chosen = lines.where(F.col("ship_date") <= F.lit(ship_to).cast("date")).where(
        F.col(TYPE).isin(CHARTED_TYPES)
    )
    keyed = chosen.select(
        F.trunc("ship_date", "year").alias("year"),
        F.trunc("ship_date", "month").alias("month"),
        TYPE,
        F.col(AMOUNT).alias("amount"),
    )
    medians = exact_medians(
        keyed,
        ["year", "month", TYPE],
        {"amount": "median"},
        [
            F.count(F.lit(1)).alias("count"),
            (F.count("amount") == F.count(F.lit(1))).alias("complete"),
            F.sum("amount").cast("decimal(28,2)").alias("sum"),
        ],
    )
    return medians.select(
        "year",
        "month",
        TYPE,
        "count",
        F.when(F.col("complete"), F.col("median")).alias("med_price"),
        F.when(F.col("complete"), F.col("sum")).alias("sum_price"),
    ).orderBy("year", "month", TYPE)


def raw_lane_stats(lines: DataFrame) -> DataFrame:
    """Charge statistics per type, mode, zip3 lane and haul class.

    Lanes with an unknown end, a missing amount or a single price are left out.
    """
    measured = lines.where(F.col(TYPE) != BASE_TYPE).select(
        *LANE_KEYS,
        F.col(AMOUNT).alias("amount"),
        ratio(F.col(AMOUNT), F.col("base_rate")).alias("of_base"),
        ratio(F.col(AMOUNT), F.col("amount_paid")).alias("of_total"),
    )
    rows = F.count(F.lit(1))
    stats = exact_medians(
        measured.where(F.col("origin_zip3").isNotNull() & F.col("dest_zip3").isNotNull()),
        LANE_KEYS,
        {"amount": "med", "of_base": "pct_of_base", "of_total": "pct_of_total"},
        [
            F.min("amount").cast("double").alias("min"),
            F.max("amount").cast("double").alias("max"),
            ratio(F.sum("amount"), rows).alias("avg"),
            money_variance(F.col("amount")).alias("var"),
            (F.max("amount") - F.min("amount")).cast("double").alias("range"),
            rows.alias("count"),
            *[
                (F.count(c) == rows).alias(f"complete_{c}")
                for c in ("amount", "of_base", "of_total")
            ],
        ],
    )
    return stats.where(F.col("complete_amount") & (F.col("max") > F.col("min"))).select(
        *LANE_KEYS,
        "min",
        "max",
        "avg",
        "med",
        "var",
        "range",
        F.when(F.col("complete_of_base"), F.col("pct_of_base")).alias("pct_of_base"),
        F.when(F.col("complete_of_total"), F.col("pct_of_total")).alias("pct_of_total"),
        "count",
    )


def lane_charge_stats(lines: DataFrame) -> DataFrame:
    """Lane statistics without the first and last tenth of any of six measures."""
    return trim_to_quantiles(raw_lane_stats(lines), TRIMMED).dropna("any")


def charge_stats_rollup(stats: DataFrame) -> DataFrame:
    """Median lane statistics of the two fuel types: overall, by LOH, by mode, by both.

    ``level`` names the grouping; columns it does not use are NULL.
    """
    nothing = F.lit(None).cast("string")

    def at(level: str, mode: Column, haul: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), mode.alias("mode"), haul.alias("LOH"))

    mode, haul = F.col("mode"), F.col("LOH")
    levels = F.array(
        at("overall", nothing, nothing),
        at("LOH", nothing, haul),
        at("mode", mode, nothing),
        at("mode_LOH", mode, haul),
    )
    spread = (
        stats.where(F.col(TYPE).isin(FUEL_PAIR))
        .withColumn("at", F.explode(levels))
        .select("at.*", TYPE, *ROLLED_UP.values())
    )
    keys = ["level", "mode", "LOH", TYPE]
    medians = exact_medians(
        spread,
        keys,
        {source: name for name, source in ROLLED_UP.items()},
        [F.count(F.lit(1)).alias("lane_count")],
    )
    return medians.select(
        *keys, "lane_count", *[F.bround(name, 2).alias(name) for name in ROLLED_UP]
    ).orderBy(*keys)


def charge_stats_long(rollup: DataFrame) -> DataFrame:
    """The four price medians of the overall level, one row each."""
    return (
        rollup.where(F.col("level") == "overall")
        .select(TYPE, "med_min", "med_max", "med_avg", "med_med")
        .unpivot(TYPE, ["med_min", "med_max", "med_avg", "med_med"], "stat", "value")
    )


def scaled_stats(stats: DataFrame) -> DataFrame:
    """Lane statistics as z-scores, over the lanes of all charge types."""
    moments = stats.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in SCALED],
        *[F.stddev_samp(c).alias(f"_sd_{c}") for c in SCALED],
    )
    return stats.crossJoin(F.broadcast(moments)).select(
        *LANE_KEYS,
        *[ratio(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")).alias(c) for c in SCALED],
    )


def loh_regression(lines: DataFrame, charge_type: str) -> DataFrame:
    """Least squares of the amount on the haul class, for one charge type.

    With a single factor the fit follows from count, mean and squares per
    class, so one aggregation is enough. The alphabetically first class is the
    reference. One row per coefficient, the fit's own figures repeated.
    """
    squares = money_variance(F.col(AMOUNT)) * (F.count(F.lit(1)) - 1)
    classes = (
        lines.where((F.col(TYPE) == charge_type) & F.col(AMOUNT).isNotNull())
        .groupBy("LOH")
        .agg(
            F.count(F.lit(1)).alias("n"),
            mean(F.col(AMOUNT)).alias("mean"),
            F.coalesce(squares, F.lit(0.0)).alias("squares"),
        )
    )
    # At most one row per haul class from here on.
    everything = Window.partitionBy()
    grand_mean = F.sum(F.col("n") * F.col("mean")).over(everything) / F.sum("n").over(everything)
    first = F.min_by(F.struct("LOH", "n", "mean"), F.col("LOH")).over(everything)
    fitted = (
        classes.withColumns(
            {
                "reference": first,
                "total": F.sum("n").over(everything),
                "groups": F.count(F.lit(1)).over(everything),
                "rss": F.sum("squares").over(everything),
                "grand_mean": grand_mean,
            }
        )
        .withColumn(
            "explained",
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand_mean"), 2)).over(everything),
        )
        .withColumn("df", F.col("total") - F.col("groups"))
    )
    is_reference = F.col("LOH") == F.col("reference.LOH")
    variance_of_fit = ratio(F.col("rss"), F.col("df"))
    total_squares = F.col("rss") + F.col("explained")
    return (
        fitted.select(
            F.when(is_reference, F.lit("(Intercept)"))
            .otherwise(F.concat(F.lit("factor(LOH)"), "LOH"))
            .alias("term"),
            F.when(is_reference, F.col("mean"))
            .otherwise(F.col("mean") - F.col("reference.mean"))
            .alias("estimate"),
            F.sqrt(
                variance_of_fit
                * F.when(is_reference, ratio(F.lit(1), F.col("n"))).otherwise(
                    ratio(F.lit(1), F.col("n")) + ratio(F.lit(1), F.col("reference.n"))
                )
            ).alias("std_error"),
            F.col("total").alias("observations"),
            F.col("df").alias("residual_df"),
            F.sqrt(variance_of_fit).alias("residual_std_error"),
            (1 - ratio(F.col("rss"), total_squares)).alias("r_squared"),
            (
                1
                - ratio(F.col("rss"), total_squares) * ratio(F.col("total") - 1, F.col("df"))
            ).alias("adj_r_squared"),
            ratio(
                ratio(F.col("explained"), F.col("groups") - 1), variance_of_fit
            ).alias("f_statistic"),
        )
        .withColumn("t_value", ratio(F.col("estimate"), F.col("std_error")))
        .orderBy("term")
    )


def fuel_lines_by_shipper(
    lines: DataFrame, min_lines: int = 100_000, shippers: Sequence[str] | None = None
) -> DataFrame:
    """Lines per shipper and fuel type, only the large ones; optionally some shippers."""
    counts = (
        lines.where(F.col(TYPE).isin(FUEL_PAIR))
        .groupBy("shipper_master_code", TYPE)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > min_lines)
    )
    if shippers is not None:
        counts = counts.where(F.col("shipper_master_code").isin(list(shippers)))
    return counts.orderBy(F.desc("n"))


def fuel_shipper_counts(lines: DataFrame) -> DataFrame:
    """Distinct shippers per fuel type; a missing shipper counts as one."""
    return (
        lines.where(F.col(TYPE).isin(FUEL_PAIR))
        .groupBy(TYPE)
        .agg(
            count_distinct_with_missing(F.col("shipper_master_code")).alias(
                "count_distinct_shippercodes"
            )
        )
    )


def fuel_loh_distribution(lines: DataFrame) -> DataFrame:
    """Lines per haul class and fuel type, and their share of the type."""
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy(TYPE)))
    return (
        lines.where(F.col(TYPE).isin(FUEL_PAIR))
        .groupBy("LOH", TYPE)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", F.bround(share, 3))
        .orderBy(buckets.haul_rank(F.col("LOH")))
    )
