"""How often charges, keywords and words occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.functions import buckets, classify
from haulcost.functions.stats import ratio

DESCRIPTION = "accessorial_charge_description"


def _distinct_texts(ledger: DataFrame, *keys: Column) -> DataFrame:
    """Lines per distinct raw description and key.

    There are few spellings compared with lines, so whatever is derived from
    the text is then derived once per spelling. Unfold lists made from it with
    ``explode_outer``: plain ``explode`` makes the optimizer filter the lines by
    the size of the list, which derives it once per line after all.
    """
    return ledger.groupBy(*keys, DESCRIPTION).agg(F.count(F.lit(1)).alias("lines"))


def charge_frequency(ledger: DataFrame) -> DataFrame:
    """Lines per raw description, most frequent first; missing text counts 0."""
    return (
        ledger.groupBy(DESCRIPTION)
        .agg(F.count(DESCRIPTION).alias("count"))
        .orderBy(F.desc("count"), DESCRIPTION)
    )


def charge_frequency_by_mode(energy_lines: DataFrame) -> DataFrame:
    """Non-base lines of the energy study per charge type and mode class."""
    return (
        energy_lines.where(F.col(DESCRIPTION) != "BASE CHARGE")
        .groupBy(DESCRIPTION, "mode")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("mode", F.desc("n"))
    )


def van_reefer_lines(ledger: DataFrame, ship_from: str) -> DataFrame:
    """Lines of van and reefer loads shipped from a date on, with the mode class."""
    mode = buckets.mode_class(F.col("transportation_mode_description"), "Other")
    return ledger.where(F.col("ship_date") >= F.lit(ship_from).cast("date")).withColumn(
        "mode", mode
    ).where(F.col("mode").isin("VAN", "REEFER"))


def raw_charge_frequency_by_mode(ledger: DataFrame, ship_from: str = "2021-07-01") -> DataFrame:
    """Van and reefer lines per raw description and mode class."""
    return (
        van_reefer_lines(ledger, ship_from)
        .groupBy(DESCRIPTION, "mode")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"))
    )


def charge_frequency_by_mode_system(
    ledger: DataFrame, ship_from: str = "2022-05-01"
) -> DataFrame:
    """Van and reefer lines per raw description, mode class and billing system."""
    return (
        van_reefer_lines(ledger, ship_from)
        .groupBy(DESCRIPTION, "mode", F.upper("system_type").alias("system_type"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"))
    )


def lane_traffic(ledger: DataFrame) -> DataFrame:
    """Loads per state lane, busiest first."""
    return (
        ledger.groupBy(buckets.state_lane().alias("state_lane"))
        .agg(F.count_distinct("cass_shipment_id").alias("loads_per_lane"))
        .orderBy(F.desc("loads_per_lane"))
    )


def keyword_counts_by_system(ledger: DataFrame) -> DataFrame:
    """Lines per keyword and billing system; a line counts for every keyword in it."""
    labels = classify.matching_labels(F.upper(DESCRIPTION), classify.COUNT_RULES)
    return (
        _distinct_texts(ledger, F.upper("system_type").alias("system_type"))
        .select("system_type", labels.alias("labels"), "lines")
        .select("system_type", F.explode_outer("labels").alias(DESCRIPTION), "lines")
        .where(F.col(DESCRIPTION).isNotNull())
        .groupBy("system_type", DESCRIPTION)
        .agg(F.sum("lines").alias("count"))
    )


def keyword_mix_legacy_vs_global(ledger: DataFrame) -> DataFrame:
    """Each keyword's share of all keyword hits, in the two billing systems."""

    def lines(system: str) -> Column:
        return F.max(F.when(F.col("system_type") == system, F.col("count")))

    # One row per keyword of a fixed list, so the total needs no partitioning.
    everything = Window.partitionBy()
    wide = (
        keyword_counts_by_system(ledger)
        .groupBy(DESCRIPTION)
        .agg(lines("LEGACY").alias("legacy"), lines("GLOBAL").alias("global"))
        .withColumn("legacy_sum", F.sum("legacy").over(everything))
        .withColumn("global_sum", F.sum("global").over(everything))
    )
    legacy = ratio(F.col("legacy"), F.col("legacy_sum"))
    worldwide = ratio(F.col("global"), F.col("global_sum"))
    return wide.select(
        DESCRIPTION,
        "legacy",
        "legacy_sum",
        "global",
        "global_sum",
        F.round(legacy * 100, 2).alias("legacy_pct"),
        F.round(worldwide * 100, 2).alias("global_pct"),
        F.round((legacy - worldwide) * 100, 2).alias("pct_diff"),
    ).orderBy("pct_diff")


def ca_charge_words(ledger: DataFrame) -> DataFrame:
    """Raw descriptions of California charges, most frequent first."""
    return charge_frequency(ledger.where(classify.is_california(F.upper(DESCRIPTION))))


# Characters that join two letters, or two digits, into one word.
LETTER_JOINTS = "'’."
DIGIT_JOINTS = "'’.,;"
# Ends a run of characters that could belong to one word ...
RUN_BREAK = rf"[^\p{{L}}\p{{M}}\p{{N}}_{DIGIT_JOINTS}]+"
# ... and a joint inside a run that does not join what stands around it.
WORD_BREAK = (
    rf"(?<![\p{{L}}\p{{M}}\p{{N}}])[{DIGIT_JOINTS}]"
    rf"|(?<=[\p{{L}}\p{{M}}])[{LETTER_JOINTS}](?!\p{{L}})"
    rf"|(?<=[\p{{L}}\p{{M}}])[,;]"
    rf"|(?<=\p{{N}})[{DIGIT_JOINTS}](?!\p{{N}})"
)


def description_word_frequency(ledger: DataFrame) -> DataFrame:
    """Words of the charge descriptions over all lines."""
    return word_frequency(_distinct_texts(ledger), DESCRIPTION, "lines")


def charge_frequency_by_lane(ledger: DataFrame) -> DataFrame:
    """Lines per state lane and charge keyword."""
    return (
        _distinct_texts(ledger, buckets.state_lane().alias("state_lane"))
        .groupBy(
            "state_lane",
            classify.share_keyword(F.col(DESCRIPTION)).alias("accessorial_charge_keyword"),
        )
        .agg(F.sum("lines").alias("lines"))
        .orderBy("state_lane", F.desc("lines"))
    )


def word_frequency(texts: DataFrame, column: str, times: str | None = None) -> DataFrame:
    """Occurrences of each lower-case word of a text column, most frequent first.

    ``times`` names a column saying how often a text occurs.

    Words are runs of letters, digits and marks. An apostrophe or full stop
    between letters, and also a comma or semicolon between digits, stays inside
    the word; every other character ends it. Texts are cut at the plain breaks
    and the runs counted first; only distinct runs are looked at for joints.
    """

    def pieces(frame: DataFrame, cut: Column) -> DataFrame:
        return (
            frame.select(cut.alias("pieces"), "times")
            .select(F.explode_outer("pieces").alias("word"), "times")
            .where(F.col("word") != "")
            .groupBy("word")
            .agg(F.sum("times").alias("times"))
        )

    occurrences = F.lit(1).cast("bigint") if times is None else F.col(times)
    runs = pieces(
        texts.withColumn("times", occurrences), F.split(F.lower(F.col(column)), RUN_BREAK)
    )
    return (
        pieces(runs, F.split("word", WORD_BREAK))
        .where(F.col("word").rlike(r"[\p{L}\p{N}]"))
        .withColumnRenamed("times", "n")
        .orderBy(F.desc("n"), "word")
    )
