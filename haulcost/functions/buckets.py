"""Length of haul, mode, region and lane columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper mileage bounds of the length-of-haul classes.
HAUL_CLASSES = [
    (100, "City"),
    (250, "Short"),
    (500, "Mid"),
    (750, "Tweener"),
    (1000, "Long"),
    (1500, "Extra-long"),
]
HAUL_CLASSES_LABELLED = [
    (100, "City (0-100)"),
    (250, "Short (100-250)"),
    (500, "Mid (250-500)"),
    (750, "Tweener (500-750)"),
    (1000, "Long (750-1000)"),
]
HAUL_CUTS = [
    (100, "City"),
    (250, "Short"),
    (500, "Mid"),
    (750, "Tweener"),
    (1000, "Long"),
    (1500, "Extra-Long"),
    (10000, "Cross Country"),
]
LONGEST_HAUL = "Cross-country"
LONGEST_HAUL_LABELLED = "Extra-long (1000+)"
VAN_MODES = ["TRUCKLOAD (DRY VAN)", "TRUCKLOAD", "MOTOR", "BROKER"]
REEFER_MODE = "TRUCKLOAD (TEMP-CONTROLLED)"
REGIONS = {"Atlantic": "012", "South": "37", "Midwest": "456", "West": "89"}


def _below(distance: Column, classes: list[tuple[int, str]], rest: str) -> Column:
    ladder = F
    for bound, label in classes:
        ladder = ladder.when(distance < bound, F.lit(label))
    return ladder.otherwise(F.lit(rest))


def haul_class(distance: Column) -> Column:
    """Seven classes, bounds excluded; a missing distance counts as the longest."""
    return _below(distance, HAUL_CLASSES, LONGEST_HAUL)


def haul_class_labelled(distance: Column) -> Column:
    """Six classes with the mileage in the label; a missing distance is the longest."""
    return _below(distance, HAUL_CLASSES_LABELLED, LONGEST_HAUL_LABELLED)


def haul_cut(distance: Column) -> Column:
    """Seven classes, bounds included; NULL outside (0, 10000]."""
    ladder = F.when(distance <= 0, F.lit(None).cast("string"))
    for bound, label in HAUL_CUTS:
        ladder = ladder.when(distance <= bound, F.lit(label))
    return ladder


def haul_rank(label: Column) -> Column:
    """Position of a class in increasing length, whichever of the two label sets."""
    names = [name for _, name in HAUL_CLASSES] + [LONGEST_HAUL]
    labelled = [name for _, name in HAUL_CLASSES_LABELLED] + [LONGEST_HAUL_LABELLED]
    ladder = F
    for position, name in [*enumerate(names), *enumerate(labelled)]:
        ladder = ladder.when(label == name, F.lit(position))
    return ladder


def mode_class(mode: Column, rest: str = "OTHER") -> Column:
    return (
        F.when(mode.isin(VAN_MODES), F.lit("VAN"))
        .when(mode == REEFER_MODE, F.lit("REEFER"))
        .otherwise(F.lit(rest))
    )


def zip_region(postal_code: Column) -> Column:
    """Region by first digit of a postal code, ``N/A`` for anything else."""
    digit = F.substring(postal_code, 1, 1)
    ladder = F
    for region, digits in REGIONS.items():
        ladder = ladder.when(digit.isin(list(digits)), F.lit(region))
    return ladder.otherwise(F.lit("N/A"))


def zip3(postal_code: Column) -> Column:
    return F.substring(postal_code, 1, 3)


def zip3_lane() -> Column:
    """``origin-destination`` on three digits; NULL if either end is missing."""
    return F.concat(
        zip3(F.col("origin_postal_code")), F.lit("-"), zip3(F.col("destination_postal_code"))
    )


def state_lane() -> Column:
    """``origin-destination`` state pair; NULL if either end is missing."""
    return F.concat(F.col("origin_state"), F.lit("-"), F.col("destination_state"))


def lane_text() -> Column:
    """``origin:destination`` over zip3 columns, a missing end written as ``NA``."""
    return F.concat(
        F.coalesce(F.col("origin_zip3"), F.lit("NA")),
        F.lit(":"),
        F.coalesce(F.col("dest_zip3"), F.lit("NA")),
    )
