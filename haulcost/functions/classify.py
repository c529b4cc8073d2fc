"""Rules that turn free-text charge descriptions into labels.

A rule set is an ordered list of ``(label, LIKE patterns)``. Two readings exist
and give different answers: *first match* (one label per line) and *matching
labels* (every label whose pattern occurs, so one line can count several times).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, list[str]]]

# Charge patterns, matched on upper-case text unless noted.
FUEL_RULES: Rules = [
    ("FUEL SURCHARGE", ["%FUEL%SUR%", "%SUR%FUEL%"]),
    ("FUEL CHARGE", ["%FUEL%CH%"]),
]
ENERGY_RULES: Rules = [
    ("BASE CHARGE", ["%BASE%"]),
    ("ENERGY SURCHARGE (FUEL ADJUSTMENT FACTOR)", ["%ENERGY%SUR%(FUEL%"]),
    ("ENERGY CHARGE (FUEL ADJUSTMENT FACTOR)", ["%ENERGY%CH%(FUEL%"]),
    ("ENERGY SURCHARGE", ["%ENERGY%SUR%"]),
    ("ENERGY CHARGE", ["%ENERGY%CH%"]),
    ("ENERGY OTHER", ["%ENERGY%"]),
    ("FUEL SURCHARGE", ["%FUEL%SUR%", "%SUR%FUEL%"]),
    ("FUEL CHARGE", ["%FUEL%CH%"]),
    ("FUEL TAX", ["%FUEL%TAX%"]),
    ("FUEL", ["FUEL"]),
    ("FUEL ADJUSTMENT", ["%FUEL%ADJ%"]),
    ("FUEL DELIVERY", ["%DELIVERY%FUEL%"]),
    ("FUEL ORIGIN", ["%ORIGIN%FUEL%"]),
    ("FUEL DESTINATION", ["%DESTINATION%FUEL%"]),
    ("FUEL OTHER", ["%FUEL%"]),
]
SHARE_RULES: Rules = [
    ("BASE", ["%BASE%"]),
    ("FUEL", ["%FUEL%"]),
    ("TOLL", ["%TOLL%"]),
    ("LABOR", ["%LABOR%"]),
    ("LUMPER", ["%LUMPER%"]),
    ("DETENTION", ["%DETENTION%"]),
    ("PICKUP/DELIVERY", ["%PICKUP%", "%PICK UP%", "%DELIVERY%"]),
    ("USED", ["%USED%"]),
    ("REDELIVERY", ["%REDELIVERY%", "%RE-DELIVERY%"]),
    ("STOP", ["%STOP%"]),
    ("LOADING", ["%LOADING%"]),
]
COUNT_RULES: Rules = [
    ("FUEL", ["%FUEL%"]),
    ("TOLL", ["%TOLL%"]),
    ("LABOR", ["%LABOR%"]),
    ("LUMPER", ["%LUMPER%"]),
    ("DETENTION", ["%DETENTION%"]),
    ("PICKUP/DELIVERY", ["%PICKUP%", "%PICK UP%", "%DELIVERY%"]),
    ("USED", ["%USED%"]),
    ("REDELIVERY", ["%REDELIVERY%"]),
    ("STOP", ["%STOP%"]),
    ("LOADING", ["%LOADING%"]),
]
VARIANCE_RULES_10: Rules = [
    ("fuel", ["%FUEL%"]),
    ("toll", ["%TOLL%"]),
    ("labor", ["%LABOR%"]),
    ("lumper", ["%LUMPER%"]),
    ("detention", ["%DETENTION%"]),
    ("pickup/delivery", ["%PICKUP%", "%PICK UP%", "%DELIVERY%"]),
    ("used", ["%USED%"]),
    ("redelivery", ["%REDELIVERY%", "%RE-DELIVERY%"]),
    ("stop", ["%STOP%"]),
    ("loading", ["%LOADING%"]),
]
VARIANCE_RULES_18: Rules = VARIANCE_RULES_10 + [
    ("tax", ["%TAX%"]),
    ("discount", ["%DISCOUNT%"]),
    ("freight", ["%FREIGHT%"]),
    ("handling", ["%HANDLING%"]),
    ("security", ["%SECURITY%"]),
    ("weight", ["%WEIGHT%"]),
    ("customs", ["%CUSTOMS%"]),
    ("hazardous", ["%HAZARDOUS%"]),
]
BASE_PATTERNS = ["%BASE%"]
LINEHAUL_PATTERNS = ["%BASE%", "%LINEHAUL%", "%LINE HAUL%"]
CALIFORNIA_FALSE_FRIENDS = ["%CAN%", "%FCA%", "%WEIGHT%", "%TSCA%", "%APCA%", "%ECA%"]
# Patterns matched on the text as written, in the case given.
RAW_BASE_FUEL_PATTERNS = ["%Fuel%", "%FUEL%", "%BASE%"]
RAW_FUEL_WORDS = ["FUEL", "ENERGY"]
RAW_BASE_WORDS = ["BASE"]
RAW_TARGETED_WORDS = [
    "PICKUP",
    "DELIVERY",
    "LOADING",
    "USED",
    "TOLL",
    "TAX",
    "CUSTOMS",
    "BORDER",
    "COMPLIANCE",
    "MANAGEMENT",
    "MISCELL",
    "DUTY",
    "CARBON",
]


def _like(text: Column, pattern: str) -> Column:
    """``LIKE``, looking first whether all words of the pattern occur at all.

    A pattern of one word is a plain search anyway. Only patterns of several
    words run as a regex, and few lines hold all of their words.
    """
    words = [word for word in pattern.split("%") if word]
    if len(words) < 2:
        return text.like(pattern)
    return reduce(lambda a, b: a & b, [*map(text.contains, words), text.like(pattern)])


def like_any(text: Column, patterns: list[str]) -> Column:
    """True if any pattern matches; NULL for NULL text, as in SQL."""
    return reduce(lambda a, b: a | b, [_like(text, p) for p in patterns])


def like_none(text: Column, patterns: list[str]) -> Column:
    """True if no pattern matches; NULL for NULL text, so a filter drops it."""
    return ~like_any(text, patterns)


def contains_any(text: Column, words: list[str]) -> Column:
    """True if any word occurs; a missing text counts as "not found"."""
    found = reduce(lambda a, b: a | b, map(text.contains, words))
    return F.coalesce(found, F.lit(False))


def first_match(text: Column, rules: Rules, otherwise: Column | str | None = None) -> Column:
    """Label of the first rule that matches."""
    ladder = F
    for label, patterns in rules:
        ladder = ladder.when(like_any(text, patterns), F.lit(label))
    if otherwise is None:
        return ladder
    return ladder.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def matching_labels(text: Column, rules: Rules) -> Column:
    """Array of the labels of all rules that match.

    ``array_except`` drops the NULLs in generated code, ``array_compact`` does not.
    """
    hits = [F.when(like_any(text, patterns), F.lit(label)) for label, patterns in rules]
    return F.array_except(F.array(*hits), F.array(F.lit(None).cast("string")))


def is_california(text: Column) -> Column:
    """Charge for driving in California, without the look-alike words."""
    return text.like("%CALIFORNIA%") | (
        text.like("%CA %") & like_none(text, CALIFORNIA_FALSE_FRIENDS)
    )


def fuel_type(text: Column) -> Column:
    return first_match(F.upper(text), FUEL_RULES, "OTHER")


def energy_type(text: Column) -> Column:
    return first_match(F.upper(text), ENERGY_RULES, F.upper(text))


def share_keyword(text: Column) -> Column:
    return first_match(F.upper(text), SHARE_RULES, "OTHER")
