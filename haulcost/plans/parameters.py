"""Periods and thresholds that suit the small test ledger.

The published defaults live on the jobs; they belong to a ledger of hundreds of
millions of lines from other years.
"""

SHIP_FROM = "1997-01-01"
CREATED_AFTER = "1996-06-30"
AS_OF = "2001-12-31"
LANE_LOADS = 100
SHIPPER_LOADS = 100
MODE_LOADS = 100
KEYWORD_LOADS = 10
SHIPPER_LINES = 20
LANE_SHIPPERS = 3
CARRIER = "CARRIER_3"
MIXED_LINES = 1
# Doubles that depend on the order of summation are compared to this many digits.
DIGITS = 9
# Places on principal components pass through an eigenvector and are compared to fewer.
PLACE_DIGITS = 6
# Lines created from this day on come late to the refreshed result.
LATE_FROM = "1997-09-01"
# Loads that the sample of a given number draws.
SAMPLE = 1000
