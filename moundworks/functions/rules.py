"""Column rules: tiers, grades, percentiles, labels and text formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from moundworks import constants as K
from moundworks.functions.numeric import rnd


def _steps(col: Column, floors: list, default) -> Column:
    (first_floor, first_label), *rest = floors
    expr = F.when(col >= F.lit(first_floor), F.lit(first_label))
    for floor, label in rest:
        expr = expr.when(col >= F.lit(floor), F.lit(label))
    return expr.otherwise(F.lit(default))


def performance_tier(csw: Column) -> Column:
    """Tier of a CSW rate; a null rate is ``poor``."""
    return _steps(csw, K.TIER_FLOORS, "poor")


def letter_grade(csw: Column) -> Column:
    return _steps(csw, K.GRADE_FLOORS, "D")


def csw_percentile(csw: Column) -> Column:
    return _steps(csw, K.PERCENTILE_FLOORS, 5)


def stuff_score(predicted_csw: Column) -> Column:
    """Predicted CSW placed on 0..100 between .18 and .38, truncated."""
    points = (predicted_csw - F.lit(0.18)) / F.lit(0.20) * F.lit(100.0)
    return F.floor(F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0))).cast("int")


def direction(value: Column) -> Column:
    return F.when(value > 0, F.lit(K.UP)).otherwise(F.lit(K.DOWN))


# Predicates over a pitch, as SQL text.
# The coded swing: descriptions that carry the word. Misses only, in the feed's vocabulary.
SWING_LITERAL = "description LIKE '%swing%'"
# Every swing: misses, fouls and balls put in play.
SWING_ALL = (
    "(description LIKE 'swinging_strike%' OR description LIKE 'foul%'"
    " OR description LIKE 'hit_into_play%' OR description = 'missed_bunt')"
)
MISSED = "description = 'swinging_strike'"
CALLED_OR_MISSED = "description IN ('called_strike', 'swinging_strike')"
IN_ZONE = "zone BETWEEN 1 AND 9"
OUT_OF_ZONE = "zone IN (11, 12, 13, 14)"
BATTED = "launch_speed IS NOT NULL"


def first_name(full_name: Column) -> Column:
    return F.split(full_name, " ")[0]


def tier_words(tier: Column) -> Column:
    return F.regexp_replace(tier, "_", " ")


def pct(col: Column, digits: int = 1) -> Column:
    """0.2857 -> '28.6%'. Rounded first, so the text never depends on a tie."""
    return F.format_string(f"%.{digits}f%%", rnd(col * F.lit(100.0), digits))


def fixed(col: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", rnd(col, digits))


def signed(col: Column, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", rnd(col, digits))


def or_dash(text: Column, source: Column) -> Column:
    return F.when(source.isNull(), F.lit("—")).otherwise(text)


def grouped(col: Column) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(col, 0)


def short_date(col: Column) -> Column:
    return F.date_format(col, "MMM dd, yyyy")


def long_date(col: Column) -> Column:
    return F.date_format(col, "MMMM dd, yyyy")
