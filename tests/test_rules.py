import pytest
from pyspark.sql import functions as F

from moundworks.functions import numeric, rules


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("csw,tier", [
    (0.33, "elite"), (0.30, "above_avg"), (0.27, "average"), (0.23, "below_avg"), (0.19, "poor"),
    (0.32, "elite"), (0.29, "above_avg"), (0.26, "average"), (0.22, "below_avg"), (None, "poor")])
def test_performance_tier(spark, csw, tier):
    assert one(spark, rules.performance_tier(F.lit(csw).cast("double"))) == tier


@pytest.mark.parametrize("csw,grade", [
    (0.34, "A+"), (0.315, "A"), (0.295, "B+"), (0.27, "B"), (0.26, "C+"), (0.23, "C"), (0.21, "D")])
def test_letter_grade(spark, csw, grade):
    assert one(spark, rules.letter_grade(F.lit(csw))) == grade


def test_percentile_falls_with_csw(spark):
    got = [one(spark, rules.csw_percentile(F.lit(c))) for c in (0.36, 0.30, 0.24, 0.18)]
    assert got == [99, 70, 25, 5]


@pytest.mark.parametrize("csw,score", [(0.15, 0), (0.25, 35), (0.30, 60), (0.35, 84), (0.42, 100)])
def test_stuff_score_is_cut_and_truncated(spark, csw, score):
    # (0.25 - 0.18) / 0.2 * 100 is 35.000000000000003 and (0.35 - 0.18) / 0.2 * 100 is 84.99999999999999
    assert one(spark, rules.stuff_score(F.lit(csw))) == score


def test_direction_of_zero_is_negative(spark):
    assert one(spark, rules.direction(F.lit(0.0))) == "↓ negative"
    assert one(spark, rules.direction(F.lit(0.1))) == "↑ positive"


def test_rounding_is_half_up(spark):
    assert one(spark, numeric.rnd(F.lit(0.125), 2)) == 0.13
    assert one(spark, numeric.rnd(F.lit(-0.125), 2)) == -0.12
    assert one(spark, F.expr(numeric.sql_rnd("0.125D", 2))) == 0.13


def test_ratio_of_zero_is_null(spark):
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) is None


def test_formats(spark):
    assert one(spark, rules.pct(F.lit(0.2857))) == "28.6%"
    assert one(spark, rules.signed(F.lit(0.04), 1)) == "+0.0"
    assert one(spark, rules.signed(F.lit(-1.25), 2)) == "-1.25"
    null = F.lit(None).cast("double")
    assert one(spark, rules.or_dash(rules.pct(null), null)) == "—"


def test_names(spark):
    assert one(spark, rules.first_name(F.lit("Marcus Delgado"))) == "Marcus"
    assert one(spark, rules.tier_words(F.lit("above_avg"))) == "above avg"
