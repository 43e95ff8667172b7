"""The path for huge groups gives exactly what the plain window gives."""

import random

import pytest
from frames import day
from pyspark.sql import Window
from pyspark.sql import functions as F

from moundworks.operators.ordering import bounded_index, ordered_index, trailing_frame
from moundworks.operators.rolling import rolling_prior, rolling_rows


@pytest.fixture(scope="module")
def games(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(600):
        who = 1 if k % 3 == 0 else rnd.randrange(2, 30)  # one entity holds a third
        rows.append((who, k, day(rnd.randrange(0, 40)), rnd.choice([None, round(rnd.random(), 4)]),
                     round(rnd.random(), 4)))
    rows += [(None, 9000 + k, None, 0.5, 0.5) for k in range(30)]
    return spark.createDataFrame(
        rows, "batter_id int, game_pk int, game_date date, avg_xwoba double, base double").cache()


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("group", [["batter_id"], []])
def test_positions(games, group):
    order = ["game_date", "game_pk"]
    w = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    want = games.withColumn("row_idx", (F.row_number().over(w) - 1).cast("bigint"))
    got = ordered_index(games, order, group)
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_positions_of_copies(spark):
    copies = spark.createDataFrame([(1, "a")] * 500 + [(1, "b")] * 3, "g int, v string")
    got = ordered_index(copies, ["v"], ["g"]).collect()
    assert sorted(r.row_idx for r in got) == list(range(503))
    assert {r.v for r in got if r.row_idx < 500} == {"a"}


def test_descending_positions(games):
    order = [F.col("avg_xwoba").desc_nulls_last(), F.col("game_pk").asc()]
    plain = bounded_index(games, order, ["batter_id"])
    assert rows_of(ordered_index(games, order, ["batter_id"]).select(*plain.columns)) == rows_of(plain)


@pytest.mark.parametrize("limit", [6, 10, 64])
def test_rolling_rows_in_blocks(games, limit):
    plain = rolling_rows(games, {"avg_xwoba": 4})
    cut = rolling_rows(games, {"avg_xwoba": 4}, block_rows=limit)
    assert rows_of(cut.select(*plain.columns)) == rows_of(plain)


def test_rolling_prior_in_blocks(games):
    spec = {"avg_xwoba": ("base", 4)}
    plain = rolling_prior(games, spec, key="batter_id")
    cut = rolling_prior(games, spec, key="batter_id", block_rows=7)
    assert rows_of(cut.select(*plain.columns)) == rows_of(plain)


def test_lag_in_blocks(games):
    def columns(w):
        return {"before": F.lag("game_pk").over(w)}

    plain = trailing_frame(games, ["batter_id"], ["game_date", "game_pk"], 1, columns)
    cut = trailing_frame(games, ["batter_id"], ["game_date", "game_pk"], 1, columns, block_rows=5)
    assert rows_of(cut.select(*plain.columns)) == rows_of(plain)


def test_seven_row_mean_against_plain_python(games):
    rows = sorted([r for r in games.collect() if r.batter_id == 1], key=lambda r: (r.game_date, r.game_pk))
    got = {r.game_pk: r.avg_xwoba_7g for r in rolling_rows(games, {"avg_xwoba": 4}).collect()}
    for k, r in enumerate(rows):
        seen = [x.avg_xwoba for x in rows[max(0, k - 6):k + 1] if x.avg_xwoba is not None]
        if len(seen) < 2:
            assert got[r.game_pk] is None
        else:
            assert abs(got[r.game_pk] - sum(seen) / len(seen)) <= 0.5001e-4
