"""Raw pitch feed derived from the order-line table.

The given tables hold no pitches, so each order line is read as one pitch
event: supplier -> pitcher, part -> batter, ship date -> game day. Everything
is integer arithmetic or binary fractions, so the same rows come out of any
SQL engine. ``(l_orderkey, l_linenumber)`` repeats, which gives the feed real
duplicates to remove.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )


#: Equal for two order lines exactly where their ``pitch_id`` is, null ids included.
SAME_PITCH = {
    "_order": "CASE WHEN l_linenumber IS NOT NULL THEN l_orderkey END",
    "_line": "CASE WHEN l_orderkey IS NOT NULL THEN l_linenumber END",
}


def pitch_feed(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One raw event per order line, with the feed's own column names; ``keep`` names
    columns of ``lines`` that stay beside them."""
    base = lines.selectExpr(
        "*",
        "datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01') % 180 AS dd",
        "(l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 AS h",
        "(l_orderkey * 13 + l_partkey * 29 + l_linenumber * 5) % 997 AS h2",
        "CAST(l_suppkey - l_suppkey % 4 AS INT) AS pk4",
    ).withColumn("gday", F.expr("CAST(dd - dd % 5 AS INT)"))
    batted = "h2 % 20 >= 17"
    return base.selectExpr(
        *keep,
        "concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS pitch_id",
        "CAST(700000 + gday * 100 + pk4 % 20 AS INT) AS game_pk",
        "date_add(DATE '2024-04-01', gday) AS game_date",
        "CAST(l_linenumber + h % 3 AS INT) AS inning",
        "CASE WHEN pk4 % 8 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot",
        "CAST(1000 + pk4 AS BIGINT) AS pitcher",
        "CAST(2000 + l_partkey % 50 AS BIGINT) AS batter",
        """CASE WHEN h % 97 = 0 THEN NULL WHEN h % 10 < 5 THEN 'FF' WHEN h % 10 < 7 THEN 'SL'
                WHEN h % 10 < 8 THEN 'CH' WHEN h % 10 < 9 THEN 'CU' ELSE 'SI' END AS pitch_type""",
        "CAST(80 + l_quantity / 2 AS FLOAT) AS release_speed",
        "CAST(2000 + h AS FLOAT) AS release_spin_rate",
        "CAST(CAST(h % 33 - 16 AS DOUBLE) / 8 AS FLOAT) AS pfx_x",
        "CAST(CAST(h2 % 41 AS DOUBLE) / 8 AS FLOAT) AS pfx_z",
        "CAST(CAST(h % 17 - 8 AS DOUBLE) / 8 AS FLOAT) AS plate_x",
        "CAST(CAST(h2 % 33 AS DOUBLE) / 8 AS FLOAT) AS plate_z",
        "CAST(CASE WHEN h2 % 14 = 9 THEN NULL ELSE h2 % 14 + 1 END AS INT) AS zone",
        """CASE WHEN h2 % 20 < 4 THEN 'called_strike' WHEN h2 % 20 < 6 THEN 'swinging_strike'
                WHEN h2 % 20 < 7 THEN 'swinging_strike_blocked' WHEN h2 % 20 < 10 THEN 'foul'
                WHEN h2 % 20 < 17 THEN 'ball' ELSE 'hit_into_play' END AS description""",
        f"""CASE WHEN {batted} THEN CASE WHEN h % 5 < 3 THEN 'field_out' WHEN h % 5 = 3 THEN 'single'
                                         ELSE 'home_run' END
                WHEN h2 % 20 < 7 AND h % 4 = 0 THEN 'strikeout'
                WHEN h2 % 20 BETWEEN 10 AND 16 AND h % 6 = 0 THEN 'walk' END AS events""",
        """CASE WHEN l_partkey % 5 = 0 THEN CASE WHEN pk4 % 3 = 0 THEN 'R' ELSE 'L' END
                WHEN l_partkey % 2 = 0 THEN 'R' ELSE 'L' END AS stand""",
        "CASE WHEN pk4 % 3 = 0 THEN 'L' ELSE 'R' END AS p_throws",
        "CAST(h % 4 AS INT) AS balls",
        "CAST(h2 % 3 AS INT) AS strikes",
        "CAST(h % 3 AS INT) AS outs_when_up",
        f"CAST(CASE WHEN {batted} THEN 65 + l_quantity END AS FLOAT) AS launch_speed",
        f"CAST(CASE WHEN {batted} THEN h % 101 - 30 END AS FLOAT) AS launch_angle",
        f"CAST(CASE WHEN {batted} OR h % 7 = 0 THEN CAST(h % 256 AS DOUBLE) / 256 END AS FLOAT)"
        " AS estimated_ba_using_speedangle",
        f"CAST(CASE WHEN {batted} OR h % 7 = 0 THEN CAST(h % 256 AS DOUBLE) / 256 END AS FLOAT)"
        " AS estimated_woba_using_speedangle",
        "CAST(CAST(h % 65 - 32 AS DOUBLE) / 64 AS FLOAT) AS delta_run_exp",
        f"CASE WHEN {batted} THEN CAST(l_quantity >= 33 AND h % 101 BETWEEN 40 AND 70 AS INT) END AS barrel",
        "concat('T', CAST(gday % 7 + pk4 % 20 AS STRING)) AS home_team",
        "concat('U', CAST(gday % 7 + pk4 % 20 AS STRING)) AS away_team",
        "CAST(h % 11 AS INT) AS post_home_score",
        "CAST(h2 % 11 AS INT) AS post_away_score",
    )
