"""Column lists and types of the stored layers."""

from pyspark.sql import types as T

# --- fixed values: names and types of the feed and of the stored layers -------
# feed column -> type. These are the columns kept from a raw extract.
FEED_COLUMNS = [
    ("game_pk", "int"), ("game_date", "date"), ("inning", "int"), ("inning_topbot", "string"),
    ("pitcher", "bigint"), ("batter", "bigint"),
    ("pitch_type", "string"), ("release_speed", "float"), ("release_spin_rate", "float"),
    ("pfx_x", "float"), ("pfx_z", "float"), ("plate_x", "float"), ("plate_z", "float"),
    ("zone", "int"), ("description", "string"), ("events", "string"),
    ("stand", "string"), ("p_throws", "string"),
    ("balls", "int"), ("strikes", "int"), ("outs_when_up", "int"),
    ("launch_speed", "float"), ("launch_angle", "float"),
    ("estimated_ba_using_speedangle", "float"), ("estimated_woba_using_speedangle", "float"),
    ("delta_run_exp", "float"), ("barrel", "int"),
    ("home_team", "string"), ("away_team", "string"),
    ("post_home_score", "int"), ("post_away_score", "int"),
]

RENAMES = {
    "pitcher": "pitcher_id",
    "batter": "batter_id",
    "release_spin_rate": "release_spin",
    "estimated_ba_using_speedangle": "estimated_ba",
    "estimated_woba_using_speedangle": "estimated_woba",
    "barrel": "is_barrel",
}

# the typed fact table, one row per pitch
PITCH_COLUMNS = [
    ("pitch_id", "string"), ("game_pk", "int"), ("game_date", "date"),
    ("pitcher_id", "int"), ("batter_id", "int"), ("inning", "int"), ("inning_topbot", "string"),
    ("pitch_type", "string"), ("release_speed", "float"), ("release_spin", "float"),
    ("pfx_x", "float"), ("pfx_z", "float"), ("plate_x", "float"), ("plate_z", "float"),
    ("zone", "int"), ("description", "string"), ("events", "string"),
    ("stand", "string"), ("p_throws", "string"),
    ("balls", "int"), ("strikes", "int"), ("outs_when_up", "int"),
    ("launch_speed", "float"), ("launch_angle", "float"),
    ("estimated_ba", "float"), ("estimated_woba", "float"), ("delta_run_exp", "float"),
    ("is_barrel", "boolean"), ("home_team", "string"), ("away_team", "string"),
    ("post_home_score", "int"), ("post_away_score", "int"),
]

INSIGHT_BODY = T.StructType([
    T.StructField("performance_tier", T.StringType()),
    T.StructField("headline", T.StringType()),
    T.StructField("key_finding", T.StringType()),
    T.StructField("concern_flag", T.StringType()),
    T.StructField("pitch_mix_note", T.StringType()),
])

INSIGHT_FILE = T.StructType([
    T.StructField("pitcher_id", T.LongType()),
    T.StructField("pitcher_name", T.StringType()),
    T.StructField("game_pk", T.LongType()),
    T.StructField("game_date", T.StringType()),
    *INSIGHT_BODY.fields,
])

INSIGHT_KEY = ["pitcher_id", "game_pk", "insight_type"]
# ------------------------------------------------------------------------------
