"""Values that several operators share.

The tables below are fixed values: results are only right when they are
exactly these numbers and words.
"""

# --- fixed values -----------------------------------------------------------
LEAGUE_AVG = {
    "csw_rate": 0.281,
    "whiff_rate": 0.254,
    "barrel_rate": 0.078,
    "avg_xwoba": 0.312,
    "avg_exit_velo": 88.5,
    "zone_rate": 0.475,
    "chase_rate": 0.295,
}

TIERS = ["elite", "above_avg", "average", "below_avg", "poor"]
TIER_FLOORS = [(0.32, "elite"), (0.29, "above_avg"), (0.26, "average"), (0.22, "below_avg")]
GRADE_FLOORS = [(0.33, "A+"), (0.31, "A"), (0.29, "B+"), (0.27, "B"), (0.25, "C+"), (0.23, "C")]
PERCENTILE_FLOORS = [
    (0.35, 99), (0.33, 95), (0.31, 85), (0.29, 70),
    (0.27, 55), (0.25, 40), (0.23, 25), (0.20, 10),
]

# metric, higher is better, elite, above average, average
METRIC_TIERS = [
    ("csw_rate", True, 0.32, 0.29, 0.26),
    ("whiff_rate", True, 0.33, 0.28, 0.23),
    ("avg_xwoba_allowed", False, 0.27, 0.29, 0.31),
    ("barrel_rate_allowed", False, 0.05, 0.07, 0.09),
]
STAR_WHIFF = 0.32
STAR_CSW = 0.31

FASTBALLS = ["FF", "SI"]
OFFSPEED_WORDS = {"SL": "slider", "CU": "curveball", "CH": "changeup"}

FEATURES = [
    "rolling_30d_avg_velo", "rolling_30d_whiff_rate", "rolling_30d_csw_rate",
    "velo_vs_30d_avg", "whiff_rate_delta",
    "avg_spin", "avg_h_break", "avg_v_break", "stuff_diversity",
    "zone_rate", "chase_rate",
    "barrel_rate_allowed", "avg_xwoba_allowed",
    "total_pitches", "home_away",
]
TARGET = "csw_rate"

UP, DOWN = "↑ positive", "↓ negative"
# --- end of fixed values ----------------------------------------------------

GAME_KEY = ["pitcher_id", "game_pk", "game_date"]
BATTER_KEY = ["batter_id", "game_pk", "game_date"]
