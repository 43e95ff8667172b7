"""Small hand-written frames."""

from datetime import date, timedelta

from moundworks.sources.schemas import PITCH_COLUMNS

PITCH_DDL = ", ".join(f"{c} {t}" for c, t in PITCH_COLUMNS)
DAY = date(2024, 6, 1)


def day(n):
    return DAY + timedelta(days=n)


def pitches(spark, rows):
    base = {"game_pk": 1, "game_date": DAY, "pitcher_id": 10, "batter_id": 20, "inning": 1,
            "inning_topbot": "Top", "pitch_type": "FF", "release_speed": 95.0, "description": "ball",
            "zone": 5, "is_barrel": False, "home_team": "H", "away_team": "A", "p_throws": "R", "stand": "L"}
    names = [c for c, _ in PITCH_COLUMNS]
    full = [{**base, "pitch_id": f"p{k}", **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], PITCH_DDL)


def summary(spark, rows):
    """Rows of (pitcher, game, day offset, velo, csw, whiff)."""
    return spark.createDataFrame(
        [(p, g, None if d is None else day(d), v, c, w) for p, g, d, v, c, w in rows],
        "pitcher_id int, game_pk int, game_date date, avg_velo double, csw_rate double, whiff_rate double",
    )


def by(df, *keys):
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in keys)
        assert k not in out, f"two rows for {k}"
        out[k if len(k) > 1 else k[0]] = r
    return out
