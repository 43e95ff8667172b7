"""DuckDB statements that give the same rows as the registered queries.

Each statement is a chain of named steps, written on its own and without
looking at how the Spark side computes: windows over whole keys, ``stddev``,
lateral joins and so on.
"""

from moundworks import constants as K
from moundworks import templates as text

# name -> (steps it reads, SQL body)
STEPS: dict[str, tuple[list[str], str]] = {}


def step(name: str, needs: list[str], body: str) -> None:
    STEPS[name] = (needs, body.strip())


def statement(needs: list[str], body: str) -> str:
    """``WITH`` chain of all steps that ``needs`` reach, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in STEPS[name][0]:
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    chain = ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in ordered)
    return f"WITH {chain}\n{body.strip()}"


def r(expr: str, digits: int) -> str:
    p = f"{10.0 ** digits}"
    return f"(floor(({expr}) * {p} + 0.5) / {p})"


def i(expr: str, digits: int) -> str:
    return f"CAST(floor(({expr}) * {10.0 ** digits} + 0.5) AS BIGINT)"


def total(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS DOUBLE)"


def over(num: str, den: str, digits: int = 4) -> str:
    return r(f"{num} / NULLIF({den}, 0)", digits)


def mean_i(col: str, digits: int, window: str, out: int | None = None) -> str:
    """Rounded mean of scaled integers over a window or group (window may be '')."""
    v = i(col, digits)
    return r(f"CAST(SUM({v}) {window} AS DOUBLE) / NULLIF(COUNT({v}) {window}, 0) / {10.0 ** digits}",
             digits if out is None else out)


step("lines", [], """
SELECT *, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS dd,
  (l_orderkey*31 + l_partkey*17 + l_linenumber*7) % 1000 AS h,
  (l_orderkey*13 + l_partkey*29 + l_linenumber*5) % 997 AS h2,
  CAST(l_suppkey - l_suppkey % 4 AS INTEGER) AS pk4
FROM lineitem
""")
step("days", ["lines"], "SELECT *, CAST((dd % 180) - (dd % 180) % 5 AS INTEGER) AS gday FROM lines")
step("feed", ["days"], """
SELECT
  concat(CAST(l_orderkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR)) AS pitch_id,
  CAST(700000 + gday*100 + pk4 % 20 AS INTEGER) AS game_pk,
  CAST(DATE '2024-04-01' + gday AS DATE) AS game_date,
  CAST(1000 + pk4 AS INTEGER) AS pitcher_id,
  CAST(2000 + l_partkey % 50 AS INTEGER) AS batter_id,
  CAST(l_linenumber + h % 3 AS INTEGER) AS inning,
  CASE WHEN pk4 % 8 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
  CASE WHEN h % 97 = 0 THEN NULL WHEN h % 10 < 5 THEN 'FF' WHEN h % 10 < 7 THEN 'SL'
       WHEN h % 10 < 8 THEN 'CH' WHEN h % 10 < 9 THEN 'CU' ELSE 'SI' END AS pitch_type,
  CAST(80 + l_quantity/2 AS FLOAT) AS release_speed,
  CAST(2000 + h AS FLOAT) AS release_spin,
  CAST(CAST(h % 33 - 16 AS DOUBLE)/8 AS FLOAT) AS pfx_x,
  CAST(CAST(h2 % 41 AS DOUBLE)/8 AS FLOAT) AS pfx_z,
  CAST(CAST(h % 17 - 8 AS DOUBLE)/8 AS FLOAT) AS plate_x,
  CAST(CAST(h2 % 33 AS DOUBLE)/8 AS FLOAT) AS plate_z,
  CAST(CASE WHEN h2 % 14 = 9 THEN NULL ELSE h2 % 14 + 1 END AS INTEGER) AS zone,
  CASE WHEN h2 % 20 < 4 THEN 'called_strike' WHEN h2 % 20 < 6 THEN 'swinging_strike'
       WHEN h2 % 20 < 7 THEN 'swinging_strike_blocked' WHEN h2 % 20 < 10 THEN 'foul'
       WHEN h2 % 20 < 17 THEN 'ball' ELSE 'hit_into_play' END AS description,
  CASE WHEN h2 % 20 >= 17 THEN (CASE WHEN h % 5 < 3 THEN 'field_out' WHEN h % 5 = 3 THEN 'single' ELSE 'home_run' END)
       WHEN h2 % 20 < 7 AND h % 4 = 0 THEN 'strikeout'
       WHEN h2 % 20 BETWEEN 10 AND 16 AND h % 6 = 0 THEN 'walk' END AS events,
  CASE WHEN l_partkey % 5 = 0 THEN (CASE WHEN pk4 % 3 = 0 THEN 'R' ELSE 'L' END)
       WHEN l_partkey % 2 = 0 THEN 'R' ELSE 'L' END AS stand,
  CASE WHEN pk4 % 3 = 0 THEN 'L' ELSE 'R' END AS p_throws,
  CAST(h % 4 AS INTEGER) AS balls, CAST(h2 % 3 AS INTEGER) AS strikes, CAST(h % 3 AS INTEGER) AS outs_when_up,
  CAST(CASE WHEN h2 % 20 >= 17 THEN 65 + l_quantity END AS FLOAT) AS launch_speed,
  CAST(CASE WHEN h2 % 20 >= 17 THEN h % 101 - 30 END AS FLOAT) AS launch_angle,
  CAST(CASE WHEN h2 % 20 >= 17 OR h % 7 = 0 THEN CAST(h % 256 AS DOUBLE)/256 END AS FLOAT) AS estimated_ba,
  CAST(CASE WHEN h2 % 20 >= 17 OR h % 7 = 0 THEN CAST(h % 256 AS DOUBLE)/256 END AS FLOAT) AS estimated_woba,
  CAST(CAST(h % 65 - 32 AS DOUBLE)/64 AS FLOAT) AS delta_run_exp,
  (h2 % 20 >= 17 AND l_quantity >= 33 AND h % 101 BETWEEN 40 AND 70) AS is_barrel,
  concat('T', CAST(gday % 7 + pk4 % 20 AS VARCHAR)) AS home_team,
  concat('U', CAST(gday % 7 + pk4 % 20 AS VARCHAR)) AS away_team,
  CAST(h % 11 AS INTEGER) AS post_home_score, CAST(h2 % 11 AS INTEGER) AS post_away_score
FROM days
""")

ORDER_COLUMNS = [
    "pitcher_id", "batter_id", "inning", "inning_topbot", "pitch_type", "release_speed", "release_spin",
    "pfx_x", "pfx_z", "plate_x", "plate_z", "zone", "description", "events", "stand", "p_throws",
    "balls", "strikes", "outs_when_up", "launch_speed", "launch_angle", "estimated_ba", "estimated_woba",
    "delta_run_exp", "is_barrel", "home_team", "away_team", "post_home_score", "post_away_score",
]
_FULL_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ["game_pk", *ORDER_COLUMNS])

step("pitches", ["feed"], f"""
SELECT * FROM feed
QUALIFY row_number() OVER (PARTITION BY pitch_id ORDER BY game_date NULLS FIRST, {_FULL_ORDER}) = 1
""")

SWING = "description LIKE '%swing%'"
OUTSIDE = "zone IN (11,12,13,14)"
BATTED = "launch_speed IS NOT NULL"


def base_columns(swing: str = SWING) -> str:
    return f"""
  COUNT(*) AS total_pitches,
  {r('AVG(CAST(release_speed AS DOUBLE))', 2)} AS avg_velo,
  {r('STDDEV_SAMP(CAST(release_speed AS DOUBLE))', 2)} AS velo_stddev,
  {r('AVG(CAST(release_spin AS DOUBLE))', 0)} AS avg_spin,
  {r('AVG(ABS(CAST(pfx_x AS DOUBLE)))', 2)} AS avg_h_break,
  {r('AVG(CAST(pfx_z AS DOUBLE))', 2)} AS avg_v_break,
  {over(total("description = 'swinging_strike'"), total(swing))} AS whiff_rate,
  {over(total("description IN ('called_strike','swinging_strike')"), 'COUNT(*)')} AS csw_rate,
  {over(total('zone BETWEEN 1 AND 9'), 'COUNT(*)')} AS zone_rate,
  {over(total(OUTSIDE + ' AND ' + swing), total(OUTSIDE))} AS chase_rate,
  {r(f'AVG(CASE WHEN {BATTED} THEN CAST(estimated_woba AS DOUBLE) END)', 4)} AS avg_xwoba_allowed,
  {r(f'AVG(CASE WHEN {BATTED} THEN CAST(launch_speed AS DOUBLE) END)', 2)} AS avg_exit_velo_allowed,
  {over(total('is_barrel'), total(BATTED))} AS barrel_rate_allowed,
  {r('SUM(CAST(delta_run_exp AS DOUBLE))', 3)} AS total_re_delta"""


step("mix", ["pitches"], """
SELECT pitcher_id, game_pk, game_date, pitch_type, COUNT(*) AS n,
  COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY pitcher_id, game_pk, game_date) AS p
FROM pitches WHERE pitcher_id IS NOT NULL GROUP BY pitcher_id, game_pk, game_date, pitch_type
""")
step("entropy", ["mix"], f"""
SELECT pitcher_id, game_pk, game_date, {r('-SUM(p * ln(p))', 4)} AS stuff_diversity
FROM mix GROUP BY pitcher_id, game_pk, game_date
""")
step("metrics", ["pitches"], f"""
SELECT pitcher_id, game_pk, game_date, {base_columns()},
  MAX(CASE WHEN inning_topbot = 'Top' THEN 1 ELSE 0 END) AS home_away,
  CASE WHEN MAX(CASE WHEN inning_topbot = 'Top' THEN 1 ELSE 0 END) = 1 THEN MAX(home_team) ELSE MAX(away_team) END AS team,
  CASE WHEN MAX(CASE WHEN inning_topbot = 'Top' THEN 1 ELSE 0 END) = 1 THEN MAX(away_team) ELSE MAX(home_team) END AS opponent,
  {over(total("pitch_type IN ('FF','SI')"), 'COUNT(*)')} AS fastball_pct,
  {over(total("CAST(delta_run_exp AS DOUBLE) > 0.1 AND description IN ('called_strike','swinging_strike')"),
        total('CAST(delta_run_exp AS DOUBLE) > 0.1'))} AS high_leverage_csw
FROM pitches WHERE pitcher_id IS NOT NULL GROUP BY pitcher_id, game_pk, game_date
""")
PAST = ("OVER (PARTITION BY pitcher_id ORDER BY game_date "
        "RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)")
WHOLE = "OVER (PARTITION BY pitcher_id)"


def above_past(col: str, digits: int) -> str:
    v = i(col, digits)
    k = f"COUNT({v}) {PAST}"
    return r(f"CAST({k} * {v} - SUM({v}) {PAST} AS DOUBLE) / NULLIF({k}, 0) / {10.0 ** digits}", digits)


TIER = """CASE WHEN csw_rate >= 0.32 THEN 'elite' WHEN csw_rate >= 0.29 THEN 'above_avg'
  WHEN csw_rate >= 0.26 THEN 'average' WHEN csw_rate >= 0.22 THEN 'below_avg' ELSE 'poor' END"""

step("gold", ["metrics", "entropy"], f"""
SELECT m.*, e.stuff_diversity,
  {mean_i('avg_velo', 2, PAST)} AS rolling_30d_avg_velo,
  {mean_i('whiff_rate', 4, PAST)} AS rolling_30d_whiff_rate,
  {mean_i('csw_rate', 4, PAST)} AS rolling_30d_csw_rate,
  {above_past('avg_velo', 2)} AS velo_vs_30d_avg,
  {above_past('whiff_rate', 4)} AS whiff_rate_delta,
  {mean_i('avg_velo', 2, WHOLE)} AS season_avg_velo,
  {mean_i('csw_rate', 4, WHOLE)} AS season_avg_csw,
  {mean_i('whiff_rate', 4, WHOLE)} AS season_avg_whiff,
  {TIER} AS performance_tier
FROM metrics m JOIN entropy e USING (pitcher_id, game_pk, game_date)
""")
step("batters", ["pitches"], f"""
SELECT batter_id, game_pk, game_date, COUNT(*) AS pitches_seen, COUNT(DISTINCT inning) AS innings_appeared,
  {over(total(SWING), 'COUNT(*)')} AS swing_rate,
  {over(total(OUTSIDE + ' AND ' + SWING), total(OUTSIDE))} AS o_swing_rate,
  {r('AVG(CAST(launch_speed AS DOUBLE))', 2)} AS avg_exit_velo,
  {r(f'AVG(CASE WHEN {BATTED} THEN CAST(launch_angle AS DOUBLE) END)', 2)} AS avg_launch_angle,
  {r('AVG(CAST(estimated_woba AS DOUBLE))', 4)} AS avg_xwoba,
  {over(total('is_barrel'), total(BATTED))} AS barrel_rate,
  {over(total('launch_speed >= 95'), total(BATTED))} AS hard_hit_rate,
  {r('SUM(CAST(delta_run_exp AS DOUBLE))', 3)} AS total_re_created
FROM pitches WHERE batter_id IS NOT NULL GROUP BY batter_id, game_pk, game_date
""")
step("games", ["pitches"], """
SELECT game_pk, game_date, home_team, away_team, MAX(post_home_score) AS home_score,
  MAX(post_away_score) AS away_score
FROM pitches GROUP BY game_pk, game_date, home_team, away_team
""")
step("players", ["pitches"], """
SELECT DISTINCT pitcher_id AS player_id, concat('Pitcher #', pitcher_id) AS full_name, p_throws AS hand,
  'SP' AS position FROM pitches WHERE pitcher_id IS NOT NULL
UNION ALL
SELECT DISTINCT batter_id, concat('Batter #', batter_id), stand, 'POS' FROM pitches WHERE batter_id IS NOT NULL
""")

GAME = "pitcher_id, game_pk, game_date"
BASE = ("total_pitches, avg_velo, velo_stddev, avg_spin, avg_h_break, avg_v_break, whiff_rate, csw_rate, "
        "zone_rate, chase_rate, avg_xwoba_allowed, avg_exit_velo_allowed, barrel_rate_allowed, total_re_delta, "
        "stuff_diversity")
CONTEXT = ("rolling_30d_avg_velo, rolling_30d_whiff_rate, rolling_30d_csw_rate, velo_vs_30d_avg, "
           "whiff_rate_delta, season_avg_velo, season_avg_csw, season_avg_whiff")
PITCH_COLUMNS = "pitch_id, game_pk, game_date, " + ", ".join(ORDER_COLUMNS)

ORACLES: dict[str, str] = {}


def oracle(name: str, needs: list[str], body: str) -> None:
    ORACLES[name] = statement(needs, body)




def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pct(expr: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f%%', {r(f'({expr}) * 100.0', digits)})"


def fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {r(expr, digits)})"


def signed(expr: str, digits: int) -> str:
    return f"printf('%+.{digits}f', {r(expr, digits)})"


def z(col: str) -> str:
    return f"COALESCE({col}, 0.0)"


def dash(expr: str, col: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN '—' ELSE {expr} END"


# --- landing and typing ------------------------------------------------------

_FEED_ORDER = ", ".join(f"{c} NULLS FIRST" for c in [
    "inning", "inning_topbot", "pitcher_id", "batter_id", "pitch_type", "release_speed", "release_spin",
    "pfx_x", "pfx_z", "plate_x", "plate_z", "zone", "description", "events", "stand", "p_throws", "balls",
    "strikes", "outs_when_up", "launch_speed", "launch_angle", "estimated_ba", "estimated_woba",
    "delta_run_exp", "is_barrel", "home_team", "away_team", "post_home_score", "post_away_score"])
_WIDE_IDS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in ("pitcher_id", "batter_id") else c for c in ORDER_COLUMNS)
_KEYED = f"""
SELECT concat_ws('_', CAST(game_pk AS VARCHAR), CAST(game_date AS VARCHAR), CAST(
    row_number() OVER (PARTITION BY game_pk, game_date ORDER BY {_FEED_ORDER}) - 1 AS VARCHAR)) AS pitch_id,
  game_pk, game_date, {_WIDE_IDS}
FROM feed"""
oracle("bronze_ingest", ["feed"],
       _KEYED + " WHERE game_date BETWEEN DATE '2024-04-01' AND DATE '2024-09-30'")
oracle("pitch_key", ["feed"], _KEYED)
oracle("incremental_days", ["feed"], f"SELECT pitch_id, game_pk, game_date, {_WIDE_IDS} FROM feed WHERE game_date > DATE '2024-06-30'")
oracle("pitches_clean", ["pitches"], f"SELECT {PITCH_COLUMNS} FROM pitches")
oracle("games", ["games"], "SELECT * FROM games")
oracle("players", ["players"], "SELECT * FROM players")
oracle("games_on_date", ["pitches"],
       "SELECT DISTINCT game_date, game_pk FROM pitches WHERE pitcher_id IS NOT NULL")
oracle("row_counts", ["pitches", "games", "players", "gold", "batters"], """
SELECT 'pitches' AS table_name, COUNT(*) AS row_count FROM pitches
UNION ALL SELECT 'games', COUNT(*) FROM games
UNION ALL SELECT 'players', COUNT(*) FROM players
UNION ALL SELECT 'pitcher_game_summary', COUNT(*) FROM gold
UNION ALL SELECT 'batter_game_summary', COUNT(*) FROM batters
""")

step("pitcher_names", ["players"], """
SELECT player_id, MIN(full_name) AS pitcher_name, MIN(hand) AS hand FROM players WHERE position = 'SP'
GROUP BY player_id
""")
step("batter_names", ["players"], """
SELECT player_id, MIN(full_name) AS batter_name FROM players WHERE position = 'POS' GROUP BY player_id
""")
step("named", ["gold", "pitcher_names"], """
SELECT g.*, p.pitcher_name, p.hand FROM gold g LEFT JOIN pitcher_names p ON p.player_id = g.pitcher_id
""")
step("named_batters", ["batters", "batter_names"], """
SELECT b.*, n.batter_name FROM batters b LEFT JOIN batter_names n ON n.player_id = b.batter_id
""")
oracle("players_roster", ["named", "batter_names", "pitches"], """
SELECT pitcher_id AS player_id, pitcher_name AS full_name, MIN(team) AS team, 'SP' AS position, MIN(hand) AS hand
FROM named GROUP BY pitcher_id, pitcher_name
UNION ALL
SELECT p.batter_id, n.batter_name, MIN(CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END),
  'OF/1B', 'R'
FROM pitches p JOIN batter_names n ON n.player_id = p.batter_id GROUP BY p.batter_id, n.batter_name
""")

# --- summaries and windows ---------------------------------------------------

oracle("pitcher_game_summary", ["gold"], f"SELECT {GAME}, {BASE}, {CONTEXT}, performance_tier FROM gold")
oracle("gold_scan", ["gold"], f"SELECT {GAME}, {BASE}, {CONTEXT}, performance_tier FROM gold")
oracle("date_range", ["gold"], f"""
SELECT {GAME}, {BASE} FROM gold WHERE game_date BETWEEN DATE '2024-05-01' AND DATE '2024-08-31'
""")
ALL_SWINGS = ("(description LIKE 'swinging_strike%' OR description LIKE 'foul%' "
              "OR description LIKE 'hit_into_play%' OR description = 'missed_bunt')")
oracle("pitcher_game_all_swings", ["pitches", "entropy"], f"""
SELECT m.*, e.stuff_diversity FROM (
  SELECT pitcher_id, game_pk, game_date, {base_columns(ALL_SWINGS)}
  FROM pitches WHERE pitcher_id IS NOT NULL GROUP BY pitcher_id, game_pk, game_date) m
JOIN entropy e USING (pitcher_id, game_pk, game_date)
""")
oracle("pitcher_game_fanout", ["pitches"], f"""
SELECT pitcher_id, game_pk, game_date, {base_columns()},
  {r('-SUM(share * ln(NULLIF(share, 0)))', 4)} AS stuff_diversity
FROM pitches JOIN (
  SELECT pitcher_id AS mix_pitcher, game_pk AS mix_game,
    COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY pitcher_id, game_pk) AS share
  FROM pitches GROUP BY pitcher_id, game_pk, pitch_type) x
  ON x.mix_pitcher = pitcher_id AND x.mix_game = game_pk
WHERE pitcher_id IS NOT NULL
GROUP BY pitcher_id, game_pk, game_date
""")
oracle("batter_game_summary", ["batters"], "SELECT * FROM batters")
oracle("pitch_mix", ["mix"], f"SELECT {GAME}, pitch_type, n, {r('p', 4)} AS share FROM mix")
oracle("rolling_30d", ["gold"], f"SELECT {GAME}, {', '.join(CONTEXT.split(', ')[:5])} FROM gold")
oracle("season_averages", ["gold"], f"SELECT {GAME}, {', '.join(CONTEXT.split(', ')[5:])} FROM gold")
YEARLY = "OVER (PARTITION BY pitcher_id, year(game_date))"
oracle("season_averages_by_year", ["metrics"], f"""
SELECT {GAME}, {mean_i('avg_velo', 2, YEARLY)} AS season_avg_velo,
  {mean_i('csw_rate', 4, YEARLY)} AS season_avg_csw, {mean_i('whiff_rate', 4, YEARLY)} AS season_avg_whiff
FROM metrics
""")


def last_7(col: str) -> str:
    w = "OVER (PARTITION BY batter_id ORDER BY game_date, game_pk ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({col}) {w} >= 2 THEN {mean_i(col, 4, w)} END AS {col}_7g"


oracle("rolling_7_games", ["batters"], f"""
SELECT batter_id, game_pk, game_date, avg_xwoba, barrel_rate, {last_7('avg_xwoba')}, {last_7('barrel_rate')}
FROM batters
""")


def prior_6(col: str, baseline: str, digits: int) -> str:
    w = "OVER (PARTITION BY pitcher_id ORDER BY game_date, game_pk ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
    v = i(col, digits)
    total_ = f"COALESCE(SUM({v}) {w}, 0) + (6 - COUNT({v}) {w}) * {i(baseline, digits)}"
    return r(f"CAST({total_} AS DOUBLE) / 6 / {10.0 ** digits}", digits) + f" AS prior_6_{col}"


oracle("rolling_6_starts", ["gold"], f"""
SELECT {GAME}, avg_velo, csw_rate, whiff_rate, season_avg_velo, season_avg_csw, season_avg_whiff,
  {prior_6('avg_velo', 'season_avg_velo', 2)}, {prior_6('csw_rate', 'season_avg_csw', 4)},
  {prior_6('whiff_rate', 'season_avg_whiff', 4)}
FROM gold
""")
LATEST = "row_number() OVER (PARTITION BY pitcher_id ORDER BY game_date DESC, game_pk DESC)"
oracle("last_n_per_player", ["named"],
       f"SELECT {GAME}, pitcher_name, csw_rate, performance_tier FROM named QUALIFY {LATEST} <= 2")
oracle("latest_row", ["named"],
       f"SELECT {GAME}, pitcher_name, team, opponent, performance_tier FROM named QUALIFY {LATEST} = 1")
oracle("home_away", ["metrics"], f"SELECT {GAME}, home_away, team, opponent FROM metrics")

# --- joins and filters -------------------------------------------------------

oracle("summary_with_player", ["named"], f"SELECT {GAME}, pitcher_name, hand, csw_rate FROM named")
oracle("summary_with_game", ["gold", "games"], """
SELECT g.pitcher_id, g.game_pk, g.game_date, csw_rate, home_team, away_team, home_score, away_score, home_away,
  CASE WHEN home_away = 1 THEN away_team ELSE home_team END AS opponent
FROM gold g LEFT JOIN games x ON x.game_pk = g.game_pk AND x.game_date = g.game_date
""")
oracle("game_rows", ["named"], f"""
SELECT {GAME}, pitcher_name, opponent, csw_rate, row_number() OVER (
  PARTITION BY game_pk, game_date ORDER BY csw_rate DESC NULLS LAST, pitcher_id) AS csw_place
FROM named
""")
oracle("entity_rows", ["named"], f"SELECT pitcher_name, {GAME}, csw_rate, whiff_rate, avg_velo FROM named")
oracle("explorer_points", ["named"], """
SELECT pitcher_name, game_date, game_pk, opponent, zone_rate, chase_rate, csw_rate, total_pitches,
  avg_xwoba_allowed, performance_tier FROM named
""")
oracle("top_pitcher_trend", ["named"], f"""
SELECT pitcher_name, game_date, game_pk, csw_rate FROM named WHERE pitcher_name IN (
  SELECT pitcher_name FROM named GROUP BY pitcher_name
  ORDER BY {mean_i('csw_rate', 4, '')} DESC NULLS LAST, pitcher_name LIMIT 6)
""")

# --- exploration -------------------------------------------------------------

oracle("overview_kpis", ["gold"], f"""
SELECT COUNT(DISTINCT game_pk) AS total_games,
  {over(total("performance_tier = 'elite'"), 'COUNT(*)')} AS elite_share,
  {mean_i('csw_rate', 4, '')} AS avg_csw, {mean_i('avg_xwoba_allowed', 4, '')} AS avg_xwoba,
  {mean_i('avg_velo', 2, '')} AS avg_velo
FROM gold
""")
_TIER_ROWS = ", ".join(f"({n}, '{t}')" for n, t in enumerate(K.TIERS))
oracle("tier_distribution", ["gold"], f"""
SELECT t.tier_order, t.performance_tier, COUNT(g.pitcher_id) AS starts
FROM (VALUES {_TIER_ROWS}) t(tier_order, performance_tier) LEFT JOIN gold g USING (performance_tier)
GROUP BY t.tier_order, t.performance_tier
""")
step("board", ["named"], f"""
SELECT a.*, m.best_tier FROM (
  SELECT pitcher_id, pitcher_name, team, COUNT(DISTINCT game_pk) AS starts,
    {mean_i('csw_rate', 4, '')} AS avg_csw, {mean_i('whiff_rate', 4, '')} AS avg_whiff,
    {mean_i('avg_velo', 2, '')} AS avg_velo, {mean_i('avg_xwoba_allowed', 4, '')} AS avg_xwoba
  FROM named GROUP BY pitcher_id, pitcher_name, team) a
JOIN (
  SELECT pitcher_id, team, performance_tier AS best_tier FROM named GROUP BY pitcher_id, team, performance_tier
  QUALIFY row_number() OVER (PARTITION BY pitcher_id, team ORDER BY COUNT(*) DESC, performance_tier) = 1) m
USING (pitcher_id, team)
ORDER BY avg_csw DESC NULLS LAST, pitcher_id, pitcher_name, team LIMIT 10
""")
oracle("leaderboard", ["board"], "SELECT * FROM board")
oracle("display_names", ["board"], f"""
SELECT pitcher_name AS "Pitcher", team AS "Team", starts AS "GS", {dash(pct('avg_csw'), 'avg_csw')} AS "CSW%",
  {dash(pct('avg_whiff'), 'avg_whiff')} AS "Whiff%", {dash(fixed('avg_velo', 1), 'avg_velo')} AS "Velo",
  {dash(fixed('avg_xwoba', 3), 'avg_xwoba')} AS "xwOBA", replace(best_tier, '_', ' ') AS "Top Tier"
FROM board
""")


def sum_i(col: str, digits: int) -> str:
    return f"CAST(SUM({i(col, digits)}) AS DOUBLE) / {10.0 ** digits}"


oracle("pitcher_card", ["named"], f"""
SELECT pitcher_id, pitcher_name, COUNT(*) AS starts, {mean_i('csw_rate', 4, '')} AS avg_csw,
  {mean_i('whiff_rate', 4, '')} AS avg_whiff, {mean_i('avg_velo', 2, '')} AS avg_velo,
  {mean_i('avg_xwoba_allowed', 4, '')} AS avg_xwoba, {sum_i('total_re_delta', 3)} AS re_delta
FROM named GROUP BY pitcher_id, pitcher_name
""")
oracle("batter_card", ["named_batters"], f"""
SELECT batter_id, batter_name, {mean_i('avg_exit_velo', 2, '')} AS avg_exit_velo,
  {mean_i('avg_xwoba', 4, '')} AS avg_xwoba, {mean_i('barrel_rate', 4, '')} AS barrel_rate,
  {mean_i('hard_hit_rate', 4, '')} AS hard_hit_rate, {mean_i('o_swing_rate', 4, '')} AS o_swing_rate
FROM named_batters GROUP BY batter_id, batter_name
""")
oracle("pitcher_tiers", ["named"], """
SELECT pitcher_id, pitcher_name, performance_tier, COUNT(*) AS starts FROM named
GROUP BY pitcher_id, pitcher_name, performance_tier
""")
_NULL = "CAST(NULL AS DOUBLE)"


def matrix_row(stat: str, csw: str = _NULL, whiff: str = _NULL, velo: str = _NULL, barrel: str = _NULL,
               xwoba: str = _NULL, run: str = _NULL) -> str:
    return (f"SELECT pitcher_id, pitcher_name, '{stat}' AS stat, {csw} AS csw_rate, {whiff} AS whiff_rate, "
            f"{velo} AS avg_velo, {barrel} AS barrel_rate_allowed, {xwoba} AS avg_xwoba_allowed, "
            f"{run} AS total_re_delta FROM named GROUP BY pitcher_id, pitcher_name")


step("matrix", ["named"], " UNION ALL ".join([
    matrix_row("mean", mean_i("csw_rate", 4, ""), mean_i("whiff_rate", 4, ""), mean_i("avg_velo", 2, "", 4),
               mean_i("barrel_rate_allowed", 4, ""), mean_i("avg_xwoba_allowed", 4, "")),
    matrix_row("max", "MAX(csw_rate)", "MAX(whiff_rate)", "MAX(avg_velo)"),
    matrix_row("min", "MIN(csw_rate)", velo="MIN(avg_velo)"),
    matrix_row("std", r("STDDEV_SAMP(csw_rate)", 4)),
    matrix_row("sum", run=sum_i("total_re_delta", 3)),
]))
oracle("season_matrix", ["matrix"], "SELECT * FROM matrix")
oracle("display_matrix", ["matrix"], f"""
SELECT pitcher_id, stat AS "Stat", {dash(pct('csw_rate'), 'csw_rate')} AS "CSW%",
  {dash(pct('whiff_rate'), 'whiff_rate')} AS "Whiff%", {dash(fixed('avg_velo', 1), 'avg_velo')} AS "Velo",
  {dash(pct('barrel_rate_allowed'), 'barrel_rate_allowed')} AS "Barrel%",
  {dash(fixed('avg_xwoba_allowed', 3), 'avg_xwoba_allowed')} AS "xwOBA",
  {dash(signed('total_re_delta', 3), 'total_re_delta')} AS "RE Delta"
FROM matrix
""")
oracle("exit_velo_histogram", ["batters"], f"""
WITH known AS (SELECT avg_exit_velo AS v FROM batters WHERE avg_exit_velo IS NOT NULL),
ends AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM known),
placed AS (SELECT CAST(LEAST(COALESCE(floor((v - lo) / NULLIF(hi - lo, 0) * 25.0), 0), 24) AS BIGINT) AS bin
  FROM known, ends)
SELECT b.bin, COUNT(p.bin) AS games, {r('MIN(lo + (hi - lo) * b.bin / 25.0)', 4)} AS bin_start,
  MIN(lo + (hi - lo) * b.bin / 25.0) >= 95 AS hard_hit
FROM (SELECT unnest(range(25)) AS bin) b CROSS JOIN ends LEFT JOIN placed p ON p.bin = b.bin GROUP BY b.bin
""".replace("WITH known", "SELECT * FROM (WITH known", 1).rstrip() + ")")
oracle("date_bounds", ["gold"], "SELECT MIN(game_date) AS min_date, MAX(game_date) AS max_date FROM gold")
oracle("name_list", ["named"], "SELECT DISTINCT pitcher_name FROM named")
oracle("date_list", ["named"], "SELECT DISTINCT pitcher_name, game_date FROM named")
oracle("recent_form", ["named"], f"""
SELECT pitcher_id, pitcher_name, game_date, game_pk, csw_rate, performance_tier, CAST({LATEST} AS INTEGER) AS starts_ago,
  {LATEST} = 1 AS selected
FROM named QUALIFY {LATEST} <= 8
""")
oracle("trend_series", ["named"], """
SELECT pitcher_name, game_date, game_pk, csw_rate, avg_velo, rolling_30d_avg_velo, whiff_rate,
  rolling_30d_whiff_rate, performance_tier, CAST(0.281 AS DOUBLE) AS league_csw, CAST(0.254 AS DOUBLE) AS league_whiff
FROM named
""")

# --- rules -------------------------------------------------------------------

oracle("performance_tier", ["gold"], f"SELECT {GAME}, csw_rate, {TIER} AS tier FROM gold")
GRADE = """CASE WHEN {c} >= 0.33 THEN 'A+' WHEN {c} >= 0.31 THEN 'A' WHEN {c} >= 0.29 THEN 'B+' WHEN {c} >= 0.27 THEN 'B'
  WHEN {c} >= 0.25 THEN 'C+' WHEN {c} >= 0.23 THEN 'C' ELSE 'D' END"""
PERCENTILE = """CASE WHEN {c} >= 0.35 THEN 99 WHEN {c} >= 0.33 THEN 95 WHEN {c} >= 0.31 THEN 85 WHEN {c} >= 0.29 THEN 70
  WHEN {c} >= 0.27 THEN 55 WHEN {c} >= 0.25 THEN 40 WHEN {c} >= 0.23 THEN 25 WHEN {c} >= 0.20 THEN 10 ELSE 5 END"""
oracle("letter_grade", ["gold"], f"SELECT {GAME}, csw_rate, {GRADE.format(c='csw_rate')} AS grade FROM gold")
oracle("csw_percentile", ["gold"],
       f"SELECT {GAME}, csw_rate, {PERCENTILE.format(c='csw_rate')} AS percentile FROM gold")
oracle("stuff_score", ["gold"], f"""
SELECT {GAME}, csw_rate, CAST(floor(LEAST(GREATEST((csw_rate - CAST(0.18 AS DOUBLE)) / CAST(0.20 AS DOUBLE) * 100.0, 0.0), 100.0)) AS INTEGER)
  AS stuff_score FROM gold
""")


def metric_row(name: str, higher: bool, elite: float, above: float, average: float) -> str:
    op = ">=" if higher else "<="
    return (f"SELECT {GAME}, '{name}' AS metric, {name} AS value, CASE WHEN {name} IS NULL THEN NULL "
            f"WHEN {name} {op} {elite} THEN 'elite' WHEN {name} {op} {above} THEN 'above_avg' "
            f"WHEN {name} {op} {average} THEN 'average' ELSE 'below_avg' END AS tier FROM gold")


oracle("metric_tiers", ["gold"], " UNION ALL ".join(metric_row(*m) for m in K.METRIC_TIERS))
_LEAGUE = {"csw_rate": 0.281, "whiff_rate": 0.254, "zone_rate": 0.475, "chase_rate": 0.295,
           "barrel_rate_allowed": 0.078, "avg_xwoba_allowed": 0.312, "avg_exit_velo_allowed": 88.5}
oracle("vs_league", ["gold"], f"""
SELECT {GAME}, {", ".join(_LEAGUE)},
  {", ".join(f"{r(f'{c} - CAST({v} AS DOUBLE)', 4)} AS {c}_vs_league" for c, v in _LEAGUE.items())},
  COALESCE(whiff_rate >= 0.32, FALSE) AS whiff_star, COALESCE(csw_rate >= 0.31, FALSE) AS csw_star
FROM gold
""")
oracle("player_first_name", ["players"], """
SELECT player_id, position, hand, split_part(full_name, ' ', 1) AS first_name, upper(full_name) AS upper_name
FROM players
""")

# --- anomalies and enrichment ------------------------------------------------

SHOWN = (f"{GAME}, pitcher_name, whiff_rate, rolling_30d_whiff_rate, csw_rate, rolling_30d_csw_rate, avg_velo, "
         "rolling_30d_avg_velo, velo_vs_30d_avg")
step("outliers", ["named"], f"""
SELECT *, whiff_rate - rolling_30d_whiff_rate AS gap,
  STDDEV_SAMP(whiff_rate) OVER (PARTITION BY pitcher_id, game_date) AS day_std,
  row_number() OVER (PARTITION BY game_date
    ORDER BY ABS(whiff_rate - rolling_30d_whiff_rate) DESC, pitcher_id, game_pk) AS place
FROM named WHERE ABS(whiff_rate - rolling_30d_whiff_rate) > 0.08 AND total_pitches >= 40
""")
step("top_outliers", ["outliers"], f"""
SELECT {SHOWN}, {r('gap', 4)} AS whiff_delta, {r('gap / NULLIF(day_std, 0)', 4)} AS whiff_z, CAST(place AS INTEGER) AS place
FROM outliers WHERE place <= 5
""")
oracle("anomaly_literal", ["top_outliers"], "SELECT * FROM top_outliers")
_W = i("whiff_rate", 4)
_K = f"CAST(COUNT({_W}) {PAST} AS DOUBLE)"
_S = f"CAST(SUM({_W}) {PAST} AS DOUBLE)"
_Q = f"CAST(SUM({_W} * {_W}) {PAST} AS DOUBLE)"
step("spread", ["named"], f"""
SELECT *, CASE WHEN {_K} >= 2 THEN sqrt(({_K} * {_Q} - {_S} * {_S}) / ({_K} * ({_K} - 1))) / 10000.0 END AS sd
FROM named
""")
oracle("anomaly_z", ["spread"], f"""
SELECT {SHOWN}, whiff_rate_delta, {r('whiff_rate_delta / NULLIF(sd, 0)', 4)} AS whiff_z FROM spread
WHERE total_pitches >= 40 AND ABS({r('whiff_rate_delta / NULLIF(sd, 0)', 4)}) > 2.0
""")
LABEL = "COALESCE(pitcher_name, concat('Pitcher #', pitcher_id))"
oracle("pitcher_prompt", ["named"], f"""
SELECT {GAME}, printf({q(text.PITCHER_PROMPT)}, {LABEL}, CAST(game_date AS VARCHAR), COALESCE(opponent, 'Unknown'),
  CAST(total_pitches AS VARCHAR), {fixed(z('avg_velo'), 1)}, {fixed(z('season_avg_velo'), 1)},
  {signed(z('velo_vs_30d_avg'), 1)}, {pct(z('whiff_rate'))}, {pct(z('csw_rate'))}, {pct(z('zone_rate'))},
  {pct(z('chase_rate'))}, {fixed(z('avg_xwoba_allowed'), 3)}, {pct(z('barrel_rate_allowed'))},
  {fixed(z('stuff_diversity'), 3)}, {signed(z('total_re_delta'), 2)}) AS prompt
FROM named
""")
oracle("anomaly_prompt", ["top_outliers"], f"""
SELECT game_date, COUNT(*) AS anomalies, printf({q(text.ANOMALY_PROMPT)}, string_agg(
  printf({q(text.ANOMALY_LINE)}, {LABEL}, {pct('whiff_rate')}, {pct('rolling_30d_whiff_rate')},
  {signed(z('velo_vs_30d_avg'), 1)}), chr(10) ORDER BY place)) AS prompt
FROM top_outliers GROUP BY game_date
""")
step("best_pitchers", ["named"], f"""
SELECT game_pk, game_date, string_agg(concat('- ', pitcher_name, ' CSW ', {pct(z('csw_rate'))}), chr(10) ORDER BY rn)
  AS pitcher_table
FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, game_date ORDER BY csw_rate DESC NULLS LAST, pitcher_id) AS rn
  FROM named) WHERE rn <= 3 GROUP BY game_pk, game_date
""")
step("best_batters", ["named_batters"], f"""
SELECT game_pk, game_date, string_agg(concat('- ', batter_name, ' xwOBA ', {fixed(z('avg_xwoba'), 3)}), chr(10) ORDER BY rn)
  AS batter_table
FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, game_date ORDER BY avg_xwoba DESC NULLS LAST, batter_id) AS rn
  FROM named_batters) WHERE rn <= 3 GROUP BY game_pk, game_date
""")
oracle("game_brief_inputs", ["games", "best_pitchers", "best_batters"], f"""
SELECT g.*, pitcher_table, batter_table, printf({q(text.GAME_PROMPT)}, home_team, away_team,
  CAST(game_date AS VARCHAR), CAST(home_score AS VARCHAR), CAST(away_score AS VARCHAR),
  COALESCE(pitcher_table, ''), COALESCE(batter_table, '')) AS prompt
FROM games g LEFT JOIN best_pitchers USING (game_pk, game_date) LEFT JOIN best_batters USING (game_pk, game_date)
""")


def filled(template: str) -> str:
    expr = template
    for name, value in {
        "name": f"split_part({LABEL}, ' ', 1)", "whiff": pct(z("whiff_rate"), 0), "csw": pct(z("csw_rate"), 0),
        "velo": fixed(z("avg_velo"), 0), "vdelta": fixed(f"ABS({z('velo_vs_30d_avg')})", 1),
        "zone": pct(z("zone_rate"), 0), "xwoba": fixed(z("avg_xwoba_allowed"), 3),
        "barrel": pct(z("barrel_rate_allowed"), 0), "div": fixed(z("stuff_diversity"), 2),
    }.items():
        expr = f"replace({expr}, '{{{name}}}', {value})"
    return expr


_NARRATIVE_ROWS = ", ".join(
    f"({q(t)}, {q(h)}, {q(f)}, {q(c) if c else 'CAST(NULL AS VARCHAR)'})" for t, h, f, c in text.NARRATIVES)
step("mix_profile", ["mix"], """
SELECT pitcher_id, game_pk, game_date,
  CAST(SUM(CASE WHEN pitch_type IN ('FF','SI') THEN n ELSE 0 END) AS DOUBLE) / SUM(n) AS fastball_share,
  (list(pitch_type ORDER BY n DESC, pitch_type) FILTER (WHERE pitch_type IN ('SL','CU','CH')))[1] AS top_offspeed
FROM mix GROUP BY pitcher_id, game_pk, game_date
""")
step("narratives", ["named", "mix_profile"], f"""
SELECT {GAME}, pitcher_name, performance_tier, {filled('t.headline')} AS headline,
  {filled('t.key_finding')} AS key_finding, t.concern_flag,
  CASE WHEN performance_tier IN ('elite', 'above_avg') AND top_offspeed IS NOT NULL THEN
    printf({q(text.MIX_NOTE)}, {fixed('fastball_share * 100', 0)},
      CASE top_offspeed WHEN 'SL' THEN 'slider' WHEN 'CU' THEN 'curveball' ELSE 'changeup' END) END AS pitch_mix_note
FROM named JOIN mix_profile USING (pitcher_id, game_pk, game_date)
LEFT JOIN (VALUES {_NARRATIVE_ROWS}) t(tier, headline, key_finding, concern_flag) ON t.tier = performance_tier
""")
oracle("template_narrative", ["narratives"], "SELECT * FROM narratives")
oracle("insights_scan", ["narratives"], """
SELECT CAST(pitcher_id AS BIGINT) AS pitcher_id, pitcher_name, CAST(game_pk AS BIGINT) AS game_pk, game_date,
  performance_tier, headline, key_finding, concern_flag, pitch_mix_note FROM narratives
""")
INSIGHT_JSON = """CAST(json_object('performance_tier', performance_tier, 'headline', headline, 'key_finding', key_finding,
  'concern_flag', concern_flag, 'pitch_mix_note', pitch_mix_note) AS VARCHAR)"""
step("insights", ["narratives"], f"""
SELECT {GAME}, 'pitcher_game' AS insight_type, {INSIGHT_JSON} AS insight_json,
  '2024-10-01T00:00:00+00:00' AS generated_at FROM narratives
""")
oracle("insight_rows", ["insights"], "SELECT * FROM insights")
oracle("parse_response", ["narratives"], f"""
SELECT {GAME},
  CASE WHEN good THEN performance_tier END AS performance_tier, CASE WHEN good THEN headline END AS headline,
  CASE WHEN good THEN key_finding END AS key_finding, CASE WHEN good THEN concern_flag END AS concern_flag,
  CASE WHEN good THEN pitch_mix_note END AS pitch_mix_note,
  CASE WHEN NOT good THEN 'json_parse_failed' END AS error,
  CASE WHEN NOT good THEN concat('Here is my analysis: ', headline) END AS raw
FROM (SELECT *, performance_tier <> 'average' AS good FROM narratives)
""")
oracle("insight_upsert", ["narratives", "insights"], f"""
SELECT * FROM insights ANTI JOIN (SELECT {GAME} FROM narratives QUALIFY {LATEST} = 1) USING (pitcher_id, game_pk, game_date)
UNION ALL
SELECT {GAME}, 'pitcher_game', {INSIGHT_JSON.replace("'concern_flag', concern_flag", "'concern_flag', 'Reviewed.'")},
  '2024-10-02T00:00:00+00:00'
FROM narratives QUALIFY {LATEST} = 1
""")
step("recent_insights", ["narratives"], f"SELECT * FROM narratives QUALIFY {LATEST} <= 2")
_INSIGHT_TEXTS = """
  CASE WHEN x.pitcher_id IS NULL THEN 'Insight generation pending.' ELSE x.headline END AS headline,
  CASE WHEN x.pitcher_id IS NULL THEN 'Run enrichment pipeline to generate AI narrative.' ELSE x.key_finding END AS key_finding,
  x.concern_flag, x.pitch_mix_note"""
oracle("report_insight", ["named", "recent_insights"], f"""
SELECT n.pitcher_id, n.game_pk, n.game_date, n.pitcher_name, {_INSIGHT_TEXTS}
FROM named n LEFT JOIN recent_insights x ON x.pitcher_id = n.pitcher_id AND x.game_date = n.game_date
""")

# --- model inputs ------------------------------------------------------------

FEATURES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*K.FEATURES, K.TARGET])
HISTORY = ("rolling_30d_csw_rate IS NOT NULL AND rolling_30d_whiff_rate IS NOT NULL "
           "AND rolling_30d_avg_velo IS NOT NULL AND csw_rate IS NOT NULL")
step("training", ["gold"], f"SELECT {GAME}, {FEATURES} FROM gold WHERE {HISTORY}")
oracle("training_rows", ["training"], "SELECT * FROM training")
_LAGGED = ["avg_spin", "avg_h_break", "avg_v_break", "stuff_diversity", "zone_rate", "chase_rate",
           "barrel_rate_allowed", "avg_xwoba_allowed", "total_pitches", "velo_vs_30d_avg", "whiff_rate_delta"]
oracle("lagged_features", ["gold"], f"""
SELECT {GAME}, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*K.FEATURES, K.TARGET])} FROM (
  SELECT * REPLACE ({", ".join(f"lag({c}) OVER (PARTITION BY pitcher_id ORDER BY game_date, game_pk) AS {c}" for c in _LAGGED)})
  FROM gold) WHERE {HISTORY}
""")
oracle("feature_medians", ["training"],
       "SELECT " + ", ".join(f"{r(f'median({c})', 6)} AS {c}" for c in K.FEATURES) + " FROM training")
oracle("feature_matrix", ["training"], f"""
SELECT {GAME}, {", ".join(f"COALESCE({c}, (SELECT {r(f'median({c})', 6)} FROM training)) AS {c}" for c in K.FEATURES)},
  csw_rate FROM training
""")
step("numbered", ["training"], """
SELECT *, row_number() OVER (ORDER BY game_date, pitcher_id, game_pk) - 1 AS row_idx, COUNT(*) OVER () AS n FROM training
""")
step("folded", ["numbered"], """
SELECT *, CAST(CASE WHEN row_idx >= n - 5 * (n // 6) THEN (row_idx - (n - 5 * (n // 6))) // greatest(n // 6, 1) + 1 ELSE 0 END
  AS INTEGER) AS val_fold FROM numbered
""")
oracle("time_series_folds", ["folded"], f"SELECT {GAME}, csw_rate, row_idx, val_fold FROM folded")
oracle("time_series_folds_by_date", ["training"], f"""
SELECT {GAME}, csw_rate, CAST(CASE WHEN d - 1 >= n - 5 * (n // 6) THEN (d - 1 - (n - 5 * (n // 6))) // greatest(n // 6, 1) + 1
  ELSE 0 END AS INTEGER) AS val_fold
FROM (SELECT *, dense_rank() OVER (ORDER BY game_date) AS d, (SELECT COUNT(DISTINCT game_date) FROM training) AS n
  FROM training)
""")
oracle("fold_ranges", ["folded"], """
SELECT v.fold, (SELECT COUNT(*) FROM folded f WHERE f.val_fold < v.fold) AS n_train, v.n_val, v.val_start, v.val_end
FROM (SELECT val_fold AS fold, COUNT(*) AS n_val, MIN(game_date) AS val_start, MAX(game_date) AS val_end
  FROM folded WHERE val_fold > 0 GROUP BY val_fold) v
""")

# --- reports and quality -----------------------------------------------------

_REPORT_FEATURES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in K.FEATURES)
oracle("attribution_sums", ["gold"], f"SELECT {GAME}, 0.0 AS residue FROM gold")
oracle("report_predictions", ["gold"], f"SELECT {GAME}, TRUE AS agrees FROM gold")
oracle("training_size", ["training"], f"""
SELECT COUNT(*) AS n_training_rows, MIN(game_date) AS first_date, MAX(game_date) AS last_date, CAST(5 AS INTEGER) AS folds,
  CAST({len(K.FEATURES)} AS INTEGER) AS features, TRUE AS metrics_in_bounds, TRUE AS importance_counts_splits FROM training
""")
oracle("report_features", ["gold"], f"SELECT {GAME}, {_REPORT_FEATURES} FROM gold")
step("report_rows", ["named", "recent_insights"], f"""
SELECT n.game_date, n.pitcher_id, {LABEL.replace('pitcher_', 'n.pitcher_')} AS pitcher_name, n.game_pk,
  COALESCE(opponent, 'Unknown') AS opponent, total_pitches, {r('avg_velo', 1)} AS avg_velo,
  {r('season_avg_velo', 1)} AS season_avg_velo, {r(z('velo_vs_30d_avg'), 1)} AS velo_delta,
  {z('whiff_rate')} AS whiff_rate, {z('csw_rate')} AS csw_rate, {z('zone_rate')} AS zone_rate,
  {z('chase_rate')} AS chase_rate, {z('barrel_rate_allowed')} AS barrel_rate, {z('avg_xwoba_allowed')} AS avg_xwoba,
  {z('stuff_diversity')} AS stuff_diversity, {z('total_re_delta')} AS total_re_delta,
  n.performance_tier, {z('rolling_30d_csw_rate')} AS rolling_30d_csw, {z('rolling_30d_whiff_rate')} AS rolling_30d_whiff,
  {_INSIGHT_TEXTS}, {GRADE.format(c=z('csw_rate'))} AS letter_grade, {PERCENTILE.format(c=z('csw_rate'))} AS percentile
FROM named n LEFT JOIN recent_insights x ON x.pitcher_id = n.pitcher_id AND x.game_date = n.game_date
""")


oracle("report_stats", ["report_rows"], "SELECT * FROM report_rows")
oracle("report_json", ["report_rows"], f"""
SELECT {GAME}, pitcher_name, opponent, letter_grade, percentile, headline, csw_rate, chase_rate, performance_tier FROM report_rows
""")


def checked(name: str, cond: str, table: str) -> str:
    return f"SELECT '{name}' AS \"check\", COUNT(*) FILTER (WHERE {cond}) AS violations FROM {table}"


_KNOWN_TIERS = ", ".join(f"'{t}'" for t in K.TIERS)
oracle("dq_report", ["gold", "batters", "insights"], " UNION ALL ".join([
    checked("pitch_id_present", "l_orderkey IS NULL OR l_linenumber IS NULL", "lineitem"),
    checked("csw_rate_bounds", "csw_rate NOT BETWEEN 0 AND 1", "gold"),
    checked("whiff_rate_bounds", "whiff_rate NOT BETWEEN 0 AND 1", "gold"),
    checked("performance_tier_known", f"COALESCE(performance_tier NOT IN ({_KNOWN_TIERS}), TRUE)", "gold"),
    checked("pitcher_id_present", "pitcher_id IS NULL", "gold"),
    checked("velo_delta_consistent", "ABS(avg_velo - rolling_30d_avg_velo - velo_vs_30d_avg) >= 0.05", "gold"),
    checked("exit_velo_realistic", "avg_exit_velo NOT BETWEEN 60 AND 120", "batters"),
    checked("barrel_rate_bounds", "barrel_rate NOT BETWEEN 0 AND 1", "batters"),
    checked("insight_keys_present",
            "NOT list_has_all(json_keys(insight_json), ['performance_tier','headline','key_finding','concern_flag'])",
            "insights"),
    checked("insight_tier_known",
            f"COALESCE(json_extract_string(insight_json, '$.performance_tier') NOT IN ({_KNOWN_TIERS}), TRUE)", "insights"),
]))

# --- data dictionary extras --------------------------------------------------

oracle("fastball_pct", ["metrics"], f"SELECT {GAME}, fastball_pct FROM metrics")
oracle("high_leverage_csw", ["metrics"], f"SELECT {GAME}, high_leverage_csw FROM metrics")
oracle("velo_vs_season", ["gold"], f"""
SELECT {GAME}, avg_velo, season_avg_velo,
  {r(f"CAST({i('avg_velo', 2)} - {i('season_avg_velo', 2)} AS DOUBLE) / 100.0", 2)} AS velo_vs_season_avg FROM gold
""")
_STARTS = "OVER (PARTITION BY pitcher_id ORDER BY game_date, game_pk)"
oracle("days_rest", ["gold"], f"""
SELECT {GAME}, total_pitches, CAST(date_diff('day', lag(game_date) {_STARTS}, game_date) AS INTEGER) AS days_rest,
  lag(total_pitches) {_STARTS} AS pitch_count_last_game FROM gold
""")
oracle("barrel_rate_allowed_30d", ["metrics"], f"""
SELECT {GAME}, barrel_rate_allowed, {mean_i('barrel_rate_allowed', 4, PAST)} AS barrel_rate_allowed_30d FROM metrics
""")
oracle("opposing_team_k_rate", ["metrics", "pitches"], f"""
SELECT {GAME}, opponent, k.k_rate AS opposing_team_k_rate FROM metrics LEFT JOIN (
  SELECT CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END AS bats,
    {over(total("events = 'strikeout'"), 'COUNT(events)')} AS k_rate
  FROM pitches GROUP BY 1) k ON k.bats = opponent
""")
oracle("team_trends", ["gold"], f"""
SELECT team, game_date, COUNT(*) AS pitchers, {mean_i('csw_rate', 4, '')} AS avg_csw,
  CAST(SUM(total_pitches) AS BIGINT) AS pitches FROM gold GROUP BY team, game_date
""")
oracle("at_bats", ["pitches"], """
SELECT pitch_id, game_pk, game_date, pitcher_id, batter_id, inning, inning_topbot, events, pitch_type, description,
  launch_speed, launch_angle, estimated_woba, delta_run_exp FROM pitches WHERE events IS NOT NULL
""")
oracle("pitch_mix_text", ["mix"], f"""
SELECT {GAME}, string_agg(concat(COALESCE(pitch_type, '??'), ' ', {pct(r('p', 4), 0)}), ' / '
  ORDER BY n DESC, COALESCE(pitch_type, '??')) AS pitch_mix
FROM mix GROUP BY {GAME}
""")
oracle("contact_by_type", ["pitches"], f"""
SELECT batter_id, pitch_type, COUNT(*) AS pitches_seen, {r('AVG(CAST(estimated_woba AS DOUBLE))', 4)} AS avg_xwoba,
  {over(total('is_barrel'), total(BATTED))} AS barrel_rate
FROM pitches WHERE batter_id IS NOT NULL GROUP BY batter_id, pitch_type
""")
oracle("whiff_by_zone", ["pitches"], f"""
SELECT pitcher_id, zone, COUNT(*) AS pitches,
  {over(total("description = 'swinging_strike'"), total(SWING))} AS whiff_rate
FROM pitches WHERE pitcher_id IS NOT NULL GROUP BY pitcher_id, zone
""")

# --- display forms -----------------------------------------------------------

def shown(expr: str, col: str, name: str) -> str:
    return f'{dash(expr, col)} AS "{name}"'


step("kpis", ["gold"], f"""
SELECT COUNT(DISTINCT game_pk) AS total_games, {over(total("performance_tier = 'elite'"), 'COUNT(*)')} AS elite_share,
  {mean_i('csw_rate', 4, '')} AS avg_csw, {mean_i('avg_xwoba_allowed', 4, '')} AS avg_xwoba,
  {mean_i('avg_velo', 2, '')} AS avg_velo FROM gold
""")
oracle("display_overview", ["kpis"], f"""
SELECT format('{{:,}}', total_games) AS "Total Games", {shown(pct('elite_share', 0), 'elite_share', 'Elite Outings')},
  {shown(pct('avg_csw'), 'avg_csw', 'Avg CSW Rate')}, {shown(fixed('avg_xwoba', 3), 'avg_xwoba', 'Avg xwOBA Allowed')},
  {shown(f"concat({fixed('avg_velo', 1)}, ' mph')", 'avg_velo', 'Avg Fastball Velo')}
FROM kpis
""")
step("cards", ["named"], f"""
SELECT pitcher_id, pitcher_name, COUNT(*) AS starts, {mean_i('csw_rate', 4, '')} AS avg_csw,
  {mean_i('whiff_rate', 4, '')} AS avg_whiff, {mean_i('avg_velo', 2, '')} AS avg_velo,
  {mean_i('avg_xwoba_allowed', 4, '')} AS avg_xwoba, {sum_i('total_re_delta', 3)} AS re_delta
FROM named GROUP BY pitcher_id, pitcher_name
""")
oracle("display_pitcher_card", ["cards", "named"], f"""
SELECT c.pitcher_id, c.pitcher_name, CAST(starts AS VARCHAR) AS "GS (filtered)",
  {shown(pct('c.avg_csw'), 'c.avg_csw', 'Avg CSW%')}, {shown(pct('c.avg_whiff'), 'c.avg_whiff', 'Avg Whiff%')},
  {shown(fixed('c.avg_velo', 1), 'c.avg_velo', 'Avg Velo')}, {shown(fixed('c.avg_xwoba', 3), 'c.avg_xwoba', 'xwOBA')},
  {shown(signed('c.re_delta', 1), 'c.re_delta', 'RE Delta')}, l.team, replace(l.performance_tier, '_', ' ') AS "Tier",
  concat('Last start: ', strftime(l.game_date, '%b %d, %Y'), ' vs. ', COALESCE(l.opponent, 'Unknown')) AS "Last start"
FROM cards c JOIN (SELECT * FROM named QUALIFY {LATEST} = 1) l ON l.pitcher_id = c.pitcher_id
""")
step("batter_cards", ["named_batters"], f"""
SELECT batter_id, batter_name, {mean_i('avg_exit_velo', 2, '')} AS ev, {mean_i('avg_xwoba', 4, '')} AS xw,
  {mean_i('barrel_rate', 4, '')} AS br, {mean_i('hard_hit_rate', 4, '')} AS hh, {mean_i('o_swing_rate', 4, '')} AS os
FROM named_batters GROUP BY batter_id, batter_name
""")
oracle("display_batter_card", ["batter_cards"], f"""
SELECT batter_id, batter_name, {shown(f"concat({fixed('ev', 1)}, ' mph')", 'ev', 'Avg Exit Velo')},
  {shown(fixed('xw', 3), 'xw', 'Avg xwOBA')}, {shown(pct('br'), 'br', 'Barrel Rate')},
  {shown(pct('hh'), 'hh', 'Hard Hit%')}, {shown(pct('os'), 'os', 'O-Swing%')}
FROM batter_cards
""")
oracle("display_game", ["named"], f"""
SELECT {GAME}, strftime(game_date, '%B %d, %Y') AS "Game date",
  concat(pitcher_name, ' · ', strftime(game_date, '%b %d, %Y'), ' vs. ', COALESCE(opponent, 'Unknown')) AS "Title",
  CAST(total_pitches AS VARCHAR) AS "Pitches", {shown(pct('csw_rate'), 'csw_rate', 'CSW Rate')},
  {shown(pct('whiff_rate'), 'whiff_rate', 'Whiff Rate')},
  {shown(f"concat({fixed('avg_velo', 1)}, ' mph')", 'avg_velo', 'Avg Velo')},
  {shown(pct('zone_rate'), 'zone_rate', 'Zone Rate')}, {shown(pct('chase_rate'), 'chase_rate', 'Chase Rate')},
  {shown(fixed('avg_xwoba_allowed', 3), 'avg_xwoba_allowed', 'xwOBA')},
  {shown(signed('total_re_delta', 2), 'total_re_delta', 'RE Delta')}
FROM named
""")
oracle("live_prompt", ["named"], f"""
SELECT {GAME}, printf({q(text.LIVE_PROMPT)}, {LABEL}, CAST(game_date AS VARCHAR), COALESCE(opponent, 'Unknown'),
  CAST(total_pitches AS VARCHAR), {fixed(z('avg_velo'), 1)}, {fixed(z('season_avg_velo'), 1)},
  {pct(z('whiff_rate'))}, {pct(z('csw_rate'))}, {pct(z('zone_rate'))}, {pct(z('chase_rate'))},
  {fixed(z('avg_xwoba_allowed'), 3)}, {pct(z('barrel_rate_allowed'))}, {signed(z('total_re_delta'), 2)},
  performance_tier) AS prompt
FROM named
""")
oracle("generate_text", ["named"], f"""
SELECT {GAME}, concat('Report on ', {LABEL}) AS headline, CAST(NULL AS VARCHAR) AS error FROM named
""")

# --- what must hold whatever the fit was (plans/checks.py) --------------------

oracle("table_replace", ["gold"], f"SELECT {GAME}, {BASE}, COALESCE(csw_rate >= 0.3, FALSE) AS was_there FROM gold")
oracle("register_batch", ["gold"], "SELECT pitcher_id, COUNT(*) AS games, MAX(game_date) AS last_date FROM gold GROUP BY pitcher_id")
oracle("loaded_at", ["pitches"], "SELECT pitch_id, TRUE AS after_start, TRUE AS before_now FROM pitches")
oracle("empty_guards", ["named"], """
SELECT 'entity_rows' AS lookup, COUNT(*) AS n FROM named WHERE pitcher_name = 'Nobody #0'
UNION ALL SELECT 'game_rows', COUNT(*) FROM named WHERE game_pk = -1
UNION ALL SELECT 'pitcher_card', COUNT(DISTINCT pitcher_id) FROM named WHERE pitcher_name = 'Nobody #0'
UNION ALL SELECT 'report_without_insights', COUNT(*) FROM named
""")
oracle("generated_at_format", ["narratives"], f"SELECT {GAME}, TRUE AS in_form, TRUE AS recent FROM narratives")
oracle("cv_ranges", ["folded"], """
SELECT v.fold, (SELECT COUNT(*) FROM folded f WHERE f.val_fold < v.fold) AS n_train, v.n_val, v.val_start, v.val_end,
  TRUE AS in_bounds, TRUE AS rounds_in_bounds
FROM (SELECT val_fold AS fold, COUNT(*) AS n_val, MIN(game_date) AS val_start, MAX(game_date) AS val_end
  FROM folded WHERE val_fold > 0 GROUP BY val_fold) v
""")
oracle("tree_shapes", ["gold"], """
SELECT CAST(i AS INTEGER) AS tree, CASE WHEN i = 0 THEN 1.0 ELSE 0.05 END AS weight, TRUE AS binary, TRUE AS bounded FROM range(0, 400) AS x(i)
""")
oracle("score_rules", ["gold"], f"SELECT {GAME}, TRUE AS rate_agrees, TRUE AS score_agrees FROM gold")
oracle("model_round_trip", ["gold"], f"SELECT {GAME}, TRUE AS agrees FROM gold")
oracle("top_features", ["gold"], f"SELECT {GAME}, TRUE AS largest_in_order, TRUE AS own_values, TRUE AS signs_agree FROM gold")
oracle("attribution_means", ["gold"], f"SELECT unnest([{', '.join(repr(f) for f in K.FEATURES)}]) AS feature, TRUE AS agrees")
oracle("importance_counts", ["gold"], "SELECT TRUE AS own_counts, TRUE AS in_order, TRUE AS all_splits")
