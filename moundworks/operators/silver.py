"""Typed, deduplicated pitches and the lookup tables built from them."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.sources.schemas import PITCH_COLUMNS


#: Bits of the map of repeated ids (half a MB, whatever the size of the input).
MAP_BITS = 1 << 22


def repeated_ids(ids: DataFrame, key: str, bits: int = MAP_BITS) -> DataFrame:
    """A bitmap of fixed size over a hash of ``key``, in one row: an array of bits / 64 words
    with the bits of the keys that occur twice or more.

    Only hashes travel: they are counted in full, and those found more than once set
    their bit. Null is a key like any other.
    """
    again = ids.select(F.xxhash64(key).alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1")
    slot = F.pmod("_hash", F.lit(bits))
    set_ = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    every = ids.sparkSession.range(bits // 64).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_set"))
    words = again.select(F.shiftright(slot, 6).alias("_word"), set_.alias("_set")).union(every).groupBy("_word").agg(F.bit_or("_set").alias("_set"))
    ordered = F.sort_array(F.collect_list(F.struct("_word", "_set")))
    return words.agg(F.transform(ordered, lambda w: w["_set"]).alias("_map"))


def typed_pitches(bronze: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each row with the columns and types of a pitch, a missing column as null; ``keep``
    names columns that stay beside them."""
    present = set(bronze.columns)
    return bronze.selectExpr(*keep, *[f"CAST({c if c in present else 'NULL'} AS {t}) AS {c}" for c, t in PITCH_COLUMNS])


#: Pitches that one task of ``clean_sources`` sorts, about 200 MB of them.
SORTED_ROWS = 400_000


def clean_sources(sources: DataFrame, same: dict[str, str], typed: Callable[[DataFrame, list[str]], DataFrame],
                  together: Sequence[str] = (), sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The rows of ``sources`` whose pitch ``clean_pitches`` keeps, where a pitch is derived
    from a much narrower row.

    ``typed(rows, keep)`` derives the pitches and leaves the columns ``keep`` beside them;
    ``same`` gives expressions that are equal for two rows exactly where their
    ``pitch_id`` is. The narrow rows are shuffled, and pitches are only made where the
    copies of an id have met. The tasks are as many as the rows ask for, so that none
    has to spill what it sorts. ``sources`` should read files, as its rows are counted first.
    Rows whose pitches agree in the columns ``together`` come into one task, which is worth
    a second shuffle of narrow rows where the result is stored and grouped by these columns:
    each task's partial groups are then nearly the final ones.
    """
    spark = sources.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-sources.count() // sorted_rows))
    met = sources.withColumns({name: F.expr(e) for name, e in same.items()}).repartition(tasks, *same)
    first = _first_of_each(typed(met, [*sources.columns, *same]), list(same))
    if together:
        first = first.select(*sources.columns, *together).repartition(tasks, *together)
    return first.select(*sources.columns)


def clean_pitches(bronze: DataFrame, loaded_at: bool = False, few_repeats: bool = False, bits: int = MAP_BITS) -> DataFrame:
    """One typed row per ``pitch_id``.

    Which copy of an id stays is decided by all columns, so the result does not
    depend on file order. ``row_number() = 1`` lets Spark drop the losing copies
    in the map tasks already (WindowGroupLimit), so an id with very many copies
    sends one row per task through the shuffle.

    With ``few_repeats`` a first pass over the ids alone finds those that occur more
    than once, and only rows whose id may be repeated are compared. All others are
    neither sorted nor shuffled, and a reader of a few columns reads a few columns of
    them. The input is then read three times and should be a table. It pays where
    repeats are rare and the shuffle is the bottleneck; the rows are the same. The map
    of repeated ids has a fixed size: when ids outnumber its bits, more are compared.
    """
    typed = typed_pitches(bronze)
    if few_repeats:
        slot = F.pmod(F.xxhash64("pitch_id"), F.lit(bits))
        word = F.get(repeated_ids(typed.select("pitch_id"), "pitch_id", bits).scalar(), F.shiftright(slot, 6).cast("int"))
        repeated = F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        clean = typed.filter(~repeated).unionByName(_first_of_each(typed.filter(repeated)))
    else:
        clean = _first_of_each(typed)
    return stamped(clean) if loaded_at else clean


def stamped(pitches: DataFrame) -> DataFrame:
    """Pitches with the time of their loading."""
    return pitches.withColumn("loaded_at", F.current_timestamp())


def _first_of_each(typed: DataFrame, same: Sequence[str] = ("pitch_id",)) -> DataFrame:
    """The smallest row of each ``pitch_id``, by date and then the other columns; ``same``
    names columns that agree where the id does."""
    rest = ", ".join(c for c, _ in PITCH_COLUMNS if c not in ("pitch_id", "game_date"))
    place = f"row_number() OVER (PARTITION BY {', '.join(same)} ORDER BY game_date, {rest})"
    return typed.selectExpr("*", f"{place} AS _rn").filter("_rn = 1").drop("_rn")


def games(pitches: DataFrame) -> DataFrame:
    return pitches.groupBy("game_pk", "game_date", "home_team", "away_team").agg(
        F.max("post_home_score").alias("home_score"),
        F.max("post_away_score").alias("away_score"),
    )


def games_on(summary: DataFrame, day=None) -> DataFrame:
    """Distinct games, of one day or of every day."""
    rows = summary if day is None else summary.filter(F.col("game_date") == F.lit(day))
    return rows.select("game_date", "game_pk").distinct()


def _as_player(id_col: str, hand: str, word: str, position: str):
    return F.struct(
        F.col(id_col).alias("player_id"),
        F.concat(F.lit(f"{word} #"), F.col(id_col).cast("string")).alias("full_name"),
        F.col(hand).alias("hand"),
        F.lit(position).alias("position"),
    )


def players(pitches: DataFrame) -> DataFrame:
    """One row per player, hand and role: the pitchers and the batters of all
    pitches, taken from one scan and made distinct in one shuffle."""
    both = F.array(
        _as_player("pitcher_id", "p_throws", "Pitcher", "SP"),
        _as_player("batter_id", "stand", "Batter", "POS"),
    )
    return pitches.select(F.inline(both)).filter(F.col("player_id").isNotNull()).distinct()


def one_per_player(player_rows: DataFrame, position: str) -> DataFrame:
    """One row per id of one role, so that joining it never multiplies rows."""
    return (
        player_rows.filter(F.col("position") == position)
        .groupBy("player_id")
        .agg(F.min("full_name").alias("full_name"), F.min("hand").alias("hand"))
    )


def roster(pitchers: DataFrame, batters: DataFrame) -> DataFrame:
    """Roster of two id/name/team lists; batters carry hand 'R'."""
    cols = ["player_id", "full_name", "team", "position", "hand"]
    p = pitchers.withColumn("position", F.lit("SP")).select(*cols)
    b = batters.withColumn("position", F.lit("OF/1B")).withColumn("hand", F.lit("R")).select(*cols)
    return p.unionByName(b)
