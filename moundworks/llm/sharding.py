"""Shards by jump consistent hashing, as column expressions only.

A key starts at shard 0 and jumps forward along a pseudo-random sequence that
depends on nothing but the key; the last stop below ``shards`` is its shard. With
one more shard, only keys whose next stop is that shard move, and they move there.
No ring or table is kept, so the state is the number of shards.

The sequence is the published one (Lamping and Veach, 2014): a 64-bit linear
congruential generator. Spark's bigint product fails on overflow in ANSI mode, so
the product modulo 2^64 is put together from 22-bit limbs.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.operators.ordering import ordered_index

#: Fixed values of the published generator.
MULTIPLIER, INCREMENT = 2862933555777941757, 1

_LIMB, _MASK = 22, (1 << 22) - 1


def _next_state(state: Column) -> Column:
    """``state * MULTIPLIER + INCREMENT`` modulo 2^64, without an overflow on the way."""
    m0, m1, m2 = (MULTIPLIER >> (_LIMB * i) & _MASK for i in range(3))
    s0, s1, s2 = (F.shiftrightunsigned(state, _LIMB * i).bitwiseAND(F.lit(_MASK)) for i in range(3))
    r0 = s0 * F.lit(m0) + F.lit(INCREMENT)
    r1 = s0 * F.lit(m1) + s1 * F.lit(m0) + F.shiftright(r0, _LIMB)
    r2 = s0 * F.lit(m2) + s1 * F.lit(m1) + s2 * F.lit(m0) + F.shiftright(r1, _LIMB)
    low = F.lit(_MASK)
    parts = [r0.bitwiseAND(low), F.shiftleft(r1.bitwiseAND(low), _LIMB), F.shiftleft(r2, 2 * _LIMB)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key, 0 to ``shards`` - 1.

    A jump always goes forward, so ``shards`` steps are enough; later steps leave
    the state as it is.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(acc: Column, _: Column) -> Column:
        state = _next_state(acc["state"])
        draw = F.shiftrightunsigned(state, 33) + F.lit(1)
        landed = F.floor((acc["next"] + F.lit(1)) * (F.lit(float(1 << 31)) / draw)).cast("bigint")
        going = acc["next"] < F.lit(shards)
        return F.struct(
            F.when(going, state).otherwise(acc["state"]).alias("state"),
            F.when(going, acc["next"]).otherwise(acc["shard"]).alias("shard"),
            F.when(going, landed).otherwise(acc["next"]).alias("next"),
        )

    start = F.struct(key.cast("bigint").alias("state"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"].cast("int"))


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row in a shard by its key alone.

    Returns ``key``, size (UTF-8 bytes of the text, plus 1), text_crc32, law, shard,
    slot (position in the shard by key, gapless from 0) and grown_shard (the shard
    under ``shards`` + 1).

    A null key is a key like any other; a null or empty text has no bytes: size 1, crc32
    0. Very long texts are read whole.
    Rows with one key share a shard, copies of a row get slots one after another. An
    empty table gives no rows. Other columns, whatever they are called, are not read.
    The texts are read once and only the numbers are shuffled; slots are counted in
    range slices, so neither a hot key nor a large shard has to fit in one task.
    """
    hashed = F.xxhash64(F.col(key))
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key),
        (F.octet_length(bytes_) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(hashed, shards).alias("shard"),
        jump_shard(hashed, shards + 1).alias("grown_shard"),
    )
    order = [key, "text_crc32", "size"]
    numbered = ordered_index(placed, order, ["shard"], "slot")
    return numbered.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
