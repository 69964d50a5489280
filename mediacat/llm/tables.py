"""Joins with small and with skewed sides, and bitmaps of keys, shared by the operators."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup table of at most this many rows is sent to all executors.
BROADCAST_ROWS = 200_000


def lookup(big: DataFrame, table: DataFrame, keys: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """``big`` with the columns of ``table`` (a written table with one row for
    each key) joined on ``keys``; a null key meets a null key.

    A table that is counted to have at most ``BROADCAST_ROWS`` rows is
    broadcast. A larger one is shuffled; each of its rows goes to ``salts``
    places and a row of ``big`` to one of them, so that a key with
    a third of all rows does not land in one task.
    """
    renamed = table.withColumnsRenamed({k: f"_lk{i}" for i, k in enumerate(keys)})
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_lk{i}"))
        on = same if on is None else on & same
    drop = [f"_lk{i}" for i in range(len(keys))]
    if table.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(renamed), on, how).drop(*drop)
    renamed = renamed.withColumn("_ls", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(renamed, on & (F.col("_salt") == F.col("_ls")), how).drop("_salt", "_ls", *drop)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed to ``c0``, ``c1``, ..., so that none
    clashes with an operator's own, and the new name of each column."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


def original(names: dict[str, str]) -> list[Column]:
    """The columns of a :func:`numbered` table under their names again."""
    return [F.col(new).alias(old) for old, new in names.items()]


def rank_among(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not above the value, looked up
    in two steps: among every ``w``-th bound, then in the run that it starts.
    The bounds are two literals of the plan."""
    if not bounds:
        return F.lit(0)
    w = math.isqrt(len(bounds) - 1) + 1
    runs = [bounds[i : i + w] for i in range(0, len(bounds), w)]
    heads = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>")
    nested = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    run = F.size(F.filter(heads, lambda x: x <= value))
    inside = F.size(F.filter(F.get(nested, run - 1), lambda x: x <= value))
    return F.when(run > 0, (run - 1) * w + inside).otherwise(F.lit(0))


#: bits of a bitmap for each key, and its least and largest size (64 MB)
KEY_BITS = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29


#: places of a key in a bitmap, as shifts: one bit, or two for keys whose halves are independent
ONE_PLACE, TWO_PLACES = (0,), (0, 32)


def bitmap_of(keys: DataFrame, column: str, places: tuple[int, ...] = ONE_PLACE) -> Broadcast:
    """A bitmap with the bits of the 64-bit keys of a written table set, on all
    executors. It tells rows that cannot meet a key before they are shuffled
    to an exact join: all but one in ``KEY_BITS``, up to ``MAX_BITS`` /
    ``KEY_BITS`` keys (33 million). Beyond, its size stays and it tells fewer: at
    half a billion keys six rows in ten, and every row still meets its key. With
    ``TWO_PLACES`` all but one in 70 are told, and more than with one up to
    250 million keys; at half a billion seven rows in ten pass. At most
    one long for each 64 bits comes to the driver."""
    bits = MIN_BITS
    n = keys.count()
    while bits < min(n * KEY_BITS, MAX_BITS):
        bits *= 2
    found = [F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(bits - 1)) for shift in places]
    place = found[0] if len(found) == 1 else F.explode(F.array(*found))
    longs = keys.select(place.alias("p")).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit")
    rows = longs.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(bits >> 6, 1), np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def in_bitmap(bitmap: Broadcast, keys: np.ndarray, places: tuple[int, ...] = ONE_PLACE) -> np.ndarray:
    """Whether the bits of 64-bit keys are set, at the places they were set at."""
    words, keys = bitmap.value, keys.view(np.uint64)
    out = np.ones(len(keys), bool)
    for shift in places:
        left = np.flatnonzero(out) if shift else slice(None)
        place = ((keys[left] >> np.uint64(shift)) & np.uint64(len(words) * 64 - 1)).astype(np.int64)
        out[left] = (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
    return out
