"""Joins that stay balanced when one key holds a large share of the rows.

``big`` is joined with ``small`` (at most one row per key) on ``key``. The
``max_hot`` most frequent keys of ``big`` are estimated from a seeded
sample with a top-k (at most ``max_hot`` rows: a broadcast bounded by a
parameter, not by the data). Their ``small`` rows (again at most
``max_hot``) are broadcast and attached map-side; those big rows then get a
join key made from a per-row unique column, so the shuffle join that serves
every other key spreads them evenly instead of sending a hot key to one
task. Results are exact: no row is dropped, sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 256
HOT_SAMPLE = 0.01


def hot_keys(big: DataFrame, key: str, max_hot: int = MAX_HOT_KEYS, fraction: float | None = HOT_SAMPLE) -> DataFrame:
    """The ``max_hot`` most frequent non-null values of ``key``, estimated
    from a seeded sample (a key holding a noticeable share of the rows is
    always in it). The sample only picks which keys are spread; every row
    is still joined, so results do not depend on it."""
    src = big.select(key).where(F.col(key).isNotNull())
    if fraction is not None and fraction < 1.0:
        src = src.sample(fraction=fraction, seed=17)
    counts = src.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.col("_n").desc(), F.col(key)).limit(max_hot).select(key)


def skew_safe_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "left",
    unique: Column | str | None = None,
    max_hot: int = MAX_HOT_KEYS,
    fraction: float | None = HOT_SAMPLE,
) -> DataFrame:
    """``big`` joined (``left`` or ``inner``) with ``small`` on ``key``;
    ``small`` must hold at most one row per key. ``unique`` is a per-row
    unique value of ``big`` (default: a hash of all its columns)."""
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    cols = [c for c in small.columns if c != key]
    hot = F.broadcast(hot_keys(big, key, max_hot, fraction))
    # every hot key (matched in small or not), with its small row if any:
    # small is filtered map-side by the broadcast list, both sides stay tiny
    matched_hot = small.join(hot, key, "left_semi").withColumn("_sm", F.lit(True))
    small_hot = hot.join(matched_hot, key, "left").select(
        F.col(key).alias("_hk"), F.col("_sm").alias("_hm"), *[F.col(c).alias("_h_" + c) for c in cols]
    )
    u = F.xxhash64(*[F.col(c) for c in big.columns]) if unique is None else (F.col(unique) if isinstance(unique, str) else unique)
    x = big.join(F.broadcast(small_hot), big[key] == F.col("_hk"), "left")
    spread = F.col("_hk").isNotNull() | big[key].isNull()
    # hot rows (and rows without a key) get a per-row join key that hashes
    # evenly; the ``_js`` flag, false on the small side, keeps them from ever
    # matching a real key
    x = x.withColumn("_js", spread).withColumn(
        "_jk", F.when(spread, u.cast("string")).otherwise(F.col(key).cast("string"))
    )
    cold = small.select(
        F.lit(False).alias("_js"),
        F.col(key).cast("string").alias("_jk"),
        F.lit(True).alias("_cm"),
        *[F.col(c).alias("_c_" + c) for c in cols],
    )
    x = x.join(cold, ["_js", "_jk"], "left")
    matched = F.coalesce(F.col("_hm"), F.col("_cm"), F.lit(False))
    if how == "inner":
        x = x.filter(matched)
    out = x.select(
        *[F.col(c) for c in big.columns],
        *[F.coalesce(F.col("_h_" + c), F.col("_c_" + c)).alias(c) for c in cols],
    )
    return out
