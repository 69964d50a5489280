"""State-ledger operators: hash reuse (JN-1) and merges (MUT-1..5).

A ledger is an immutable snapshot keyed by ``path``; every operator here
returns a *new* snapshot DataFrame. All joins are equi-joins on ``path``,
which is unique on both sides, so hash partitioning on it cannot skew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LEDGER_COLUMNS
from .materialize import materialize

# A hasher adds ``c_sha256`` / ``c_sha1`` (lowercase hex; null where the row
# does not need hashing or the file is unreadable) to the rows it is given,
# hashing only where the boolean ``need`` column is true. It is applied to
# the output of the single ledger join, so the ledger is read and shuffled
# once and no branch of the plan is computed twice.
Hasher = Callable[[DataFrame, Column], DataFrame]


def table_hasher(hashes: DataFrame) -> Hasher:
    """Hasher backed by an already computed (path, sha256, sha1) table. The
    input is already partitioned by path (it comes out of the ledger join),
    so only the hash table is shuffled for this join."""
    h = hashes.select("path", F.col("sha256").alias("_t256"), F.col("sha1").alias("_t1"))

    def run(df: DataFrame, need: Column) -> DataFrame:
        j = df.withColumn("_need", need).join(h, "path", "left")
        return (
            j.withColumn("c_sha256", F.when(F.col("_need"), F.col("_t256")))
            .withColumn("c_sha1", F.when(F.col("_need"), F.col("_t1")))
            .drop("_t256", "_t1", "_need")
        )

    return run


def _prefixed(ledger: DataFrame, prefix: str = "l_") -> DataFrame:
    return ledger.select(*[F.col(c).alias(c if c == "path" else prefix + c) for c in LEDGER_COLUMNS])


def reuse_condition(rehash: bool) -> Column:
    """Stored hashes are reused when size and mtime are equal (and no rehash)."""
    return (
        F.lit(not rehash)
        & F.col("l_sha256").isNotNull()
        & (F.col("file_size") == F.col("l_file_size"))
        & (F.col("mtime_ticks") == F.col("l_mtime_ticks"))
    )


def resolve_hashes(files: DataFrame, ledger: DataFrame, hasher: Hasher, rehash: bool = False) -> DataFrame:
    """JN-1: left join the listing with the ledger on path and take the stored
    hashes where size and mtime are unchanged; only the other rows are handed
    to ``hasher`` (so unchanged files are never read).

    Returns the listing columns, the ``l_*`` ledger columns and sha256/sha1 as
    a written table, so that operators that read it several times do not hash
    again.
    """
    joined = files.join(_prefixed(ledger), "path", "left")
    reuse = F.coalesce(reuse_condition(rehash), F.lit(False))
    hashed = hasher(joined.withColumn("_reuse", reuse), ~F.col("_reuse"))
    resolved = (
        hashed.withColumn("sha256", F.when(F.col("_reuse"), F.col("l_sha256")).otherwise(F.col("c_sha256")))
        .withColumn("sha1", F.when(F.col("_reuse"), F.col("l_sha1")).otherwise(F.col("c_sha1")))
        .drop("_reuse", "c_sha256", "c_sha1")
    )
    return materialize(resolved)


def insert_or_ignore(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """MUT-1: add rows for unknown paths; an existing path wins. Several new
    rows for one path collapse to the smallest row (deterministic)."""
    one = rows.select(*LEDGER_COLUMNS).groupBy("path").agg(
        F.min(F.struct(*[c for c in LEDGER_COLUMNS if c != "path"])).alias("r")
    )
    one = one.select("path", *[F.col("r").getField(c).alias(c) for c in LEDGER_COLUMNS if c != "path"])
    return ledger.select(*LEDGER_COLUMNS).unionByName(one.join(ledger.select("path"), "path", "left_anti"))


def _update(ledger: DataFrame, updates: DataFrame, assign: dict[str, Column]) -> DataFrame:
    """Left join ``updates`` (one row per path, columns prefixed ``u_``) and
    assign the given expressions where a row matched; unknown paths ignored."""
    u = updates.select(F.col("path"), *[F.col(c).alias("u_" + c) for c in updates.columns if c != "path"])
    u = u.withColumn("u_hit", F.lit(True))
    j = ledger.select(*LEDGER_COLUMNS).join(u, "path", "left")
    hit = F.col("u_hit").isNotNull()
    out = []
    for c in LEDGER_COLUMNS:
        if c in assign:
            out.append(F.when(hit, assign[c]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def update_hashes(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """MUT-2: set hashes, size and mtime and reset is_processed."""
    return _update(
        ledger,
        updates.select("path", "sha256", "sha1", "file_size", "mtime_ticks"),
        {
            "sha256": F.col("u_sha256"),
            "sha1": F.col("u_sha1"),
            "file_size": F.col("u_file_size"),
            "mtime_ticks": F.col("u_mtime_ticks"),
            "is_processed": F.lit(False),
        },
    )


def update_metadata(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """MUT-3: set sha1, size and mtime; keep sha256 and is_processed."""
    return _update(
        ledger,
        updates.select("path", "sha1", "file_size", "mtime_ticks"),
        {"sha1": F.col("u_sha1"), "file_size": F.col("u_file_size"), "mtime_ticks": F.col("u_mtime_ticks")},
    )


def set_processed(ledger: DataFrame, paths: DataFrame) -> DataFrame:
    """MUT-4: mark the given paths processed."""
    return _update(ledger, paths.select("path").distinct(), {"is_processed": F.lit(True)})


def delete_by_path(ledger: DataFrame, paths: DataFrame) -> DataFrame:
    """MUT-5: drop the given paths."""
    return ledger.select(*LEDGER_COLUMNS).join(paths.select("path"), "path", "left_anti")
