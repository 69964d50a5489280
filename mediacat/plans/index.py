"""PLN-1 index: compare a listing with the state ledger.

One full outer join of listing and ledger on ``path`` feeds both products:
the per-file outcome (Inserted / Updated / Unchanged / Ignored / Failed)
and the next ledger snapshot; the ledger is read and shuffled once. Only
rows whose size or mtime changed (or all rows with ``rehash``) are hashed,
so unchanged files are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ext_of, is_supported, name_of
from ..operators.ledger import Hasher, _prefixed, reuse_condition
from ..operators.materialize import materialize
from ..schemas import LEDGER_COLUMNS

INDEX_OUTCOMES = ["Inserted", "Updated", "Unchanged", "Ignored", "Failed"]


@dataclass
class IndexResult:
    outcomes: DataFrame  # path, status, was_processed
    ledger: DataFrame  # next snapshot


def _resolved(files: DataFrame, ledger: DataFrame, hasher: Hasher, rehash: bool) -> DataFrame:
    listed = (
        files.select("path", "file_size", "mtime_ticks")
        .filter(is_supported(ext_of(name_of(F.col("path")))))
        .withColumn("listed", F.lit(True))
    )
    j = listed.join(_prefixed(ledger), "path", "full_outer")
    is_listed = F.col("listed").isNotNull()
    j = j.withColumn("_reuse", ~is_listed | F.coalesce(reuse_condition(rehash), F.lit(False)))
    hashed = hasher(j, ~F.col("_reuse"))
    return (
        hashed.withColumn("sha256", F.when(F.col("_reuse"), F.col("l_sha256")).otherwise(F.col("c_sha256")))
        .withColumn("sha1", F.when(F.col("_reuse"), F.col("l_sha1")).otherwise(F.col("c_sha1")))
        .drop("_reuse", "c_sha256", "c_sha1")
    )


def index_run(
    files: DataFrame, ledger: DataFrame, hasher: Hasher, mark_processed: bool = False, rehash: bool = False
) -> IndexResult:
    # outcomes and ledger share the resolved rows: each file is hashed once
    r = materialize(_resolved(files, ledger, hasher, rehash))
    listed = F.col("listed").isNotNull()
    known = F.col("l_sha256").isNotNull()
    failed = F.col("sha256").isNull()
    changed = F.col("sha256") != F.col("l_sha256")
    touched = (F.col("file_size") != F.col("l_file_size")) | (F.col("mtime_ticks") != F.col("l_mtime_ticks"))
    status = (
        F.when(failed, "Failed")
        .when(~known, "Inserted")
        .when(changed, "Updated")
        .when(touched, F.when(F.col("l_is_processed"), "Unchanged").otherwise("Updated"))
        .otherwise("Unchanged")
    )
    processed = (
        F.when(failed, F.lit(None).cast("boolean"))
        .when(~known, F.lit(mark_processed))
        .when(changed, F.lit(False))
        .otherwise(F.col("l_is_processed"))
    )
    r = r.withColumn("status", F.when(listed, status)).withColumn("was_processed", F.when(listed, processed))

    listed_outcomes = r.filter(listed).select("path", "status", "was_processed")
    ignored = (
        files.select("path")
        .filter(~is_supported(ext_of(name_of(F.col("path")))))
        .select("path", F.lit("Ignored").alias("status"), F.lit(None).cast("boolean").alias("was_processed"))
    )
    outcomes = listed_outcomes.unionByName(ignored)

    fresh = listed & ~failed
    next_ledger = r.filter(fresh | known).select(
        "path",
        F.when(fresh, F.col("sha256")).otherwise(F.col("l_sha256")).alias("sha256"),
        F.when(fresh, F.col("sha1")).otherwise(F.col("l_sha1")).alias("sha1"),
        F.when(fresh, F.col("file_size")).otherwise(F.col("l_file_size")).alias("file_size"),
        F.when(fresh, F.col("mtime_ticks")).otherwise(F.col("l_mtime_ticks")).alias("mtime_ticks"),
        F.when(fresh, F.col("was_processed")).otherwise(F.col("l_is_processed")).alias("is_processed"),
    )
    return IndexResult(outcomes=outcomes, ledger=next_ledger.select(*LEDGER_COLUMNS))
