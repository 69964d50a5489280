"""Run summaries and small report aggregates (AGG-1, AGG-2).

All of these are single-pass aggregations with map-side partial
aggregation, so one hot outcome or extension does not concentrate rows in
one task: only per-partition partial counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# --- fixed values: outcome names per command -----------------------------
OUTCOMES = {
    "index": ["Inserted", "Updated", "Unchanged", "Ignored", "Failed"],
    "import": ["Imported", "Ignored", "Skipped", "SkippedBySkipDb", "TrashedUpstream", "Invalid", "Failed"],
    "process": ["Success", "Modified", "Reprocess", "Deleted", "Skipped", "Invalid", "Ignored", "Failed"],
    "undo": ["Restored", "Deleted", "Failed"],
    "verify": ["Verified", "Skipped", "Invalid", "Ignored", "Failed"],
}
# Counters whose non-zero value makes the run "completed with failures" (2).
FAILING = {
    "index": ["Failed"],
    "import": ["Invalid", "Failed"],
    "process": ["Invalid", "Failed"],
    "undo": ["Failed"],
    "verify": ["Invalid", "Failed"],
}
RUN_SUCCESS, RUN_ERROR, RUN_PARTIAL = 0, 1, 2
# --------------------------------------------------------------------------


def counter_name(outcome: str) -> str:
    return "n_" + "".join("_" + ch.lower() if ch.isupper() else ch for ch in outcome).lstrip("_").replace("__", "_")


def run_summary(outcomes: DataFrame, command: str, outcome_col: str = "outcome") -> DataFrame:
    """AGG-1: one row with the total, one counter per outcome and run_status."""
    return _with_status(outcomes.agg(*_counters(command, outcome_col)), command)


def _counters(command: str, outcome_col: str) -> list[Column]:
    counts = [F.count_if(F.col(outcome_col) == o).alias(counter_name(o)) for o in OUTCOMES[command]]
    return [F.count(F.lit(1)).alias("total"), *counts]


def _with_status(s: DataFrame, command: str) -> DataFrame:
    bad = None
    for o in FAILING[command]:
        cond = F.col(counter_name(o)) > 0
        bad = cond if bad is None else (bad | cond)
    return s.withColumn("run_status", F.when(bad, F.lit(RUN_PARTIAL)).otherwise(F.lit(RUN_SUCCESS)))


def observed_summary(outcomes: DataFrame, command: str, write: Callable[[DataFrame], object], outcome_col: str = "outcome") -> DataFrame:
    """AGG-1 from the run that writes the plan: ``write`` stores the rows it
    is given (one action), which are counted on their way. Neither the plan nor
    what it is made from, file hashes among it, is computed for the summary
    again. The counts are those of :func:`run_summary`."""
    seen = Observation()
    write(outcomes.observe(seen, *_counters(command, outcome_col)))
    row = {k: int(v) for k, v in seen.get.items()}
    names = ["total", *[counter_name(o) for o in OUTCOMES[command]]]
    spark = outcomes.sparkSession
    return _with_status(spark.range(1).select(*[F.lit(row[n]).cast("long").alias(n) for n in names]), command)


def skipped_extensions(files: DataFrame, ext_col: str = "ext") -> DataFrame:
    """AGG-2: unsupported extensions (case-folded) with their file counts,
    ordered ignoring case; '' is reported as '(no extension)'."""
    from ..functions.names import is_supported

    e = F.lower(F.col(ext_col))
    return (
        files.filter(~is_supported(F.col(ext_col)))
        .groupBy(e.alias("extension"))
        .agg(F.count(F.lit(1)).alias("files"))
        .withColumn("label", F.when(F.col("extension") == "", F.lit("(no extension)")).otherwise(F.col("extension")))
        .orderBy("extension")
    )
