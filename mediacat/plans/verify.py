"""PLN-6 verify: reconcile decoder verdicts with the files that were asked
for.

Unsupported -> Ignored; (with a verify ledger) unchanged and already
verified, no ``reprocess`` -> Skipped (FLT-4); a path with CR/LF or outside
the mounted root -> Failed (FLT-5); otherwise the verdict for the mapped
container path (JN-6): none -> Failed, not ok -> Invalid with the decoder's
error (Failed where the file is gone by now), ok -> Verified.
Verified files are marked in the verify ledger (MUT-4).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.ledger import Hasher, set_processed
from ..operators.materialize import materialize
from ..sources.verdicts import parse_verdict_lines
from .index import index_run


@dataclass
class VerifyResult:
    outcomes: DataFrame  # path, outcome, error
    ledger: DataFrame | None


def container_path(path, root: str, mount: str) -> Column:
    """FLT-5: ``path`` below ``root`` re-rooted at ``mount``; null for paths
    outside the root (``..`` segments, siblings sharing a prefix) or with a
    line break. A name starting with '..' (``..name``) is legal."""
    p = F.col(path) if isinstance(path, str) else path
    r = root.rstrip("/")
    rel = F.substring(p, len(r) + 2, 1 << 30)
    inside = p.startswith(r + "/") & (rel != "")
    dotdot = rel.rlike(r"(^|/)\.\.(/|\z)")
    bad = p.rlike(r"[\r\n]")
    return F.when(inside & ~dotdot & ~bad, F.concat(F.lit(mount.rstrip("/") + "/"), rel))


def pending(outcomes_with_status: DataFrame, reprocess: bool) -> DataFrame:
    """FLT-4: drop rows that are unchanged, already flagged and not forced."""
    done = (F.col("status") == "Unchanged") & F.coalesce(F.col("was_processed"), F.lit(False)) & F.lit(not reprocess)
    return outcomes_with_status.filter(~done)


def verify_run(
    files: DataFrame,
    verdict_lines: DataFrame,
    root: str,
    mount: str,
    ledger: DataFrame | None = None,
    hasher: Hasher | None = None,
    reprocess: bool = False,
    still_there: DataFrame | None = None,
) -> VerifyResult:
    """``files``: path, file_size, mtime_ticks of the files to verify;
    ``verdict_lines``: line_no, line; ``still_there``: the paths (``path``)
    that exist after the decoder ran, all of ``files`` by default."""
    f = files.select("path", "file_size", "mtime_ticks")
    supported = N.is_supported(N.ext_of(N.name_of(F.col("path"))))
    next_ledger = None
    if ledger is not None:
        # the index run resolves every listed file once; its outcomes carry
        # the unsupported ones as Ignored
        idx = index_run(f, ledger, hasher)
        rows = idx.outcomes.select("path", "status", "was_processed")
    else:
        rows = f.select("path", F.when(~supported, "Ignored").alias("status"), F.lit(False).alias("was_processed"))
    verdicts = parse_verdict_lines(verdict_lines).withColumnRenamed("path", "container_path")
    rows = rows.withColumn("container_path", container_path("path", root, mount))
    rows = rows.join(verdicts, "container_path", "left")
    if still_there is not None:
        rows = rows.join(still_there.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
        gone = F.col("_there").isNull()
    else:
        gone = F.lit(False)
    done = (F.col("status") == "Unchanged") & F.coalesce(F.col("was_processed"), F.lit(False)) & F.lit(not reprocess)
    outcome = (
        F.when(F.col("status") == "Ignored", "Ignored")
        .when(F.coalesce(done, F.lit(False)), "Skipped")
        .when(F.col("status") == "Failed", "Failed")
        .when(F.col("container_path").isNull() | F.col("ok").isNull(), "Failed")
        .when(F.col("ok"), "Verified")
        .when(gone, "Failed")
        .otherwise("Invalid")
    )
    error = F.when(outcome == "Invalid", F.col("error"))
    outcomes = materialize(rows.select("path", outcome.alias("outcome"), error.alias("error")))
    if ledger is not None:
        next_ledger = set_processed(idx.ledger, outcomes.filter(F.col("outcome") == "Verified").select("path"))
    return VerifyResult(outcomes=outcomes, ledger=next_ledger)
