"""PLN-5 undo: restore originals from backups.

Backups are ``X.bak`` / ``X.bakN``; they group by their base ``X``
(ignoring case). A base is *derived* (made by processing, e.g. a
conversion output next to its source) when another group base has the
same directory and stem with a different extension (JN-7) and the base
file exists: then the base and all its backups are deleted. Otherwise the
primary backup (first non-empty one by number, ``.bak`` = 0; WIN-5) is
restored over the base (the current base is deleted first and not
counted), the other backups are deleted, and so are the conversion
tracker ``<primary>.out`` and the output it names, or - without a tracker
and for a non-mp4 base - the same-stem ``.mp4`` (JN-8), unless that output
is itself a group base. A group without a non-empty backup fails.

Everything is joins and aggregates keyed by the case-folded base; group
members are never collected into one row, and a base with a huge number of
backups is spread by the skew-safe join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.materialize import materialize
from ..operators.ranking import group_ordinal
from ..operators.skew import skew_safe_join
from ..operators.summary import RUN_PARTIAL, RUN_SUCCESS


@dataclass
class UndoResult:
    plan: DataFrame  # base, action, path, target, counted
    summary: DataFrame  # restored, deleted, failed, run_status
    groups: DataFrame  # one row per group: base, n_backups, primary, derived ...


def backup_rows(listing: DataFrame) -> DataFrame:
    """COL-18 on a listing: one row per backup with base, numeric key, size."""
    parts = N.backup_parts(F.col("path"))
    return (
        listing.select("path", "file_size")
        .filter(parts["is_backup"])
        .withColumn("base", parts["base"])
        .withColumn("backup_key", parts["backup_key"])
        .withColumn("gkey", F.lower(F.col("base")))
    )


def backup_groups(listing: DataFrame) -> DataFrame:
    """AGG-4 as rows: each backup with its position in its group (by key,
    then path), the group size and whether the group has a non-empty one."""
    b = backup_rows(listing)
    ranked = group_ordinal(b, ["gkey"], [F.col("backup_key"), F.col("path")], name="position")
    stats = b.groupBy("gkey").agg(
        F.count(F.lit(1)).alias("n_backups"), F.max(F.col("file_size") > 0).alias("has_nonempty")
    )
    return skew_safe_join(ranked, stats, "gkey", "inner", unique="path").select(
        "gkey", "base", "path", "backup_key", "file_size", "position", "n_backups", "has_nonempty"
    )


def group_table(listing: DataFrame) -> DataFrame:
    """One row per backup group: base spelling, primary backup (WIN-5),
    stem-peer flag (JN-7), base existence and derived flag."""
    b = backup_rows(listing)
    g = b.groupBy("gkey").agg(
        F.min("base").alias("base"),
        F.min(F.when(F.col("file_size") > 0, F.struct("backup_key", "path"))).alias("_p"),
        F.count(F.lit(1)).alias("n_backups"),
    )
    g = g.withColumn("primary", F.col("_p.path")).drop("_p")
    name = N.name_of(F.col("base"))
    g = g.withColumns(
        {
            "_dir": F.lower(N.dir_of(F.col("base"))),
            "_stem": F.lower(N.stem_of(name)),
            "_ext": F.lower(N.ext_of(name)),
        }
    )
    peers = g.groupBy("_dir", "_stem").agg(F.countDistinct("_ext").alias("_n_ext"))
    g = g.join(peers, ["_dir", "_stem"], "left").withColumn("has_stem_peer", F.col("_n_ext") > 1)
    present = listing.select(F.col("path").alias("base")).distinct().withColumn("base_exists", F.lit(True))
    g = g.join(present, "base", "left").withColumn("base_exists", F.coalesce(F.col("base_exists"), F.lit(False)))
    g = g.withColumn("derived", F.col("has_stem_peer") & F.col("base_exists"))
    return g.select("gkey", "base", "primary", "n_backups", "has_stem_peer", "base_exists", "derived", "_ext")


def undo_run(listing: DataFrame, trackers: DataFrame) -> UndoResult:
    """``listing``: path, file_size of the library (backups included);
    ``trackers``: backup_path, output_path (content of ``<backup>.out``)."""
    # everything below reads the landed group table
    g = materialize(group_table(listing))
    none = F.lit(None).cast("string")
    restored = ~F.col("derived") & F.col("primary").isNotNull()

    def act(action, path, target=none, counted=True):
        return F.struct(F.lit(action).alias("action"), path.alias("path"), target.alias("target"), F.lit(counted).alias("counted"))

    # what follows from the group alone
    actions = F.array(
        F.when(F.col("derived"), act("delete", F.col("base"))),
        F.when(~F.col("derived") & F.col("primary").isNull(), act("fail", none)),
        F.when(restored & F.col("base_exists"), act("delete_current", F.col("base"), counted=False)),
        F.when(restored, act("restore", F.col("primary"), F.col("base"))),
    )
    group_rows = g.select("base", F.explode(F.filter(actions, lambda x: x.isNotNull())).alias("_a")).select("base", "_a.*")

    # every backup of a derived group, and all but the restored one of the others
    done = g.filter(F.col("derived") | F.col("primary").isNotNull()).select("gkey", "base", F.when(~F.col("derived"), F.col("primary")).alias("_kept"))
    spent = skew_safe_join(backup_rows(listing).select("gkey", "path"), done, "gkey", "inner", unique="path")
    spent = spent.filter(~F.col("path").eqNullSafe(F.col("_kept")))
    spent = spent.select("base", F.lit("delete").alias("action"), "path", none.alias("target"), F.lit(True).alias("counted"))

    # JN-8: the primary's tracker, the output that it names, and without a
    # tracker the output it would have; one lookup of all names in the listing
    outputs = trackers.select(F.col("backup_path").alias("primary"), F.regexp_replace(F.col("output_path"), r"^\s+|\s+\z", "").alias("_output"))
    folder = F.when(F.col("base").contains("/"), F.concat(N.dir_of(F.col("base")), F.lit("/"))).otherwise(F.lit(""))
    guess = F.when(
        F.col("_ext") != N.VIDEO_OUTPUT_EXTENSION,
        F.concat(folder, N.stem_of(N.name_of(F.col("base"))), F.lit(N.VIDEO_OUTPUT_EXTENSION)),
    )
    names = F.array(
        F.struct(F.lit("tracker").alias("kind"), F.concat(F.col("primary"), F.lit(".out")).alias("path")),
        F.struct(F.lit("tracked").alias("kind"), F.col("_output").alias("path")),
        F.struct(F.lit("guessed").alias("kind"), guess.alias("path")),
    )
    asked = g.filter(restored).join(outputs, "primary", "left").select("base", F.explode(names).alias("_n")).select("base", "_n.*").distinct()
    there = asked.filter(F.col("path").isNotNull()).join(listing.select("path"), "path", "left_semi")
    own = g.select(F.col("gkey").alias("_okey"), F.lit(True).alias("_own"))
    there = materialize(there.join(own, F.lower(F.col("path")) == F.col("_okey"), "left").select("base", "kind", "path", "_own"))
    tracked = there.filter(F.col("kind") == "tracker").select("base", F.lit(True).alias("_tracked"))
    extra = there.join(tracked, "base", "left").filter(
        (F.col("kind") == "tracker")
        | (F.col("_own").isNull() & ((F.col("kind") == "tracked") == F.col("_tracked").isNotNull()))
    )
    extra = extra.select("base", F.lit("delete").alias("action"), "path", none.alias("target"), F.lit(True).alias("counted"))
    plan = group_rows.unionByName(spent).unionByName(extra)

    summary = plan.agg(
        F.count_if((F.col("action") == "restore") & F.col("counted")).cast("long").alias("restored"),
        F.count_if((F.col("action") == "delete") & F.col("counted")).cast("long").alias("deleted"),
        F.count_if(F.col("action") == "fail").cast("long").alias("failed"),
    ).withColumn("run_status", F.when(F.col("failed") > 0, F.lit(RUN_PARTIAL)).otherwise(F.lit(RUN_SUCCESS)))
    return UndoResult(plan=plan, summary=summary, groups=g.drop("_ext"))
