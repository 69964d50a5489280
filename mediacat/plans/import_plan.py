"""PLN-2 import: decide, per source file, whether and where it is imported.

First match wins: unsupported -> Ignored; unreadable -> Failed; trashed
upstream (sha1 in the trash set) -> TrashedUpstream; sha256 in the skip
ledger -> SkippedBySkipDb; sha256 in the import ledger, or an earlier copy
imported in this run -> Skipped; metadata unreadable -> Failed; validation
errors -> Invalid; else Imported to ``outpath/<date>/<name>`` made unique
against the archive and the other imports of the run.

The result is the plan (the dry run is the product) plus the next import
ledger, keyed by *source* path with the source hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import metadata as M
from ..functions import names as N
from ..functions import tags as TG
from ..operators.ledger import Hasher, resolve_hashes
from ..operators.materialize import materialize
from ..operators.membership import flag_members
from ..operators.naming import unique_names
from ..operators.ranking import first_in_group
from ..schemas import LEDGER_COLUMNS


@dataclass
class ImportOptions:
    as_of_year: int
    date_path: bool = True  # infer a date from the path when metadata has none
    date_format: str = TG.DEFAULT_DATE_FORMAT
    outpath: str = ""
    tag_root: str | None = None  # path tags relative to this source root
    tags: str | None = None  # explicit comma separated tags
    rehash: bool = False


@dataclass
class ImportResult:
    plan: DataFrame  # path, outcome, reason, dest, created, tags
    ledger: DataFrame | None = None
    # what the archive keeps of each imported file: path, dest, created, tags,
    # file_size, mtime_ticks (the source's), sha256, sha1
    archive: DataFrame | None = None


def import_run(
    files: DataFrame,
    metadata_docs: DataFrame,
    hasher: Hasher,
    opts: ImportOptions,
    import_ledger: DataFrame | None = None,
    skip_ledger: DataFrame | None = None,
    trash: DataFrame | None = None,
    existing: DataFrame | None = None,
) -> ImportResult:
    """Build the import plan. ``files``: path, file_size, mtime_ticks;
    ``metadata_docs``: path, meta_json; ``existing``: archive paths (path)."""
    spark = files.sparkSession
    TG.check_date_only_format(spark, opts.date_format)
    listing = files.select("path", "file_size", "mtime_ticks").withColumn("ext", N.ext_of(N.name_of(F.col("path"))))
    supported = listing.filter(N.is_supported(F.col("ext")))
    ignored = listing.filter(~N.is_supported(F.col("ext"))).select(
        "path",
        F.lit("Ignored").alias("outcome"),
        F.lit("extension").alias("reason"),
        F.lit(None).cast("string").alias("dest"),
        F.lit(None).cast("string").alias("created"),
        F.lit(None).cast("string").alias("tags"),
    )

    empty_ledger = spark.createDataFrame([], "path string, sha256 string, sha1 string, file_size bigint, mtime_ticks bigint, is_processed boolean")
    hashing = any(x is not None for x in (import_ledger, skip_ledger, trash))
    if hashing:
        s = resolve_hashes(supported, import_ledger if import_ledger is not None else empty_ledger, hasher, opts.rehash)
    else:
        s = supported.withColumn("sha256", F.lit(None).cast("string")).withColumn("sha1", F.lit(None).cast("string"))
        for c in LEDGER_COLUMNS[1:]:
            s = s.withColumn("l_" + c, F.lit(None))

    # one membership join for each hash column: the sha256 sets share theirs
    s = flag_members(s, "sha1", {"in_trash": (trash, "sha1")}, unique="path")
    s = flag_members(s, "sha256", {"in_skip": (skip_ledger, "sha256"), "in_ledger": (import_ledger, "sha256")}, unique="path")

    meta = M.with_metadata(metadata_docs).select(
        "path", "meta_ok", "meta_ext", "meta_date_string", "meta_date", "validate_errors", "subjects"
    )
    s = s.join(meta, "path", "left")

    pre = (
        F.when(hashing & F.col("sha256").isNull(), "Failed")
        .when(F.col("in_trash"), "TrashedUpstream")
        .when(F.col("in_skip"), "SkippedBySkipDb")
        .when(F.col("in_ledger"), "Skipped")
        .when(~F.coalesce(F.col("meta_ok"), F.lit(False)), "Failed")
        .when(F.col("validate_errors") > 0, "Invalid")
        .otherwise("Imported")
    )
    # why a file is not imported: what could not be read, which set holds
    # its content, how many validation errors it has
    reason = (
        F.when(hashing & F.col("sha256").isNull(), "unreadable")
        .when(F.col("in_trash"), "trash")
        .when(F.col("in_skip"), "skip_ledger")
        .when(F.col("in_ledger"), "import_ledger")
        .when(~F.coalesce(F.col("meta_ok"), F.lit(False)), "no_metadata")
        .when(F.col("validate_errors") > 0, F.concat(F.lit("validation_errors:"), F.col("validate_errors").cast("string")))
    )
    # the decision table feeds the plan, the destinations and the ledger:
    # materialise its narrow projection once
    s = materialize(
        s.withColumn("outcome", pre).withColumn("reason", reason).select(
            "path", "file_size", "mtime_ticks", "sha256", "sha1", "outcome", "reason", "meta_ext", "meta_date_string", "meta_date"
        )
    )

    if import_ledger is not None:
        # WIN-4: the first copy (by source path) of a content hash wins
        cand = s.filter(F.col("outcome") == "Imported")
        cand = first_in_group(cand, ["sha256"], "path", "first_copy")
        rest = s.filter(F.col("outcome") != "Imported").withColumn("first_copy", F.lit(True))
        s = cand.unionByName(rest).withColumns(
            {
                "outcome": F.when(~F.col("first_copy"), F.lit("Skipped")).otherwise(F.col("outcome")),
                "reason": F.when(~F.col("first_copy"), F.lit("duplicate")).otherwise(F.col("reason")),
            }
        )

    imported = s.filter(F.col("outcome") == "Imported")
    imported = D.with_dates(imported, opts.as_of_year)
    inferred = (
        F.when(F.col("meta_date_string").isNull(), F.col("created_date"))
        if opts.date_path
        else F.lit(None).cast("timestamp_ntz")
    )
    imported = imported.withColumn("date", F.coalesce(inferred, F.col("meta_date")))
    imported = imported.withColumn("dest", TG.destination(F.col("date"), N.name_of(F.col("path")), opts.date_format, opts.outpath))

    writable = N.is_tag_writable(F.concat(F.lit("."), F.coalesce(F.col("meta_ext"), F.lit(""))))
    new_tags = F.array().cast("array<string>")
    if opts.tag_root is not None:
        new_tags = F.concat(new_tags, TG.path_tags(F.col("path"), opts.tag_root))
    explicit = TG.explicit_tags(opts.tags)
    if explicit:
        new_tags = F.concat(new_tags, F.array(*[F.lit(t) for t in explicit]))
    imported = imported.withColumn("applied_tags", F.when(writable, new_tags).otherwise(F.array().cast("array<string>")))

    # dates and destinations are computed once: the rows feed the naming
    # step, the plan and the ledger
    imported = materialize(
        imported.select("path", "file_size", "mtime_ticks", "sha256", "sha1", "date", "dest", "applied_tags")
    )
    existing_df = existing if existing is not None else spark.createDataFrame([], "path string")
    imported = unique_names(imported, existing_df, "dest", "path", cut_input=False)

    plan_imported = imported.select(
        "path",
        F.lit("Imported").alias("outcome"),
        F.lit(None).cast("string").alias("reason"),
        F.col("final_dest").alias("dest"),
        D.format_date(F.coalesce(F.col("date"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))).alias("created"),
        F.to_json(F.array_sort(F.col("applied_tags"))).alias("tags"),
    )
    plan_other = s.filter(F.col("outcome") != "Imported").select(
        "path",
        "outcome",
        "reason",
        F.lit(None).cast("string").alias("dest"),
        F.lit(None).cast("string").alias("created"),
        F.lit(None).cast("string").alias("tags"),
    )
    plan = plan_imported.unionByName(plan_other).unionByName(ignored)

    next_ledger = None
    if import_ledger is not None:
        # upsert the imported sources keyed by source path: insert new ones,
        # update hashes (and reset the flag) of known ones
        rows = imported.select(
            "path",
            "sha256",
            "sha1",
            "file_size",
            "mtime_ticks",
            F.lit(False).alias("is_processed"),
        )
        next_ledger = import_ledger.select(*LEDGER_COLUMNS).join(rows.select("path"), "path", "left_anti").unionByName(rows)
    archive = plan_imported.join(imported.select("path", "file_size", "mtime_ticks", "sha256", "sha1"), "path").drop("outcome", "reason")
    return ImportResult(plan=plan, ledger=next_ledger, archive=archive)
