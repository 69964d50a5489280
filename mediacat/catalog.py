"""Registered queries: one per operator of the inventory, each a callable
``(spark, sf_dir) -> DataFrame`` over the stand-in inputs of
:mod:`mediacat.fixtures`. The DuckDB oracle for each lives in
:mod:`mediacat.oracle` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import AS_OF_YEAR, LIB_ROOT, MEDIA_ROOT, fixtures, stage_media_tree
from .functions import dates as D
from .functions import metadata as M
from .functions import names as N
from .functions import tags as TG
from .operators import ledger as led
from .operators.directories import empty_directories
from .operators.groups import case_conflicts, live_photo_pairs, stem_waves
from .operators.materialize import materialize
from .operators.membership import flag_member
from .operators.naming import unique_names
from .operators.ranking import first_in_group
from .operators.summary import observed_summary, run_summary, skipped_extensions
from .plans.import_plan import ImportOptions, import_run
from .plans.index import index_run
from .plans.process import ProcessOptions, next_backup_names, process_decisions, process_run
from .plans.trash_sync import trash_sync, visited_pages
from .plans.undo import backup_groups, group_table, undo_run
from .plans.verify import container_path, pending, verify_run
from .session import scratch_path
from .sinks import snapshots as SN
from .sinks.partitioned_ledger import merge_ledger, read_partitioned_ledger, write_partitioned_ledger
from .sources.files import file_hasher, hash_files, list_files, read_trackers
from .sources.listing_source import read_listing
from .sources.trash_feed import parse_feed_pages
from .sources.verdicts import parse_verdict_lines
from .streaming.keyed_index import apply_changes, changes_of, keyed_index, ledger_after, read_log
from .streaming.stream_index import start_ledger, stream_index
from .streaming.trash_stream import read_added, trash_after, trash_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _listing(fx) -> DataFrame:
    return fx.media_files.select("path", "file_size", "mtime_ticks")


def _hashes(fx) -> DataFrame:
    return fx.media_files.select("path", "sha256", "sha1")


def _index(spark, sf_dir, mark_processed=False):
    fx = fixtures(spark, sf_dir)
    return index_run(_listing(fx), fx.ledger, led.table_hasher(_hashes(fx)), mark_processed=mark_processed)


@register("index_outcomes")
def index_outcomes(spark, sf_dir):
    """PLN-1: per-file index status against the ledger."""
    return _index(spark, sf_dir).outcomes


@register("index_ledger")
def index_ledger(spark, sf_dir):
    """PLN-1: next ledger snapshot (inserts, hash updates and metadata updates in one merge)."""
    return _index(spark, sf_dir).ledger


@register("index_summary")
def index_summary(spark, sf_dir):
    """AGG-1 over PLN-1."""
    return run_summary(_index(spark, sf_dir).outcomes, "index", "status")


@register("index_mark_processed_outcomes")
def index_mark_processed_outcomes(spark, sf_dir):
    """PLN-1 with mark_processed: only inserts take the flag."""
    return _index(spark, sf_dir, mark_processed=True).outcomes


# ------------------------------------------------------------ column jobs


@register("media_names")
def media_names(spark, sf_dir):
    """FLT-1..3, COL-1, COL-2, COL-17: name parts, support, class and conversion class."""
    fx = fixtures(spark, sf_dir)
    df = N.with_names(fx.media_files.select("path", "audio_codec"))
    return df.select(
        "path",
        "dir",
        "name",
        "ext",
        "stem",
        N.is_supported(F.col("ext")).alias("supported"),
        N.media_class(F.col("ext")).alias("media_class"),
        N.is_live_video(F.col("ext")).alias("live_video"),
        N.is_live_image(F.col("ext")).alias("live_image"),
        N.compound_base(F.col("path")).alias("compound_base"),
        N.compound_ext(F.col("path")).alias("compound_ext"),
        N.is_mixed_case(F.col("ext")).alias("mixed_case_ext"),
        N.conversion_class(F.col("ext"), F.col("audio_codec")).alias("conversion"),
    )


@register("created_dates")
def created_dates(spark, sf_dir):
    """COL-4..6: date from file name, from directory path, and the inferred date."""
    fx = fixtures(spark, sf_dir)
    df = D.with_dates(fx.media_files.select("path"), AS_OF_YEAR)
    return df.select(
        "path",
        D.format_date(F.col("name_date")).alias("name_date"),
        D.format_date(F.col("path_date")).alias("path_date"),
        D.format_date(F.col("created_date")).alias("created_date"),
    )


@register("metadata_fields")
def metadata_fields(spark, sf_dir):
    """SRC-4, COL-7..12: typed metadata projection and derived fields."""
    fx = fixtures(spark, sf_dir)
    df = M.with_metadata(fx.media_meta)
    return df.select(
        "path",
        "meta_ok",
        "meta_ext",
        "meta_date_string",
        D.format_date(F.col("meta_date")).alias("meta_date"),
        "validate_errors",
        "validate_warnings",
        "dng_newer",
        "content_id",
        F.to_json(F.col("subjects")).alias("subjects"),
    )


@register("mime_targets")
def mime_targets(spark, sf_dir):
    """COL-3: rename target when the metadata file type disagrees with the extension."""
    fx = fixtures(spark, sf_dir)
    meta = M.parse_metadata(fx.media_meta).select("path", F.col(M.column_name("File:FileTypeExtension")).alias("meta_ext"))
    df = fx.media_files.select("path").join(meta, "path", "left")
    return df.select("path", "meta_ext", N.mime_target(F.col("path"), F.col("meta_ext")).alias("target"))


@register("backup_names")
def backup_names(spark, sf_dir):
    """COL-18: backup name parts of a backup listing."""
    fx = fixtures(spark, sf_dir)
    parts = N.backup_parts(F.col("path"))
    return fx.backup_listing.select("path", *[c.alias(k) for k, c in parts.items()])


@register("feed_checksums")
def feed_checksums(spark, sf_dir):
    """COL-13: feed checksum (base64) to lowercase SHA-1 hex."""
    fx = fixtures(spark, sf_dir)
    return fx.trash_pages.select("id", "checksum", TG.checksum_to_hex(F.col("checksum")).alias("sha1_hex"))


EXPLICIT_TAGS = "family, trip,,family "


@register("import_tags")
def import_tags(spark, sf_dir):
    """COL-14, COL-15: path tags below the library root plus explicit tags,
    merged into the existing subjects when the file type is tag-writable."""
    fx = fixtures(spark, sf_dir)
    meta = M.with_metadata(fx.media_meta).select("path", "subjects", "meta_ext")
    df = fx.media_files.select("path").join(meta, "path", "left")
    writable = N.is_tag_writable(F.concat(F.lit("."), F.coalesce(F.col("meta_ext"), F.lit(""))))
    explicit = F.array(*[F.lit(t) for t in TG.explicit_tags(EXPLICIT_TAGS)]).cast("array<string>")
    new = F.concat(TG.path_tags(F.col("path"), LIB_ROOT), explicit)
    merged = TG.merge_tags(F.col("subjects"), new, writable)
    return df.select(
        "path",
        F.to_json(F.array_sort(TG.path_tags(F.col("path"), LIB_ROOT))).alias("path_tags"),
        F.to_json(F.array_sort(merged)).alias("tags"),
    )


# ------------------------------------------------------------ import


def _import(spark, sf_dir, hasher=None):
    fx = fixtures(spark, sf_dir)
    opts = ImportOptions(as_of_year=AS_OF_YEAR, date_path=True, tag_root=LIB_ROOT, tags=EXPLICIT_TAGS)
    return import_run(
        _listing(fx),
        fx.media_meta,
        hasher(spark, fx) if hasher else led.table_hasher(_hashes(fx)),
        opts,
        import_ledger=fx.import_ledger,
        skip_ledger=fx.skip_ledger,
        trash=fx.trash,
        existing=fx.existing_dest,
    )


@register("import_plan")
def import_plan(spark, sf_dir):
    """PLN-2: per-source outcome, unique destination, created date and tags."""
    return _import(spark, sf_dir).plan


@register("import_summary")
def import_summary(spark, sf_dir):
    """AGG-1 over PLN-2."""
    return run_summary(_import(spark, sf_dir).plan, "import", "outcome")


@register("import_ledger_next")
def import_ledger_next(spark, sf_dir):
    """PLN-2: import ledger after the run, keyed by source path (new sources inserted, known ones updated)."""
    return _import(spark, sf_dir).ledger


@register("trash_membership")
def trash_membership(spark, sf_dir):
    """JN-2: files whose sha1 is in the trash set."""
    fx = fixtures(spark, sf_dir)
    return flag_member(_hashes(fx), fx.trash, "sha1", "sha1", "in_trash").select("path", "in_trash")


@register("skip_membership")
def skip_membership(spark, sf_dir):
    """JN-3: files whose sha256 is in the skip ledger."""
    fx = fixtures(spark, sf_dir)
    return flag_member(_hashes(fx), fx.skip_ledger, "sha256", "sha256", "in_skip").select("path", "in_skip")


@register("import_ledger_membership")
def import_ledger_membership(spark, sf_dir):
    """JN-4: files whose sha256 occurs anywhere in the import ledger."""
    fx = fixtures(spark, sf_dir)
    return flag_member(_hashes(fx), fx.import_ledger, "sha256", "sha256", "in_ledger").select("path", "in_ledger")


@register("first_copy")
def first_copy(spark, sf_dir):
    """WIN-4: the first file (by path) of each content hash wins."""
    fx = fixtures(spark, sf_dir)
    return first_in_group(_hashes(fx), ["sha256"], "path", "is_first").select("path", "sha256", "is_first")


@register("unique_destinations")
def unique_destinations(spark, sf_dir):
    """WIN-3: every file asks for 2019/03/04/<name>; free names are kept,
    the rest get the smallest free _K suffix."""
    fx = fixtures(spark, sf_dir)
    req = fx.media_files.select("path", F.concat(F.lit("2019/03/04/"), N.name_of(F.col("path"))).alias("dest"))
    return unique_names(req, fx.existing_dest, "dest", "path").select("path", "dest", "final_dest")


# ------------------------------------------------------------ trash feed


def _landed_pages(fx) -> DataFrame:
    """Stand-in for landed feed responses: one JSON document per page built
    from the flattened fixture rows (input staging only)."""
    tp = fx.trash_pages
    item = F.struct(
        F.col("id").alias("id"),
        F.col("checksum").alias("checksum"),
        F.col("original_file_name").alias("originalFileName"),
        F.col("is_trashed").alias("isTrashed"),
    )
    per_page = tp.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), item.alias("v")))).alias("kv"),
        F.min("next_page").alias("next_page"),
    )
    body = F.to_json(
        F.struct(F.struct(F.transform("kv", lambda x: x["v"]).alias("items"), F.col("next_page").alias("nextPage")).alias("assets"))
    )
    return per_page.select("page", body.alias("body"))


@register("feed_items")
def feed_items(spark, sf_dir):
    """SRC-5: landed feed page documents parsed and exploded into assets."""
    fx = fixtures(spark, sf_dir)
    return parse_feed_pages(_landed_pages(fx)).select(
        "page", "next_page", "id", "checksum", "original_file_name", "is_trashed"
    )


@register("trash_pages_visited")
def trash_pages_visited(spark, sf_dir):
    """PLN-7 pagination: pages reached by following next_page from page 1."""
    fx = fixtures(spark, sf_dir)
    return visited_pages(fx.trash_pages)


@register("trash_sync_set")
def trash_sync_set(spark, sf_dir):
    """PLN-7 + MUT-6: trash set after folding in the feed."""
    fx = fixtures(spark, sf_dir)
    return trash_sync(fx.trash_pages, fx.trash).trash


@register("trash_sync_totals")
def trash_sync_totals(spark, sf_dir):
    """AGG-3: fetched, inserted, total, partial flag and run status."""
    fx = fixtures(spark, sf_dir)
    return trash_sync(fx.trash_pages, fx.trash).totals


# ------------------------------------------------------------ process


def _probe(fx) -> DataFrame:
    return fx.media_files.select("path", "duration_s", "audio_codec")


def _process(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return process_run(
        _listing(fx),
        fx.media_meta,
        _probe(fx),
        ProcessOptions(),
        ledger=fx.ledger,
        trash=fx.trash,
        hasher=led.table_hasher(_hashes(fx)),
    )


@register("case_conflicts")
def case_conflicts_q(spark, sf_dir):
    """WIN-1: paths equal ignoring case and their conflict-free new names."""
    return case_conflicts(_listing(fixtures(spark, sf_dir)))


@register("stem_waves")
def stem_waves_q(spark, sf_dir):
    """WIN-2: wave of each file among media files sharing dir+stem (ignoring case)."""
    return stem_waves(_listing(fixtures(spark, sf_dir)))


@register("live_photo_pairs")
def live_photo_pairs_q(spark, sf_dir):
    """JN-5: live videos and their first existing companion image."""
    fx = fixtures(spark, sf_dir)
    return live_photo_pairs(_listing(fx), _listing(fx))


@register("next_backup_names")
def next_backup_names_q(spark, sf_dir):
    """WIN-6: next free backup name for every original file of the backup listing."""
    fx = fixtures(spark, sf_dir)
    bl = fx.backup_listing
    originals = bl.filter(~F.col("path").rlike(r"\.bak(\d*)\z") & ~F.col("path").endswith(".bak.out"))
    return next_backup_names(originals, bl)


@register("process_plan")
def process_plan(spark, sf_dir):
    """PLN-3 + PLN-4: the clean-up plan, iterated until no file re-enters."""
    return _process(spark, sf_dir).plan.drop("step")


@register("process_summary")
def process_summary_q(spark, sf_dir):
    """AGG-1 over the process plan, counted per plan row like the command."""
    from .plans.process import process_summary

    return process_summary(_process(spark, sf_dir).plan)


@register("process_ledger")
def process_ledger(spark, sf_dir):
    """PLN-3 ledger effects: index, trash deletes removed, finished files marked processed."""
    return _process(spark, sf_dir).ledger


# ------------------------------------------------------------ undo


@register("backup_groups")
def backup_groups_q(spark, sf_dir):
    """AGG-4: backups grouped by case-folded base, with position, size of group, non-empty flag."""
    return backup_groups(fixtures(spark, sf_dir).backup_listing).drop("gkey")


@register("undo_groups")
def undo_groups(spark, sf_dir):
    """WIN-5 + JN-7: per backup group the primary backup, stem-peer, existence and derived flags."""
    return group_table(fixtures(spark, sf_dir).backup_listing).drop("gkey", "_ext")


@register("undo_plan")
def undo_plan(spark, sf_dir):
    """PLN-5 + JN-8: restore / delete plan of an undo run."""
    fx = fixtures(spark, sf_dir)
    return undo_run(fx.backup_listing, fx.trackers).plan


@register("undo_plan_from_disk")
def undo_plan_from_disk(spark, sf_dir):
    """PLN-5 + SRC-8: the undo plan with the tracker files read from the library itself."""
    fx = fixtures(spark, sf_dir)
    root = stage_media_tree(spark, fx)
    return undo_run(fx.backup_listing, read_trackers(spark, root + LIB_ROOT, strip_prefix=root)).plan


@register("undo_summary")
def undo_summary(spark, sf_dir):
    """AGG-1 for undo: restored, deleted, failed and run status."""
    fx = fixtures(spark, sf_dir)
    return undo_run(fx.backup_listing, fx.trackers).summary


# ------------------------------------------------------------ verify


def _verify(spark, sf_dir, hasher=None, listed_after=False):
    fx = fixtures(spark, sf_dir)
    hasher = hasher(spark, fx) if hasher else led.table_hasher(_hashes(fx))
    # every third group of files is gone when the decoder is done
    after = fx.media_files.where("g % 3 <> 1").select("path") if listed_after else None
    return verify_run(_listing(fx), fx.verdict_lines, LIB_ROOT, MEDIA_ROOT, ledger=fx.ledger, hasher=hasher, still_there=after)


@register("verdicts")
def verdicts_q(spark, sf_dir):
    """SRC-7: decoder verdict lines parsed, noise dropped, last line per path."""
    return parse_verdict_lines(fixtures(spark, sf_dir).verdict_lines)


@register("container_paths")
def container_paths_q(spark, sf_dir):
    """FLT-5: library paths mapped below the container mount."""
    fx = fixtures(spark, sf_dir)
    return _listing(fx).select("path", container_path("path", LIB_ROOT, MEDIA_ROOT).alias("container_path"))


@register("verify_outcomes")
def verify_outcomes(spark, sf_dir):
    """PLN-6 + JN-6 + FLT-4: per-file verify outcome."""
    return _verify(spark, sf_dir).outcomes


@register("verify_summary")
def verify_summary(spark, sf_dir):
    """AGG-1 for verify."""
    return run_summary(_verify(spark, sf_dir).outcomes, "verify", "outcome")


@register("verify_ledger")
def verify_ledger(spark, sf_dir):
    """PLN-6 + MUT-4: verify ledger with verified files flagged."""
    return _verify(spark, sf_dir).ledger


@register("verify_outcomes_gone")
def verify_outcomes_gone(spark, sf_dir):
    """PLN-6 + JN-6 against a listing taken after the decoder's run: rejected
    files that are gone by then Failed, they are not Invalid."""
    return _verify(spark, sf_dir, listed_after=True).outcomes


@register("verify_summary_gone")
def verify_summary_gone(spark, sf_dir):
    """AGG-1 for verify where files went during the run."""
    return run_summary(_verify(spark, sf_dir, listed_after=True).outcomes, "verify", "outcome")


# ------------------------------------------------------------ directories


@register("empty_directories")
def empty_directories_q(spark, sf_dir):
    """SRT-1: directories below the library root with no surviving file, deepest first."""
    fx = fixtures(spark, sf_dir)
    return empty_directories(fx.media_dirs, _listing(fx), LIB_ROOT)


# ------------------------------------------------------------ sources, sinks, streaming


def _tree_listing(spark, fx):
    root = stage_media_tree(spark, fx)
    local = root[len("file:") :] if root.startswith("file:") else root
    return root, list_files(spark, root + LIB_ROOT, strip_prefix=local)


@register("listed_files")
def listed_files(spark, sf_dir):
    """SRC-1: recursive listing of a landed library (metadata only, no content read)."""
    fx = fixtures(spark, sf_dir)
    _, listing = _tree_listing(spark, fx)
    return listing.select("path", "file_size")


@register("hashed_files")
def hashed_files(spark, sf_dir):
    """SRC-2: SHA-256 and SHA-1 of every landed file, streamed on the executors."""
    fx = fixtures(spark, sf_dir)
    root, listing = _tree_listing(spark, fx)
    return hash_files(listing.select("path", "file_size"), root)


@register("listed_files_source")
def listed_files_source(spark, sf_dir):
    """SRC-1: the same listing through the ``file_listing`` data source."""
    fx = fixtures(spark, sf_dir)
    root = stage_media_tree(spark, fx)
    local = root[len("file:") :] if root.startswith("file:") else root
    return read_listing(spark, root + LIB_ROOT, strip_prefix=local).select("path", "file_size")


@register("listed_files_pushed")
def listed_files_pushed(spark, sf_dir):
    """SRC-1: a folder's files of one extension, both pushed down to the listing."""
    fx = fixtures(spark, sf_dir)
    root = stage_media_tree(spark, fx)
    local = root[len("file:") :] if root.startswith("file:") else root
    listing = read_listing(spark, root + LIB_ROOT, strip_prefix=local)
    return listing.where(F.col("path").startswith(LIB_ROOT + "/src1/") & F.col("path").endswith(".mov")).select("path", "file_size")


@register("trackers_from_disk")
def trackers_from_disk(spark, sf_dir):
    """SRC-8: conversion tracker files read back as (backup_path, output_path)."""
    fx = fixtures(spark, sf_dir)
    root = stage_media_tree(spark, fx)
    return read_trackers(spark, root + LIB_ROOT, strip_prefix=root)


@register("ledger_roundtrip")
def ledger_roundtrip(spark, sf_dir):
    """SNK-1 + SRC-3: the index run's ledger written as a versioned snapshot and read back."""
    root = scratch_path(spark, "ledger")
    SN.write_ledger(_index(spark, sf_dir).ledger, root)
    return SN.read_ledger(spark, root)


@register("trash_set_roundtrip")
def trash_set_roundtrip(spark, sf_dir):
    """SNK-2 + SRC-6: trash set after a sync, written and read back."""
    fx = fixtures(spark, sf_dir)
    root = scratch_path(spark, "trash")
    SN.write_trash_set(trash_sync(fx.trash_pages, fx.trash).trash, root)
    return SN.read_trash_snapshot(spark, root)


@register("archive_roundtrip")
def archive_roundtrip(spark, sf_dir):
    """SNK-3: imported files written to the archive partitioned by date directory."""
    root = scratch_path(spark, "archive")
    SN.write_archive(_import(spark, sf_dir).archive, root)
    return SN.read_snapshot(spark, root).select(
        "path", "dest", "created", "tags", "file_size", "mtime_ticks", "sha256", F.col("date_dir").cast("string").alias("date_dir")
    )


@register("archive_contents")
def archive_contents(spark, sf_dir):
    """SNK-3: the bytes of the imported files, copied to the archive and hashed there."""
    fx = fixtures(spark, sf_dir)
    source, target = stage_media_tree(spark, fx), scratch_path(spark, "archive-files")
    copied = SN.copy_contents(_import(spark, sf_dir).archive, source, target)
    landed = hash_files(copied.select(F.concat(F.lit("/"), "dest").alias("path")), target)
    return copied.join(landed.select(F.substring("path", 2, 1 << 30).alias("dest"), F.col("sha256").alias("landed_sha256")), "dest").select(
        "path", "dest", "copied_bytes", "landed_sha256"
    )


@register("plan_roundtrip")
def plan_roundtrip(spark, sf_dir):
    """SNK-4: the undo plan written partitioned by action and read back."""
    fx = fixtures(spark, sf_dir)
    root = scratch_path(spark, "plan")
    plan = SN.with_sequence(undo_run(fx.backup_listing, fx.trackers).plan, ["base", "action", "path"])
    SN.write_plan(plan, root)
    return SN.read_snapshot(spark, root).select("seq", "base", "action", "path", "target", "counted")


def _staged_hasher(spark, fx):
    return file_hasher(stage_media_tree(spark, fx))


@register("index_outcomes_hashed")
def index_outcomes_hashed(spark, sf_dir):
    """PLN-1 + SRC-2: index outcomes with the files' own bytes hashed."""
    fx = fixtures(spark, sf_dir)
    return index_run(_listing(fx), fx.ledger, _staged_hasher(spark, fx)).outcomes


@register("index_ledger_hashed")
def index_ledger_hashed(spark, sf_dir):
    """PLN-1 + SRC-2: the next ledger with the files' own bytes hashed, ticks exact."""
    fx = fixtures(spark, sf_dir)
    return index_run(_listing(fx), fx.ledger, _staged_hasher(spark, fx)).ledger


@register("import_plan_hashed")
def import_plan_hashed(spark, sf_dir):
    """PLN-2 + SRC-2: the import plan with the files' own bytes hashed."""
    return _import(spark, sf_dir, _staged_hasher).plan


@register("verify_ledger_hashed")
def verify_ledger_hashed(spark, sf_dir):
    """PLN-6 + SRC-2: the verify ledger with the files' own bytes hashed."""
    return _verify(spark, sf_dir, _staged_hasher).ledger


@register("resolved_hashes")
def resolved_hashes(spark, sf_dir):
    """JN-1: stored hashes reused where size and mtime are unchanged, the others computed."""
    fx = fixtures(spark, sf_dir)
    return led.resolve_hashes(_listing(fx), fx.ledger, led.table_hasher(_hashes(fx))).select("path", "sha256", "sha1")


@register("verify_pending")
def verify_pending(spark, sf_dir):
    """FLT-4: indexed files that still need verifying."""
    return pending(_index(spark, sf_dir).outcomes, reprocess=False).select("path", "status")


@register("destinations")
def destinations(spark, sf_dir):
    """COL-16: the archive path of every file with a date in its path."""
    dated = materialize(D.with_dates(_listing(fixtures(spark, sf_dir)), AS_OF_YEAR).select("path", "created_date"))
    return dated.filter(F.col("created_date").isNotNull()).select("path", TG.destination(F.col("created_date"), N.name_of(F.col("path")), TG.DEFAULT_DATE_FORMAT, "").alias("dest"))


@register("names_with_line_breaks")
def names_with_line_breaks(spark, sf_dir):
    """FLT-1: directory, name, extension and stem of paths with a line break in each part."""
    broken = F.regexp_replace("path", "([aeiou])", "$1\n")
    return N.with_names(_listing(fixtures(spark, sf_dir)).select(broken.alias("path")))


@register("metadata_malformed")
def metadata_malformed(spark, sf_dir):
    """SRC-4: documents cut short, wrapped, or no JSON at all are not ok."""
    doc, kind = F.col("meta_json"), F.length("path") % 4
    docs = fixtures(spark, sf_dir).media_meta.select(
        "path",
        F.when(kind == 0, F.expr("substring(meta_json, 1, length(meta_json) - 3)"))
        .when(kind == 1, F.concat(F.lit("garbage "), doc))
        .when(kind == 2, F.concat(F.lit("[\n"), doc, F.lit("\n]\n")))
        .otherwise(doc)
        .alias("meta_json"),
    )
    return M.with_metadata(docs).select("path", "meta_ok", "meta_ext")


def _with_empty_page(spark, sf_dir):
    items = fixtures(spark, sf_dir).trash_pages
    gone = F.col("page") == 2
    return items.select(*[c if c in ("page", "next_page") else F.when(~gone, F.col(c)).alias(c) for c in items.columns])


@register("trash_pages_to_empty")
def trash_pages_to_empty(spark, sf_dir):
    """SRC-5 + PLN-7: the walk over the feed ends at a page without items."""
    return visited_pages(_with_empty_page(spark, sf_dir))


@register("trash_sync_streamed")
def trash_sync_streamed(spark, sf_dir):
    """PLN-7 + SRC-5 as a stream: the visited pages land in three batches and
    are folded into the trash set, with state by content hash."""
    fx = fixtures(spark, sf_dir)
    pages = materialize(_landed_pages(fx).join(visited_pages(fx.trash_pages), "page", "left_semi"))
    root = scratch_path(spark, "feed-stream")
    last = pages.agg(F.max("page")).first()[0]
    for i in range(3):
        pages.where((F.col("page") - 1) * 3 >= i * last).where((F.col("page") - 1) * 3 < (i + 1) * last).coalesce(1).write.parquet(f"{root}/in/b{i}")
        trash_stream(spark, root + "/in/*", fx.trash, root + "/added", root + "/ckpt")
    return trash_after(fx.trash, read_added(spark, root + "/added"))


@register("stream_index_two_runs")
def stream_index_two_runs(spark, sf_dir):
    """STR-1: two streams in turn, each with a checkpoint of its own, over one ledger."""
    fx = fixtures(spark, sf_dir)
    listing_dir, ledger_root = scratch_path(spark, "listing-runs"), scratch_path(spark, "runs-ledger")
    listing = fx.media_files.select("path", "file_size", "mtime_ticks", (F.col("doc_id") % 2).alias("part"))
    start_ledger(fx.ledger, ledger_root)
    for i in range(2):
        listing.filter(F.col("part") == i).drop("part").write.parquet(f"{listing_dir}/{i}/in")
        stream_index(spark, f"{listing_dir}/{i}/in", ledger_root, led.table_hasher(_hashes(fx)), files_per_batch=None)
    return SN.read_ledger(spark, ledger_root)


@register("stream_index_ledger")
def stream_index_ledger(spark, sf_dir):
    """STR-1: listing files arriving as a stream, indexed batch by batch into
    ledger versions; returns the final ledger."""
    fx = fixtures(spark, sf_dir)
    listing_dir = scratch_path(spark, "listing-stream")
    listing = fx.media_files.select("path", "file_size", "mtime_ticks", (F.col("doc_id") % 4).alias("part"))
    listing.write.partitionBy("part").parquet(listing_dir + "/staged")
    ledger_root, checkpoint = scratch_path(spark, "stream-ledger"), scratch_path(spark, "stream-ckpt")
    start_ledger(fx.ledger, ledger_root)
    # four listings arrive one after the other, each of as many files as tasks write; each is a batch
    for i in range(4):
        spark.read.parquet(f"{listing_dir}/staged/part={i}").write.parquet(f"{listing_dir}/in/batch-{i}")
        stream_index(spark, listing_dir + "/in/*", ledger_root, led.table_hasher(_hashes(fx)), files_per_batch=None, checkpoint_location=checkpoint)
    return SN.read_ledger(spark, ledger_root)


def _keyed_stream(spark, sf_dir):
    """The listing as a stream of four parts, indexed with state by path: (starting ledger, log)."""
    fx = fixtures(spark, sf_dir)
    listing_dir = scratch_path(spark, "listing-keyed")
    listing = fx.media_files.select("path", "file_size", "mtime_ticks", (F.col("doc_id") % 4).alias("part"))
    listing.write.partitionBy("part").parquet(listing_dir + "/staged")
    log, checkpoint = scratch_path(spark, "keyed-log"), scratch_path(spark, "keyed-ckpt")
    for i in range(4):
        spark.read.parquet(f"{listing_dir}/staged/part={i}").write.parquet(f"{listing_dir}/in/batch-{i}")
        # each part, of as many files as tasks write, is a batch; all runs over one checkpoint
        keyed_index(spark, listing_dir + "/in/*", fx.ledger, log, checkpoint, hashes=_hashes(fx))
    return fx.ledger, read_log(spark, log)


@register("stream_index_keyed")
def stream_index_keyed(spark, sf_dir):
    """STR-1 with state by path: the ledger after the stream."""
    return ledger_after(*_keyed_stream(spark, sf_dir))


@register("stream_index_keyed_outcomes")
def stream_index_keyed_outcomes(spark, sf_dir):
    """STR-1 with state by path: the outcomes that the stream logged."""
    return _keyed_stream(spark, sf_dir)[1].select("path", "status", "was_processed")


# ------------------------------------------------------------ ledger merges, report


@register("skipped_extensions")
def skipped_extensions_q(spark, sf_dir):
    """AGG-2: unsupported extensions (case-folded) and their file counts."""
    df = N.with_names(_listing(fixtures(spark, sf_dir)))
    return skipped_extensions(df)


def _computed(fx):
    """Listing rows with freshly computed hashes (size/mtime from the listing)."""
    return fx.media_files.select("path", "sha256", "sha1", "file_size", "mtime_ticks", F.lit(False).alias("is_processed"))


@register("ledger_insert_or_ignore")
def ledger_insert_or_ignore(spark, sf_dir):
    """MUT-1: add listing rows for unknown paths; an existing path wins."""
    fx = fixtures(spark, sf_dir)
    return led.insert_or_ignore(fx.ledger, _computed(fx))


@register("ledger_update_hashes")
def ledger_update_hashes(spark, sf_dir):
    """MUT-2: set hashes, size and mtime from the listing and reset the processed flag."""
    fx = fixtures(spark, sf_dir)
    return led.update_hashes(fx.ledger, _computed(fx))


@register("ledger_update_metadata")
def ledger_update_metadata(spark, sf_dir):
    """MUT-3: set sha1, size and mtime; keep sha256 and the processed flag."""
    fx = fixtures(spark, sf_dir)
    return led.update_metadata(fx.ledger, _computed(fx))


def _verified_paths(fx) -> DataFrame:
    verified = parse_verdict_lines(fx.verdict_lines).filter("ok")
    return verified.select(F.concat(F.lit(LIB_ROOT), F.substring("path", len(MEDIA_ROOT) + 1, 1 << 30)).alias("path"))


@register("ledger_set_processed")
def ledger_set_processed(spark, sf_dir):
    """MUT-4: flag the ledger rows of verified files."""
    fx = fixtures(spark, sf_dir)
    return led.set_processed(fx.ledger, _verified_paths(fx))


@register("ledger_delete_trashed")
def ledger_delete_trashed(spark, sf_dir):
    """MUT-5: drop ledger rows whose content is in the trash set."""
    fx = fixtures(spark, sf_dir)
    gone = flag_member(fx.ledger.select("path", "sha1"), fx.trash, "sha1", "sha1", "t").filter("t")
    return led.delete_by_path(fx.ledger, gone)


def _merged_in_part(spark, fx, changes, merge):
    root = scratch_path(spark, "ledger-parts")
    write_partitioned_ledger(fx.ledger, root, 32)
    merge_ledger(spark, root, changes, merge)
    return read_partitioned_ledger(spark, root)


@register("ledger_insert_in_part")
def ledger_insert_in_part(spark, sf_dir):
    """MUT-1 + SNK-1 on a partitioned ledger: only the touched partitions are replaced."""
    fx = fixtures(spark, sf_dir)
    return _merged_in_part(spark, fx, _computed(fx), led.insert_or_ignore)


@register("ledger_hashes_in_part")
def ledger_hashes_in_part(spark, sf_dir):
    """MUT-2 + SNK-1 on a partitioned ledger."""
    fx = fixtures(spark, sf_dir)
    return _merged_in_part(spark, fx, _computed(fx), led.update_hashes)


@register("ledger_metadata_in_part")
def ledger_metadata_in_part(spark, sf_dir):
    """MUT-3 + SNK-1 on a partitioned ledger."""
    fx = fixtures(spark, sf_dir)
    return _merged_in_part(spark, fx, _computed(fx), led.update_metadata)


@register("ledger_processed_in_part")
def ledger_processed_in_part(spark, sf_dir):
    """MUT-4 + SNK-1 on a partitioned ledger."""
    fx = fixtures(spark, sf_dir)
    return _merged_in_part(spark, fx, _verified_paths(fx), led.set_processed)


@register("ledger_delete_in_part")
def ledger_delete_in_part(spark, sf_dir):
    """MUT-5 + SNK-1 on a partitioned ledger."""
    fx = fixtures(spark, sf_dir)
    gone = flag_member(fx.ledger.select("path", "sha1"), fx.trash, "sha1", "sha1", "t").filter("t")
    return _merged_in_part(spark, fx, gone, led.delete_by_path)


@register("stream_index_merged_in_part")
def stream_index_merged_in_part(spark, sf_dir):
    """STR-1 with state by path, its changes merged into a partitioned ledger."""
    ledger, log = _keyed_stream(spark, sf_dir)
    root = scratch_path(spark, "ledger-parts")
    write_partitioned_ledger(ledger, root, 32)
    merge_ledger(spark, root, changes_of(log), apply_changes)
    return read_partitioned_ledger(spark, root)


def _landed(spark, name):
    return lambda df: SN.write_snapshot(df, scratch_path(spark, name))


@register("index_summary_observed")
def index_summary_observed(spark, sf_dir):
    """AGG-1 over PLN-1, counted while the outcomes are written."""
    return observed_summary(_index(spark, sf_dir).outcomes, "index", _landed(spark, "index-outcomes"), "status")


@register("import_summary_observed")
def import_summary_observed(spark, sf_dir):
    """AGG-1 over PLN-2, counted while the plan is written."""
    return observed_summary(_import(spark, sf_dir).plan, "import", _landed(spark, "import-plan"))


@register("verify_summary_observed")
def verify_summary_observed(spark, sf_dir):
    """AGG-1 for verify, counted while the outcomes are written."""
    return observed_summary(_verify(spark, sf_dir).outcomes, "verify", _landed(spark, "verify-outcomes"))


@register("process_first_round")
def process_first_round(spark, sf_dir):
    """PLN-3: the rule list applied once: every file's rule and the name it asks for."""
    fx = fixtures(spark, sf_dir)
    return process_decisions(
        _listing(fx), fx.media_meta, _probe(fx), ledger=fx.ledger, trash=fx.trash, hasher=led.table_hasher(_hashes(fx))
    )


@register("process_listing")
def process_listing(spark, sf_dir):
    """PLN-3: every file's name once the clean-up plan is carried out."""
    return _process(spark, sf_dir).listing


@register("trash_rebuilt")
def trash_rebuilt(spark, sf_dir):
    """MUT-7 + PLN-7: clear the trash set, then rebuild it from the feed."""
    from .plans.trash_sync import clear_trash

    fx = fixtures(spark, sf_dir)
    return trash_sync(fx.trash_pages, clear_trash(fx.trash)).trash
