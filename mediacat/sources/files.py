"""File listing and content hashing (SRC-1, SRC-2), tracker files (SRC-8).

The listing reads only file metadata (no byte of content). Hashing is a separate
executor-side step over the rows that need it (after the ledger join), so
unchanged files are never opened. Each task streams its files through
SHA-256 and SHA-1 in one pass with 80 KiB reads via ``pyarrow.fs``, which
opens local, HDFS or object-store URIs alike and has no size limit (the
binaryFile ``content`` column stops at 2 GiB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import materialize
from ..operators.ranking import group_running_sums

TICKS_AT_UNIX_EPOCH = 621355968000000000  # 100-ns ticks from 0001-01-01 to 1970-01-01
READ_CHUNK = 80 * 1024


def fs_and_path(uri: str):
    if uri.startswith("file:") or "://" not in uri:
        local = uri[len("file:") :] if uri.startswith("file:") else uri
        return fs.LocalFileSystem(), "/" + local.lstrip("/")
    return fs.FileSystem.from_uri(quote(uri, safe=":/@"))


def _ticks(info) -> int | None:
    ns = info.mtime_ns
    return None if ns is None else ns // 100 + TICKS_AT_UNIX_EPOCH


LISTING_FRAME = 10_000  # directory entries handed to Spark at a time
_ENTRY = pa.schema([("path", pa.string()), ("file_size", pa.int64()), ("mtime_ticks", pa.int64()), ("is_dir", pa.bool_())])


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The direct children of each directory, in frames of bounded size."""
    for batch in batches:
        for directory in batch.column(0).to_pylist():
            filesystem, base = fs_and_path(directory)
            rows = []
            for info in filesystem.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                is_dir = info.type == fs.FileType.Directory
                path = directory.rstrip("/") + "/" + info.path[len(base.rstrip("/")) :].lstrip("/")
                rows.append((path, None if is_dir else info.size, None if is_dir else _ticks(info), is_dir))
                if len(rows) == LISTING_FRAME:
                    yield _entry_batch(rows)
                    rows = []
            if rows:
                yield _entry_batch(rows)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY.types)], schema=_ENTRY)


def list_files(spark: SparkSession, root: str, strip_prefix: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """SRC-1: every file below ``root`` (recursive, empty and hidden files
    included) -> path, file_size, mtime_ticks (100-ns ticks, exact).

    The tree is listed level by level: the directories found on one level
    are spread over the executors, each lists its own children through
    ``pyarrow.fs`` (local, HDFS and object stores), and the level is written
    as a table. A deep or lopsided tree is thus never walked by one task; as
    many rounds as the tree is deep. File scans are not used for the listing
    because they skip zero-length files, which matter here (empty backups).
    With ``strip_prefix`` paths are made relative to that prefix."""
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root_local = root[len("file:") :] if root.startswith("file:") else root
    frontier = spark.range(1).select(F.lit(root_local.rstrip("/") or "/").alias("path"))
    df = None
    while True:
        level = materialize(frontier.mapInArrow(_list_directories, "path string, file_size long, mtime_ticks long, is_dir boolean"))
        files = level.filter(~F.col("is_dir")).drop("is_dir")
        df = files if df is None else df.unionByName(files)
        frontier = level.filter("is_dir").select("path").repartition(n)
        if level.filter("is_dir").isEmpty():
            break
    if strip_prefix is not None:
        sp = strip_prefix[len("file:") :] if strip_prefix.startswith("file:") else strip_prefix
        df = df.withColumn(
            "path", F.when(F.col("path").startswith(sp), F.substring("path", len(sp) + 1, 1 << 30)).otherwise(F.col("path"))
        )
    return df


def file_digests(uri: str) -> tuple[str, str] | tuple[None, None]:
    """SHA-256 and SHA-1 of a file's bytes in one pass; nulls where it cannot
    be read (the caller reports Failed, never Invalid)."""
    h256, h1 = hashlib.sha256(), hashlib.sha1()
    try:
        filesystem, local = fs_and_path(uri)
        with filesystem.open_input_stream(local, compression=None) as stream:
            while chunk := stream.read(READ_CHUNK):
                h256.update(chunk)
                h1.update(chunk)
    except (OSError, ValueError):
        return None, None
    return h256.hexdigest(), h1.hexdigest()


OPEN_COST = 64 * 1024  # bytes that opening a file counts for


def dealt_by_bytes(files: DataFrame, n: int) -> DataFrame:
    """``files`` in ``n`` partitions of about as many bytes to read
    (``file_size``, and ``OPEN_COST`` for each file): the rows are laid out one
    after the other by path, and each goes to the n-th part of the whole that
    its middle falls into. A part is larger than its share by a file at most."""
    cost = F.greatest(F.coalesce(F.col("file_size"), F.lit(0)), F.lit(0)).cast("long") + OPEN_COST
    files = files.withColumn("_cost", cost)
    total = files.agg(F.sum("_cost")).first()[0]
    if total is None:
        return files.drop("_cost")
    laid = group_running_sums(files, [], ["path"], {"_to": F.col("_cost")})
    middle = (F.col("_to") - F.col("_cost") / 2) / F.lit(total)
    task = F.least(F.floor(middle * n), F.lit(n - 1)).cast("int")
    return laid.withColumn("_task", task).repartitionById(n, "_task").drop("_task", "_cost", "_to")


def file_hasher(prefix: str = ""):
    """SRC-2 as a hasher (see :data:`mediacat.operators.ledger.Hasher`):
    streams ``prefix + path`` through both digests where ``need`` is true.

    The rows are written once; only those with ``need`` go to Python, as
    Arrow batches whose other columns pass through bit by bit (a null never
    turns a long into a double), spread over the tasks by their bytes where
    ``file_size`` tells them, else by their number. The rest
    never leaves the JVM and no file of theirs is opened."""

    def run(df: DataFrame, need) -> DataFrame:
        rows = materialize(df.withColumn("_need", F.coalesce(need, F.lit(False))))
        at = df.columns.index("path")
        digests = [T.StructField("c_sha256", T.StringType()), T.StructField("c_sha1", T.StringType())]
        schema = T.StructType([*rows.drop("_need").schema.fields, *digests])

        def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(None, None) if p is None else file_digests(prefix + p) for p in batch.column(at).to_pylist()]
                new = [pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        todo = rows.filter("_need").drop("_need")
        todo = dealt_by_bytes(todo, n) if "file_size" in df.columns else todo.repartition(n)
        hashed = todo.mapInArrow(hash_batches, schema)
        known = rows.filter("NOT _need").drop("_need")
        return hashed.unionByName(known.withColumns({f.name: F.lit(None).cast("string") for f in digests}))

    return run


def hash_files(files: DataFrame, prefix: str = "") -> DataFrame:
    """SRC-2: path -> path, sha256, sha1 for every row."""
    known = [c for c in ("path", "file_size") if c in files.columns]
    out = file_hasher(prefix)(files.select(*known), F.lit(True))
    return out.select("path", F.col("c_sha256").alias("sha256"), F.col("c_sha1").alias("sha1"))


def _text(uri: str) -> str:
    """A file's whole text as UTF-8, malformed bytes replaced."""
    filesystem, local = fs_and_path(uri)
    with filesystem.open_input_stream(local, compression=None) as stream:
        return stream.read().decode("utf-8", "replace")


def read_trackers(spark: SparkSession, root: str, strip_prefix: str | None = None) -> DataFrame:
    """SRC-8: conversion trackers ``<backup>.out`` -> backup_path,
    output_path (trimmed file text), hidden files and folders included. The
    paths are those of :func:`list_files`, as file scans skip hidden names;
    a tracker that cannot be read fails the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([_text(p) for p in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["path", "value"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = list_files(spark, root).select("path").where(F.col("path").endswith(".out"))
    df = paths.repartition(n).mapInArrow(read, "path string, value string")
    fp = F.col("path")
    if strip_prefix is not None:
        sp = strip_prefix[len("file:") :] if strip_prefix.startswith("file:") else strip_prefix
        fp = F.when(fp.startswith(sp), F.substring(fp, len(sp) + 1, 1 << 30)).otherwise(fp)
    return df.select(
        F.regexp_replace(fp, r"\.out\z", "").alias("backup_path"),
        F.regexp_replace(F.col("value"), r"^\s+|\s+\z", "").alias("output_path"),
    )
