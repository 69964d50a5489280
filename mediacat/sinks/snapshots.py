"""Sinks (SNK-1..4) and the ledger / trash-set readers (SRC-3, SRC-6).

A table is a directory of immutable versions ``<root>/v=<n>``; a write
lands a whole new version and then the ``_CURRENT`` pointer file is
replaced by one overwriting rename, so there is always a pointer, a reader never sees a half-written snapshot and a job never
overwrites the path it is reading. Old versions stay until pruned.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from ..operators.ranking import group_ordinal
from ..schemas import LEDGER, LEDGER_COLUMNS, TRASH, assert_columns
from ..sources.files import READ_CHUNK, fs_and_path

POINTER = "_CURRENT"


def _jvm_fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path.getFileSystem(conf), path


def _pointer(spark: SparkSession, root: str) -> list[str]:
    """The pointer's lines: the current version and the tag it was written
    with, if any; empty without a table."""
    jvm, fs, base = _jvm_fs(spark, root)
    ptr = jvm.org.apache.hadoop.fs.Path(base, POINTER)
    if not fs.exists(ptr):
        return []
    stream = fs.open(ptr)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream))
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line.strip())
        return lines
    finally:
        stream.close()


def current_version(spark: SparkSession, root: str) -> int | None:
    lines = _pointer(spark, root)
    return int(lines[0]) if lines else None


def current_tag(spark: SparkSession, root: str) -> str | None:
    """The tag of the current version: what the writer said it holds."""
    lines = _pointer(spark, root)
    return lines[1] if len(lines) > 1 else None


def _set_version(spark: SparkSession, root: str, version: int, tag: str | None) -> None:
    jvm, fs, base = _jvm_fs(spark, root)
    tmp = jvm.org.apache.hadoop.fs.Path(base, f"{POINTER}.{version}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray((f"{version}\n" + (f"{tag}\n" if tag else "")).encode()))
    out.close()
    ptr = jvm.org.apache.hadoop.fs.Path(base, POINTER)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(ptr), options)


def write_snapshot(
    df: DataFrame, root: str, partition_by: list[str] | None = None, version: int | None = None, tag: str | None = None
) -> int:
    """Write ``df`` as the next version (or the given one) of the table at
    ``root`` and point readers at it; returns the version. A version
    directory left by a failed attempt is replaced; it was never current."""
    spark = df.sparkSession
    cur = current_version(spark, root)
    if version is None:
        version = 0 if cur is None else cur + 1
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{root.rstrip('/')}/v={version}")
    _set_version(spark, root, version, tag)
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    v = current_version(spark, root) if version is None else version
    if v is None:
        raise FileNotFoundError(f"no snapshot at {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/v={v}")


def write_ledger(df: DataFrame, root: str) -> int:
    """SNK-1: persist a whole new ledger snapshot (unique path enforced by
    the merge operators that build it)."""
    return write_snapshot(df.select(*LEDGER_COLUMNS), root)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """SRC-3: current ledger snapshot; a missing table or a table without
    the hash columns is an error."""
    df = read_snapshot(spark, root)
    assert_columns(df, LEDGER, "ledger")
    return df.select(*LEDGER_COLUMNS)


def write_trash_set(df: DataFrame, root: str) -> int:
    """SNK-2: next version of the (append-only) trash set."""
    return write_snapshot(df.select("sha1", "original_file_name"), root)


def read_trash_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """SRC-6 over a versioned trash set; missing -> ask for a trash sync."""
    try:
        df = read_snapshot(spark, root)
    except FileNotFoundError as e:
        raise FileNotFoundError(f"trash set not found at {root}: run the trash sync first") from e
    assert_columns(df, TRASH, "trash set")
    return df.select("sha1", "original_file_name")


ARCHIVE_ROWS = 2_000_000  # rows of one archive file, and of one task, at most


def write_archive(imported: DataFrame, root: str) -> int:
    """SNK-3: imported rows, with the source's modification time, hashes and
    the applied tags where they have them, land partitioned by their date
    directory (``date_dir`` = destination without the file name). Rows are
    dealt by directory first, a directory of very many rows over several
    tasks, so a directory gets few files and no task gets one whole."""
    df = imported.withColumn("date_dir", F.regexp_extract(F.col("dest"), r"(?s)^(.*)/", 1))
    df = materialize(df)
    parts = df.groupBy("date_dir").agg(F.ceil(F.count(F.lit(1)) / ARCHIVE_ROWS).alias("_parts"))
    df = df.join(parts, "date_dir").withColumn("_part", F.pmod(F.xxhash64("dest"), F.col("_parts")))
    return write_snapshot(df.repartition("date_dir", "_part").drop("_parts", "_part"), root, ["date_dir"])


def copy_contents(plan: DataFrame, source_prefix: str, archive_prefix: str) -> DataFrame:
    """SNK-3: the bytes of the imported files. Each row's ``path`` (below
    ``source_prefix``) is copied to its ``dest`` (below ``archive_prefix``)
    by a task, in pieces, under a name of its own that is then renamed, so a
    lost or repeated task never leaves half a file. Returns the written
    table path, dest, copied_bytes, sha256 (nulls where a file could not be
    read; the source's modification time is a column of the archive table)."""
    schema = "path string, dest string, copied_bytes long, sha256 string"

    def copy(batches):
        for batch in batches:
            rows = [(p, d, *_copy_file(source_prefix + p, archive_prefix.rstrip("/") + "/" + d.lstrip("/"))) for p, d in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "dest", "copied_bytes", "sha256"])

    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(plan.select("path", "dest").repartition(n).mapInArrow(copy, schema))


def _copy_file(source: str, target: str) -> tuple[int, str] | tuple[None, None]:
    digest, size = hashlib.sha256(), 0
    to, at = fs_and_path(target)
    partial = f"{at}.{uuid.uuid4().hex}.part"
    try:
        origin, start = fs_and_path(source)
        to.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with origin.open_input_stream(start, compression=None) as read, to.open_output_stream(partial, compression=None) as write:
            while chunk := read.read(READ_CHUNK):
                digest.update(chunk)
                size += len(chunk)
                write.write(chunk)
    except (OSError, ValueError):
        return None, None
    to.move(partial, at)
    return size, digest.hexdigest()


def with_sequence(plan: DataFrame, order: list[str]) -> DataFrame:
    """Execution order for a plan: ``seq`` numbers its rows from 1 by
    ``order``, without gaps (ranges of rows are numbered by different tasks)."""
    return group_ordinal(plan, [], order, name="seq")


def write_plan(plan: DataFrame, root: str) -> int:
    """SNK-4: an action plan (seq, action, path, target, ...) partitioned by action."""
    return write_snapshot(plan, root, ["action"])
