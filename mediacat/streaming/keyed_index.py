"""STR-1 with state by key: an incremental index whose cost follows the change.

Every path is a key whose last indexed row is Spark's keyed state (RocksDB,
checkpointed as changes of each batch). A listing row is compared with its
path's state alone, so no batch reads or rewrites the ledger; the ledger the
stream starts from is loaded into the state once, with the first batch.

The stream appends to a log of what it did, one row per listing row, through
Spark's exactly-once file sink: a replayed batch adds nothing. The ledger
after the stream is the starting ledger with the last logged change of each path
(:func:`ledger_after`), to be merged into the ledger whenever one likes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.names import ext_of, is_supported, name_of
from ..schemas import LEDGER_COLUMNS
from ..sources.files import file_digests
from .stream_index import listing_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = "sha256 string, sha1 string, file_size long, mtime_ticks long, is_processed boolean, version long"
LOG = f"path string, status string, was_processed boolean, changed boolean, {_STATE}"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class IndexProcessor(StatefulProcessor):
    """The index rules (PLN-1) for the rows of one path, in order of time and size."""

    def __init__(self, prefix: str | None, mark_processed: bool, rehash: bool):
        self.prefix, self.mark_processed, self.rehash = prefix, mark_processed, rehash

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("row", _STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.known.update((r.sha256, r.sha1, r.file_size, r.mtime_ticks, r.is_processed, 0))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        path = key[0]
        for r in sorted(rows, key=lambda r: (r.mtime_ticks or 0, r.file_size or 0)):
            if not r.supported:
                yield self._logged(path, "Ignored", None, False, None)
                continue
            known = self.known.get()  # None where there is none; each call of the state is a round trip
            same = known is not None and None not in (r.file_size, r.mtime_ticks) and (r.file_size, r.mtime_ticks) == (known[2], known[3])
            if same and not self.rehash:
                sha256, sha1 = known[0], known[1]
            else:
                sha256, sha1 = file_digests(self.prefix + path) if self.prefix is not None else (r.sha256, r.sha1)
            if sha256 is None:
                yield self._logged(path, "Failed", None, False, None)
                continue
            if known is None:
                status, processed = "Inserted", self.mark_processed
            elif sha256 != known[0]:
                status, processed = "Updated", False
            else:
                processed = known[4]
                status = "Unchanged" if same or processed else "Updated"
            row = (sha256, sha1, r.file_size, r.mtime_ticks, processed)
            changed = known is None or row != tuple(known[:5])
            version = (0 if known is None else known[5]) + 1
            if changed:
                self.known.update((*row, version))
            yield self._logged(path, status, processed, changed, (*row, version))

    @staticmethod
    def _logged(path, status, processed, changed, row) -> Row:
        sha256, sha1, size, ticks, flag, version = row if row is not None else (None,) * 6
        return Row(
            path=path, status=status, was_processed=processed, changed=changed, sha256=sha256, sha1=sha1, file_size=size, mtime_ticks=ticks,
            is_processed=flag, version=version,
        )

    def close(self) -> None:
        pass


def keyed_index(
    spark: SparkSession, listing_dir: str, ledger: DataFrame, log_root: str, checkpoint: str, prefix: str | None = None, hashes: DataFrame | None = None,
    mark_processed: bool = False, rehash: bool = False, files_per_batch: int | None = None,
) -> None:
    """Index the listing files that are present now and not yet consumed,
    and log the outcomes at ``log_root``.

    ``prefix``: paths below it are opened and hashed where size or time
    changed; else ``hashes`` (path, sha256, sha1) has the hashes. ``ledger``
    counts only while the checkpoint is new; afterwards the state goes on.
    Paths listed twice in a batch are taken in order of time. A row without a
    path is not a file and is left out.

    The files that are present are one batch, unless ``files_per_batch`` says
    how many are: each batch opens the state of all partitions and joins
    ``hashes`` anew, so many small ones cost far more than their rows."""
    if (prefix is None) == (hashes is None):
        raise ValueError("hashes come either from the files below a prefix or from a table")
    listed = listing_stream(spark, listing_dir, files_per_batch).where("path IS NOT NULL")
    listed = listed.withColumn("supported", is_supported(ext_of(name_of(F.col("path")))))
    if hashes is not None:
        listed = listed.join(hashes.select("path", "sha256", "sha1"), "path", "left")
    start = ledger.select(*LEDGER_COLUMNS).where("path IS NOT NULL").groupBy("path")
    log = listed.groupBy("path").transformWithState(
        statefulProcessor=IndexProcessor(prefix, mark_processed, rehash), outputStructType=LOG, outputMode="Append", timeMode="None", initialState=start
    )
    with rocksdb_state(spark):
        writer = log.writeStream.format("parquet").outputMode("append").option("path", log_root).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, log_root: str) -> DataFrame:
    """What the streams into ``log_root`` did, whole batches only."""
    return spark.read.schema(LOG).parquet(log_root)


def changes_of(log: DataFrame) -> DataFrame:
    """The last logged row of each path that changed."""
    row = F.struct("version", *[c for c in LEDGER_COLUMNS if c != "path"])
    last = log.where("changed").groupBy("path").agg(F.max(row).alias("r"))
    return last.select("path", *[F.col("r").getField(c).alias(c) for c in LEDGER_COLUMNS if c != "path"])


def ledger_after(ledger: DataFrame, log: DataFrame) -> DataFrame:
    """The ledger the log started from, with its changes."""
    return apply_changes(ledger, changes_of(log))


def apply_changes(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """``ledger`` with the rows of ``changes`` (whole ledger rows, one for a path)
    in place of those of the same path; a merge of ledger rows."""
    return ledger.select(*LEDGER_COLUMNS).join(changes.select("path"), "path", "left_anti").unionByName(changes.select(*LEDGER_COLUMNS))
