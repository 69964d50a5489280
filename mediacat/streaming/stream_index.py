"""STR-1 incremental index over a stream of listing files.

Each micro-batch of newly arrived listing rows goes through the index run
(PLN-1) against the current ledger version and lands the next version. The
state lives in the ledger itself, so there is no watermark. Each version is
tagged with the stream that wrote it (the id that Spark keeps in the
stream's checkpoint) and its batch, so a batch that is replayed after its
version became current is known by its tag and skipped; how many versions
the ledger has, and who wrote them, does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.materialize import landing
from ..plans.index import index_run
from ..schemas import FILES
from ..session import scratch_path
from ..sinks.snapshots import current_tag, current_version, read_ledger, write_ledger, write_snapshot


def listing_stream(spark: SparkSession, listing_dir: str, files_per_batch: int | None) -> DataFrame:
    """Landed listing files as a stream, so many in a batch; ``None``: all that
    are present (a listing has as many files as tasks wrote it)."""
    reader = spark.readStream.schema(FILES)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(listing_dir)


def stream_index(
    spark: SparkSession,
    listing_dir: str,
    ledger_root: str,
    hasher,
    mark_processed: bool = False,
    files_per_batch: int | None = 1,
    checkpoint_location: str | None = None,
    outcomes_root: str | None = None,
) -> None:
    """Run the stream until every listing file present now is consumed.

    Every batch merges with the whole ledger and lands a version of it. So where
    a listing has many files, say ``None``: all that are present are one batch."""
    source = listing_stream(spark, listing_dir, files_per_batch)
    checkpoint = checkpoint_location or scratch_path(spark, "stream-index-ckpt")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        metadata = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata")
        tag = f"{metadata.first()['id']} {batch_id}"
        if current_tag(spark, ledger_root) == tag:
            return  # replay of a committed batch
        with landing(spark):
            result = index_run(batch, read_ledger(spark, ledger_root), hasher, mark_processed=mark_processed)
            target = current_version(spark, ledger_root) + 1
            if outcomes_root is not None:
                write_snapshot(result.outcomes, outcomes_root, version=target, tag=tag)
            write_snapshot(result.ledger, ledger_root, version=target, tag=tag)

    query = (
        source.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def start_ledger(ledger: DataFrame, ledger_root: str) -> None:
    """Land the starting ledger as version 0."""
    write_ledger(ledger, ledger_root)
