"""PLN-7 over a stream of landed feed pages, with state by content hash.

A fetcher lands the pages it visits, in the order of its requests, and stops
where the feed stops. Every SHA-1 is a key: the first trashed asset that has
it, by page and place in the page, is added to the trash set, all later ones are
known. The trash set the stream starts from is loaded into the state once,
with the first batch; no batch reads it. The added rows go to Spark's
exactly-once file sink, so a replayed batch adds nothing, and a page that is
landed again neither.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.trash_sync import trashed_items
from ..sources.trash_feed import parse_feed_pages
from .keyed_index import rocksdb_state

PAGES = "page long, body string"
ADDED = "sha1 string, original_file_name string, page long"


class FirstTrashed(StatefulProcessor):
    """One row for each hash: the first asset that has it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.page, r.item_no))
        if not self.known.exists():
            self.known.update((True,))
            yield Row(sha1=key[0], original_file_name=first.original_file_name, page=first.page)

    def close(self) -> None:
        pass


def trash_stream(spark: SparkSession, pages_dir: str, trash: DataFrame, added_root: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Fold the page files (``page``, ``body``) that are present now and not
    yet consumed into the rows added at ``added_root``. ``trash`` counts only
    while the checkpoint is new; afterwards the state goes on."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(pages_dir)
    items = trashed_items(parse_feed_pages(pages)).select("sha1", "page", "item_no", "original_file_name")
    added = items.groupBy("sha1").transformWithState(
        statefulProcessor=FirstTrashed(), outputStructType=ADDED, outputMode="Append", timeMode="None", initialState=trash.select("sha1").distinct().groupBy("sha1")
    )
    with rocksdb_state(spark):
        writer = added.writeStream.format("parquet").outputMode("append").option("path", added_root).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()


def trash_after(trash: DataFrame, added: DataFrame) -> DataFrame:
    """The trash set the stream started from, with what it added."""
    return trash.select("sha1", "original_file_name").unionByName(added.select("sha1", "original_file_name"))


def read_added(spark: SparkSession, added_root: str) -> DataFrame:
    return spark.read.schema(ADDED).parquet(added_root)
