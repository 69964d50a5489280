"""A state ledger that is merged in part (SNK-1 with MUT-1..5).

The ledger lies in ``buckets`` partitions by a hash of the path, which is the
key of every merge. A merge reads the partitions that its rows fall into and
replaces these, by Spark's dynamic partition overwrite; all others are neither
read nor written, so a run costs what it changes and not what the history
holds.

A merge first lands its new rows under the checkpoint folder (it never
overwrites what it still reads). Partitions are replaced one by one: after a
lost job the same merge is run again, which ends in the same rows, as the
merges are idempotent. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.materialize import materialize
from ..schemas import LEDGER, LEDGER_COLUMNS

#: partitions of a new ledger; about 256 MB of ledger rows each is a good size
BUCKETS = 64

#: ``(ledger rows of the touched partitions, changes) -> their new rows``, as MUT-1..5
Merge = Callable[[DataFrame, DataFrame], DataFrame]

_LAYOUT = T.StructType([*LEDGER.fields, T.StructField("buckets", T.IntegerType()), T.StructField("bucket", T.IntegerType())])


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def write_partitioned_ledger(ledger: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Land a whole ledger, one file for each partition that has rows. The
    number of partitions is part of the layout (``buckets=<n>/bucket=<k>``)."""
    if buckets < 1:
        raise ValueError("a ledger has one partition at least")
    rows = ledger.select(*LEDGER_COLUMNS).withColumns({"buckets": F.lit(buckets), "bucket": bucket_of(F.col("path"), buckets)})
    rows.repartition("bucket").write.mode("error").partitionBy("buckets", "bucket").parquet(root)


def _layout(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The ledger's rows with their partition columns, and the number of partitions."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    found = [int(n.partition("=")[2]) for n in names if n.startswith("buckets=")]
    if len(found) != 1:
        raise FileNotFoundError(f"no partitioned ledger at {root}")
    return spark.read.schema(_LAYOUT).parquet(root), found[0]


def read_partitioned_ledger(spark: SparkSession, root: str) -> DataFrame:
    """SRC-3 over a partitioned ledger; a missing one is an error."""
    return _layout(spark, root)[0].select(*LEDGER_COLUMNS)


def touched_rows(spark: SparkSession, root: str, changes: DataFrame) -> tuple[DataFrame, list[int], int]:
    """The ledger rows of the partitions that the paths of ``changes`` fall
    into, these partitions, and how many there are in all. At most one number
    for each partition comes to the driver; the scan is pruned to them."""
    ledger, buckets = _layout(spark, root)
    numbers = changes.select(bucket_of(F.col("path"), buckets).alias("b")).distinct()
    touched = sorted(r.b for r in numbers.collect())
    return ledger.where(F.col("bucket").isin(touched)), touched, buckets


def merge_ledger(spark: SparkSession, root: str, changes: DataFrame, merge: Merge) -> list[int]:
    """Apply a merge to the partitions that ``changes`` (``path`` and what
    the merge needs) fall into, and return these. ``merge`` sees only their
    rows, which are all that have one of the paths. Rows with a null path touch nothing."""
    changes = materialize(changes.where(F.col("path").isNotNull()))
    old, touched, buckets = touched_rows(spark, root, changes)
    if not touched:
        return []
    new = merge(old.select(*LEDGER_COLUMNS), changes).select(*LEDGER_COLUMNS)
    new = new.withColumns({"buckets": F.lit(buckets), "bucket": bucket_of(F.col("path"), buckets)})
    new = materialize(new.repartition("bucket"))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(root)
    # a partition whose rows are all gone has nothing to overwrite it with
    left = {r.bucket for r in new.select("bucket").distinct().collect()}
    jvm = spark.sparkContext._jvm
    for bucket in touched:
        if bucket not in left:
            at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/buckets={buckets}/bucket={bucket}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return touched
