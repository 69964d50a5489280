"""Lineage cuts.

Operators that reference one input several times (self-joins of ranking
steps, decision tables feeding several outputs, rounds of a fixpoint)
materialise a *narrow* projection of it as a parquet table in the session's
shared checkpoint directory (``spark.checkpoint.dir``; a local scratch
folder only when the session has none, as in tests). This keeps logical
plans small, computes the upstream once, and a lost executor re-reads the
table instead of recomputing the lineage. ``localCheckpoint`` is never used.

Results read these tables when they are computed, so an operator cannot
remove them itself. Whoever has written or counted a result can: the tables
made inside ``with landing(spark):`` are gone after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_scopes: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/mediacat-tables/{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def landing(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that were landed inside. Results that
    are still to be computed then must not depend on them."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]  # scopes may nest
        jvm = spark.sparkContext._jvm
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
