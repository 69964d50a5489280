"""Operator 7: sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: the key's
64-bit hash seeds a linear congruential generator, whose draws are the
shard counts at which the key would move; the last one below the number of
shards is its shard. There is no ring table, and one more shard takes about
its even share of the rows, all of them into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.ranking import group_ordinal

#: Fixed value: the multiplier of the published generator.
STEP = np.uint64(2862933555777941757)


def jump_shards(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards`` - 1, of each 64-bit hash."""
    state = hashes.astype(np.uint64)
    shard, draw = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = draw[live]
        state[live] = state[live] * STEP + np.uint64(1)
        top = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        draw[live] = ((shard[live] + 1) * (2.0**31 / top)).astype(np.int64)
        live = live[draw[live] < shards]
    return shard


def with_shards(df: DataFrame, keys: list[str], counts: dict[str, int]) -> DataFrame:
    """``df`` with a column for each entry of ``counts`` (name: number of
    shards) added: the shard of the row's ``keys``. Null is a key value like
    any other. Columns of these names are replaced."""
    if any(n < 1 for n in counts.values()):
        raise ValueError("a number of shards must be at least 1")
    fields = [StructField(name, IntegerType()) for name in counts]
    kept = [c for c in df.columns if c.lower() not in {name.lower() for name in counts}]
    source = df.select(*kept, F.xxhash64(*keys).alias("_hash"))
    schema = StructType([*[f for f in source.schema][:-1], *fields])

    def run(batches):
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            new = [pa.array(jump_shards(hashes, n), pa.int32()) for n in counts.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return source.mapInArrow(run, schema)


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None
) -> DataFrame:
    """One row per document: ``id_col``, ``size`` (UTF-8 bytes of the text
    plus 1), ``text_crc32`` (unsigned), ``law`` (``key``), ``shard``, ``slot``
    and ``grown_shard``, the shard if there were one more.

    Slots number a shard's rows from 0 without gaps by ``order`` (the id by
    default); they come from a range partitioning, so a shard with any number
    of rows is numbered by many tasks. A null text is empty: size 1, CRC 0.
    Rows that share an id, or have none, share a shard and get slots of their
    own. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = [F.col(id_col)] if order is None else order
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[c.alias(f"_o{i}") for i, c in enumerate(order)],
    )
    placed = with_shards(narrow, ["_id"], {"shard": shards, "grown_shard": shards + 1})
    ranked = group_ordinal(placed, ["shard"], [F.col(f"_o{i}") for i in range(len(order))] + [F.col("text_crc32")], "_slot")
    return ranked.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_slot") - 1).alias("slot"), "grown_shard"
    )
