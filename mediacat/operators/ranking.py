"""Skew-safe ordinals and running sums inside groups.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row of a
key to one task; when one key holds a third of all rows that task holds a
third of the data. Here rows are instead range-partitioned on
``(key, order)``: the sampler splits a hot key over as many partitions as
its size needs. The ranged rows are *written once* together with the number
of the range piece they fell into, so everything that follows agrees on the
pieces: a range exchange planned twice samples its bounds twice and the two
need not match. Each piece computes local running sums per key; the only
cross-piece information is the total of the same key in earlier pieces. At
most one key per piece can continue from an earlier piece, so that offset
table has at most ``num_partitions`` rows: its broadcast is bounded by
construction, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def group_running_sums(
    df: DataFrame,
    keys: list[str],
    order: list,
    values: dict[str, Column],
    inclusive: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """For every ``name -> value`` add ``name`` = sum of ``value`` over the
    rows of the same ``keys`` group that sort before this row by ``order``
    (and the row itself when ``inclusive``). No ``keys``: one running sum
    over the whole table. Rows of a group that tie in ``order`` are taken in
    the order they were written.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = _cols(order)
    key_cols = _cols(keys)
    names = list(values)
    ranged = df.withColumns({f"_rs_v{i}": values[nm].cast("long") for i, nm in enumerate(names)})
    ordered = ranged.withColumn("_rs_ord", F.struct(*order_cols))
    ranged = ordered.repartitionByRange(n, *key_cols, "_rs_ord").withColumn("_rs_pid", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("_rs_row", F.monotonically_increasing_id()))
    w = Window.partitionBy(*key_cols, "_rs_pid").orderBy("_rs_ord", "_rs_row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = ranged.withColumns({f"_rs_l{i}": F.sum(f"_rs_v{i}").over(w) for i in range(len(names))})
    offsets = boundary_offsets(ranged, keys, len(names)).withColumnsRenamed({k: f"_rs_k{i}" for i, k in enumerate(keys)})
    on = F.col("_rs_pid") == F.col("_rs_opid")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_rs_k{i}"))
    out = local.join(F.broadcast(offsets), on, "left")
    for i, nm in enumerate(names):
        total = F.col(f"_rs_l{i}") + F.coalesce(F.col(f"_rs_o{i}"), F.lit(0).cast("long"))
        if not inclusive:
            total = total - F.col(f"_rs_v{i}")
        out = out.withColumn(nm, total)
    return out.drop(*[c for c in out.columns if c.startswith("_rs_")])


def boundary_offsets(ranged: DataFrame, keys: list[str], n_values: int) -> DataFrame:
    """Per (key, piece), the totals of the same key in earlier pieces, kept
    only where there are any: at most one row per piece when there are
    ``keys`` (only a piece's first key can continue from before), and one
    row per piece without them.

    Only the first and the last key of a piece can meet another piece, so
    keys that lie wholly inside one piece are dropped before the window.
    """
    pieces = ranged.groupBy(*keys, "_rs_pid").agg(*[F.sum(f"_rs_v{i}").alias(f"_rs_t{i}") for i in range(n_values)])
    if keys:
        edge = F.struct(*keys)
        ends = ranged.groupBy("_rs_pid").agg(F.min(edge).alias("_rs_lo"), F.max(edge).alias("_rs_hi"))
        pieces = pieces.join(F.broadcast(ends), "_rs_pid").where((edge == F.col("_rs_lo")) | (edge == F.col("_rs_hi")))
    before = Window.partitionBy(*keys).orderBy("_rs_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumns({f"_rs_o{i}": F.sum(f"_rs_t{i}").over(before) for i in range(n_values)})
    return offsets.where(F.col("_rs_o0").isNotNull()).select(
        *keys, F.col("_rs_pid").alias("_rs_opid"), *[f"_rs_o{i}" for i in range(n_values)]
    )


def group_running_sum(
    df: DataFrame,
    keys: list[str],
    order: list,
    value: Column | None = None,
    name: str = "running",
    inclusive: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Single running sum; see :func:`group_running_sums`."""
    v = value if value is not None else F.lit(1)
    return group_running_sums(df, keys, order, {name: v}, inclusive, num_partitions)


def group_ordinal(df: DataFrame, keys: list[str], order: list, name: str = "ordinal", **kw) -> DataFrame:
    """1-based position of each row inside its ``keys`` group by ``order``."""
    return group_running_sum(df, keys, order, None, name, True, **kw)


def first_in_group(df: DataFrame, keys: list[str], unique: str, name: str = "is_first") -> DataFrame:
    """Flag the row with the smallest ``unique`` value of each ``keys`` group.

    The minimum is a partial (map-side) aggregate; joining it back on
    ``keys + unique`` spreads a hot key over all partitions because the
    composite key is unique per row.
    """
    mins = df.groupBy(*keys).agg(F.min(unique).alias(unique)).withColumn(name, F.lit(True))
    return df.join(mins, [*keys, unique], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
