"""Operator 8: mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded random order, are cut into blocks of
equal mass (UTF-8 bytes). Block k of a source with weight w is released at
slot floor(k/w) and due by slot ceil((k+1)/w); the released block with the
earliest deadline gets the next slot. Up to any slot t a source that still
has blocks has then got its w*t blocks, give or take less than one.

Weights are whole parts of a period (``weights`` sum to it), so the schedule
repeats with the period: its slots follow from the parameters alone and make
a table of at most ``MAX_PERIOD`` rows, whatever the data. Everything that
touches the data is DataFrame operations: running sums, one join with that
table, one sort. Texts are shuffled once, to the piece of the mixture that their
seeded hash tells.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from ..operators.ranking import group_ordinal, group_running_sums
from .tables import numbered, original, rank_among

MAX_PERIOD = 10_000
BLOCK_BYTES = 1 << 16
#: the stream of all sources that have no weight of their own
REST = "*"
SEED = 8


def period_schedule(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The slots of one period, in order: (stream, k, release, deadline,
    slot) with k the number of the stream's block within the period."""
    period = sum(weights.values())
    if not 0 < period <= MAX_PERIOD or min(weights.values()) < 1:
        raise ValueError(f"weights are whole parts of 1 or more that sum to {MAX_PERIOD} at most")
    got = dict.fromkeys(weights, 0)
    out = []
    for slot in range(period):
        due = []
        for rank, (stream, parts) in enumerate(weights.items()):
            k = got[stream]
            release, deadline = k * period // parts, -(-(k + 1) * period // parts)
            if k < parts and release <= slot:
                due.append((deadline, rank, stream, k, release))
        deadline, _, stream, k, release = min(due)
        got[stream] += 1
        out.append((stream, k, release, deadline, slot))
    return out


def _schedule_table(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    rows = [F.struct(*[F.lit(x) for x in row]) for row in period_schedule(weights)]
    names = ["_s_stream", "_s_k", "_s_release", "_s_deadline", "_s_slot"]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("r"))
    return table.select(*[F.col(f"r.col{i + 1}").alias(n) for i, n in enumerate(names)])


def _slots(narrow: DataFrame, weights: dict[str, int], block_bytes: int) -> DataFrame:
    """``narrow`` (``_stream``, ``_mass``, ``_key``, unique within a stream)
    with block, release, deadline, slot and ``_before``, the stream's mass in
    front of the row."""
    order = [F.xxhash64("_key", F.lit(SEED)), F.col("_key")]
    return _with_slots(group_running_sums(narrow, ["_stream"], order, {"_before": F.col("_mass")}, inclusive=False), weights, block_bytes)


def _with_slots(summed: DataFrame, weights: dict[str, int], block_bytes: int) -> DataFrame:
    """Rows with ``_stream`` and ``_before``: block, release, deadline and slot added."""
    parts = F.create_map(*[x for s, n in weights.items() for x in (F.lit(s), F.lit(n))])[F.col("_stream")]
    period = sum(weights.values())
    blocked = summed.withColumn("block", F.expr(f"_before div {block_bytes}"))
    blocked = blocked.withColumns({"_parts": parts.cast("long")})
    blocked = blocked.withColumns({"_cycle": F.expr("block div _parts"), "_k": F.col("block") % F.col("_parts")})
    table = _schedule_table(summed.sparkSession, weights)
    joined = blocked.join(F.broadcast(table), (F.col("_stream") == F.col("_s_stream")) & (F.col("_k") == F.col("_s_k")))
    turn = F.col("_cycle") * period
    return joined.withColumns(
        {"release": turn + F.col("_s_release"), "deadline": turn + F.col("_s_deadline"), "slot": turn + F.col("_s_slot")}
    ).drop("_parts", "_cycle", "_k", "_s_stream", "_s_k", "_s_release", "_s_deadline", "_s_slot")


def stream_of(source: Column, weights: dict[str, int]) -> Column:
    """The stream of a source: itself if it has a weight, else ``REST`` or,
    where the rest has several streams (``*0``, ``*1``, ...), one of these by the
    source's hash."""
    shared = sum(bool(re.fullmatch(re.escape(REST) + r"\d+", s)) for s in weights)
    named = [s for s in weights if s != REST and not re.fullmatch(re.escape(REST) + r"\d+", s)]
    rest = F.lit(REST)
    if shared:
        rest = F.when(source.isNotNull(), F.concat(rest, F.pmod(F.xxhash64(source), F.lit(shared)))).otherwise(rest)
    return F.when(source.isin(named), source).otherwise(rest) if named else rest


def source_weights(docs: DataFrame, weights: dict[str, int], source_col: str = "source", most: int = 99) -> dict[str, int]:
    """``weights`` with a stream for each source: the rest's weight in equal
    shares over the sources of ``docs`` that are not named, and one for the rows
    without a source. Beyond ``most`` such sources (all that comes to the
    driver) the rest has ``most`` streams that sources share by their hash. The
    period grows with the number of streams, to ``most`` + 1 times its length."""
    rest = _checked(weights)[REST]
    named = {s: n for s, n in weights.items() if s != REST}
    source = F.col(source_col).cast("string")
    others = docs.select(source.alias("s")).where(source.isNotNull() & ~source.isin([*named, REST])).distinct().limit(most + 1).collect()
    found = sorted(r.s for r in others) if len(others) <= most else [f"{REST}{i}" for i in range(most)]
    return {s: n * (len(found) + 1) for s, n in named.items()} | dict.fromkeys([*found, REST], rest)


def _checked(weights: dict[str, int]) -> dict[str, int]:
    if REST not in weights:
        raise ValueError(f"weights need an entry {REST!r} for the sources that are not named")
    return weights


def mixing_order(
    docs: DataFrame, weights: dict[str, int], block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: ``id_col``, ``stream``, ``block``, ``release``,
    ``deadline``, ``slot`` and ``position``, the row's place in the mixture
    (from 0, without gaps).

    The slots of a stream that has run out, and those inside a document of
    several blocks, stay idle; the other streams go on at their own rates.
    Sources without a weight, null ones too, share the stream ``*``. A
    document's mass is the UTF-8 bytes of its text plus 1, so a null text
    takes a place too. Repeated rows each count; rows without an id come
    first in their seeded order. An empty table gives no rows; other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.struct(F.col(id_col).alias("id"), F.crc32(F.encode(text, "UTF-8")).alias("crc")).alias("_key"),
        stream_of(F.col(source_col).cast("string"), _checked(weights)).alias("_stream"),
        (F.octet_length(text).cast("long") + 1).alias("_mass"),
    )
    placed = _slots(narrow, weights, block_bytes)
    ranked = group_ordinal(placed, [], [F.col("slot"), F.col("_before")], "_position")
    return ranked.select(
        F.col("_key.id").alias(id_col), F.col("_stream").alias("stream"), "block", "release", "deadline", "slot", (F.col("_position") - 1).alias("position")
    )


#: pieces of the mixture for each shuffle partition, and of the hash range for the lookup of a row's piece
PIECES = 2
COARSE_BITS = 12


def _pieces(placed: DataFrame, n: int) -> DataFrame:
    """The mixture cut into ``n`` pieces of about as many rows: for each
    stream and piece the seeded hashes ``_from`` to ``_to`` of its rows (a
    stream's slots rise with them), and ``_start``, the stream's mass in front of
    them. A row for each piece, stream and coarse part of the hashes, so at
    most streams x (n + 2 ** COARSE_BITS) whatever the data."""
    shares = [i / n for i in range(1, n)]
    found = placed.agg(F.percentile_approx("slot", F.lit(shares), 4 * max(n, 2500)).alias("x")).first()["x"] if shares else None
    piece = rank_among(F.col("slot"), sorted(set(found or [])))
    heads = placed.groupBy("_stream", piece.alias("_piece")).agg(F.min("_hash").alias("_from"))
    first = heads.withColumnsRenamed({"_stream": "_hs"}).join(placed.select("_stream", "_hash", "_before"), (F.col("_hs") == F.col("_stream")) & (F.col("_from") == F.col("_hash")))
    heads = first.groupBy("_stream", "_piece", "_from").agg(F.min("_before").alias("_start"))
    ordered = Window.partitionBy("_stream").orderBy("_piece")
    heads = heads.withColumn("_to", F.coalesce(F.lead("_from").over(ordered) - 1, F.lit(2**63 - 1)))
    coarse = [F.shiftright(c, 64 - COARSE_BITS) for c in ("_from", "_to")]
    return heads.where("_from <= _to").select("*", F.explode(F.sequence(*coarse)).alias("_coarse"))


def mixed(
    docs: DataFrame, weights: dict[str, int], block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """All rows of ``docs`` with all their columns, sorted into the order of
    :func:`mixing_order`: part file by part file, row by row. Slots are found
    on a narrow table; within a stream they rise with the rows' seeded hashes, so
    a few bounds tell each row where it lies to which piece of the mixture it
    belongs. The texts are shuffled once, to their pieces, and the mass in front
    of a row is summed up again there. Rows equal in every column are
    interchangeable and stand next to each other."""
    spark = docs.sparkSession
    rows, names = numbered(docs)
    text = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    key = F.struct(F.col(names[id_col]).alias("id"), F.xxhash64(*names.values()).alias("row"))
    rows = rows.withColumns(
        {"_key": key, "_stream": stream_of(F.col(names[source_col]).cast("string"), _checked(weights)), "_mass": F.octet_length(text).cast("long") + 1}
    ).withColumn("_hash", F.xxhash64("_key", F.lit(SEED)))
    narrow = rows.select("_key", "_stream", "_mass", "_hash")
    placed = materialize(_slots(narrow, weights, block_bytes).select("_stream", "_hash", "_before", "slot"))
    n = PIECES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialize(_pieces(placed, n)).withColumnRenamed("_stream", "_of")
    within = (
        (F.col("_stream") == F.col("_of")) & (F.shiftright("_hash", 64 - COARSE_BITS) == F.col("_coarse")) & F.col("_hash").between(F.col("_from"), F.col("_to"))
    )
    dealt = rows.join(F.broadcast(pieces), within).drop("_of", "_coarse", "_from", "_to").repartitionByRange(n, "_piece")
    turn = Window.partitionBy("_piece", "_stream").orderBy("_hash", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("_before", F.col("_start") + F.sum("_mass").over(turn) - F.col("_mass"))
    return _with_slots(dealt, weights, block_bytes).sortWithinPartitions("_piece", "slot", "_before").select(*original(names))
