"""Operator 5: near duplicates by MinHash with tensored banding.

A document's set holds the distinct shingles of its words. Two collections of
``TABLES`` half keys each, every one of ``HALF`` MinHash values, are made from
``2 * TABLES * HALF`` hash functions; a table key joins one half key of the
first collection with one of the second, which gives ``TABLES ** 2`` tables
for about the square root of the hash work. Two sets of similarity s meet in
some table unless one collection has no half key in common:
1 - (1 - (1 - s**HALF)**TABLES)**2 of them are missed, below 8e-5 at 0.85.

Equal sets are one class, named by its smallest document id. In every bucket
the members are compared with the bucket's smallest class, on full sets, and
the links joined into components. A bucket whose other members then still
lie in different components may hide links among these: such members are
compared by an exact prefix join (two sets this similar share one of their
rarest shingles), so no bucket is capped and none is expanded into all its
pairs. Last, all links give the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.materialize import materialize
from .components import components
from . import tables
from .tables import bitmap_of, in_bitmap, numbered, original
from .textblocks import SPACES, Block, blocks, combined, map_texts, mix, row_of, windows, words

TABLES = 8
HALF = 2
#: counters of tokens, least and most (16 MB), and the tokens that are ranked at once
MIN_PLACES, MAX_PLACES = 1 << 16, 1 << 24
RUN_TOKENS = 1 << 17

_rng = np.random.default_rng(19970611)
_A = _rng.integers(1, 2**63, 2 * TABLES * HALF, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 2 * TABLES * HALF, dtype=np.int64).astype(np.uint64)


def shingle_sets(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the texts'
    offsets. A text of fewer than ``shingle`` words is one shingle."""
    hashes, at = words(block, ~SPACES[block.data], lower=True)
    first, of = windows(at, shingle)
    value, row = combined(hashes, first, shingle), row_of(of)
    for size in range(1, shingle):
        short = np.flatnonzero(np.diff(at) == size)
        whole = combined(hashes, at[short], size) + np.uint64(size)
        value, row = np.concatenate([value, mix(whole)]), np.concatenate([row, short])
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")]
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(block.rows + 1))


def signatures(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set: its size, a 128-bit digest, and the 2 * TABLES half keys."""
    n, size = len(at) - 1, np.diff(at)
    some = np.flatnonzero(size)
    digest, halves = np.zeros((n, 2), np.uint64), np.zeros((n, 2 * TABLES), np.uint64)
    if len(some):
        heads = at[some]
        digest[some, 0] = mix(np.add.reduceat(mix(value + np.uint64(1)), heads))
        digest[some, 1] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), heads)
        for i in range(2 * TABLES):
            key = np.zeros(len(some), np.uint64)
            for j in range(i * HALF, (i + 1) * HALF):
                key = mix(key * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(value * _A[j] + _B[j], heads))
            halves[some, i] = key
    return size, digest, halves


def _long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def with_signatures(docs: DataFrame, text_col: str, shingle: int, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``_n``, ``_d1``, ``_d2`` and ``_halves`` added."""
    fields = StructType([*[StructField(c, LongType()) for c in ("_n", "_d1", "_d2")], StructField("_halves", ArrayType(LongType()))])

    def run(texts: pa.Array) -> list[pa.Array]:
        parts = [signatures(*shingle_sets(b, shingle)) for b in blocks(texts)]
        if not parts:
            return [pa.array([], pa.int64())] * 3 + [pa.array([], pa.list_(pa.int64()))]
        size, digest, halves = (np.concatenate(p) for p in zip(*parts, strict=True))
        width = halves.shape[1]
        lists = _long_lists(halves.ravel(), np.arange(len(halves) + 1) * width)
        return [pa.array(size, pa.int64()), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].copy().view(np.int64)), lists]

    return map_texts(docs, text_col, fields, run, keep)


def table_keys(classes: DataFrame, bitmap: Broadcast | None = None) -> DataFrame:
    """A row (``_key``, ``_id``) for each table and row of ``classes``
    (``_id``, ``_halves``); with ``bitmap`` only those whose key may be in it."""
    schema = StructType([StructField("_key", LongType()), classes.schema["_id"]])

    def run(batches):
        for batch in batches:
            halves = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, 2 * TABLES)
            for t in range(TABLES**2):
                i, j = divmod(t, TABLES)
                keys = mix(mix(halves[:, i] + np.uint64(t)) * np.uint64(0xD1342543DE82EF95) + halves[:, TABLES + j])
                rows = np.arange(len(keys)) if bitmap is None else np.flatnonzero(in_bitmap(bitmap, keys))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows].view(np.int64)), batch.column(0).take(pa.array(rows))], names=schema.names)

    return classes.select("_id", "_halves").mapInArrow(run, schema)


def sets_of(source: DataFrame, used: DataFrame, shingle: int) -> DataFrame:
    """``_id`` and ``_set``, the shingle hashes, of the texts whose id is in
    ``used`` (a written table of distinct ids); equal sets of an id once."""
    schema = StructType([source.schema["_id"], StructField("_set", ArrayType(LongType()))])
    bitmap = bitmap_of(used.select(F.xxhash64("_id").alias("_h")), "_h")

    def run(batches):
        for batch in batches:
            some = np.flatnonzero(in_bitmap(bitmap, batch.column(2).to_numpy()))
            batch = batch.take(pa.array(some))
            for b in blocks(batch.column(1)):
                sets = _long_lists(*shingle_sets(b, shingle))
                yield pa.RecordBatch.from_arrays([batch.column(0)[b.lo : b.hi], sets], names=schema.names)

    hashed = source.select("_id", "_body", F.xxhash64("_id").alias("_h"))
    if used.count() > tables.MAX_BITS // 4:
        # so many ids fill the bitmap: rather shuffle the texts than the sets of all
        hashed = hashed.join(used, "_id", "left_semi")
    sets = hashed.mapInArrow(run, schema).join(used, "_id", "left_semi").withColumn("_sum", F.xxhash64("_set"))
    return sets.where(F.size("_set") > 0).dropDuplicates(["_id", "_sum"]).drop("_sum")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are ``percent`` similar. The
    sets of ``b`` travel with the pairs; that of ``a``, which many pairs may
    share, is joined last, where a skewed key can be split."""
    left = sets.select(F.col("_id").alias("_ida"), F.col("_set").alias("_sa"))
    right = sets.select(F.col("_id").alias("_idb"), F.col("_set").alias("_sb"))
    both = pairs.join(right, F.col("b") == F.col("_idb")).join(left, F.col("a") == F.col("_ida"))
    na, nb = F.size("_sa"), F.size("_sb")
    near = percent * F.greatest(na, nb) <= 100 * F.least(na, nb)
    common = F.when(near, F.size(F.array_intersect("_sa", "_sb"))).otherwise(F.lit(0))
    return both.where(100 * common >= percent * (na + nb - common)).select("a", "b")


def _rarity(sets: DataFrame) -> Broadcast:
    """How often each token of a written table of sets occurs, in eighths of
    powers of two, by its low bits; on all executors. Tokens that share a place
    are counted together, so none looks rarer than it is. The places are as
    many as the tokens need, 16 million at most, and one long for eight of
    them comes to the driver."""
    places = MIN_PLACES
    n = sets.agg(F.sum(F.size("_set"))).first()[0] or 0
    while places < min(2 * n, MAX_PLACES):
        places *= 2
    tokens = sets.select(F.explode("_set").alias("_tok")).select(F.col("_tok").bitwiseAND(F.lit(places - 1)).alias("p"))
    counts = tokens.groupBy("p").agg(F.count(F.lit(1)).alias("_df"))
    level = F.least(F.floor(8 * F.log2("_df")), F.lit(255)).cast("long").alias("level")
    longs = counts.select("p", level).where("level > 0").selectExpr("shiftright(p, 3) AS w", "shiftleft(level, CAST(8 * (p & 7) AS INT)) AS part")
    rows = longs.groupBy("w").agg(F.bit_or("part").alias("levels")).toArrow()
    out = np.zeros(places >> 3, "<i8")
    out[rows["w"].to_numpy()] = rows["levels"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def rare_token_pairs(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a`` < ``b``) of ``wanted`` (``_id``, ``_comp``) in different
    components whose sets may be ``percent`` similar, none left out.

    The shingles of a set are ranked from the rarest among the wanted sets
    (those in no other set first), all in the same order: by :func:`_rarity`,
    then by value. Similar sets share a shingle among the
    first n - ceil(percent/100 * n) + 1 of each, and at the first one they
    share they have no more in common than what follows in either; that
    holds for any order, so the rarity may be a rough one."""
    held = materialize(sets.join(wanted, "_id").select("_id", "_comp", "_set"))
    rarity = _rarity(held)
    schema = StructType([held.schema["_id"], held.schema["_comp"], *[StructField(c, LongType()) for c in ("_n", "_tok", "_pos")]])

    def runs(batches):
        for batch in batches:
            offsets, lo = batch.column(2).offsets.to_numpy().astype(np.int64), 0
            while lo < batch.num_rows:
                hi = max(int(np.searchsorted(offsets, offsets[lo] + RUN_TOKENS, "right")) - 1, lo + 1)
                yield batch.slice(lo, hi - lo)
                lo = hi

    def run(batches):
        for batch in runs(batches):
            sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            tokens = batch.column(2).flatten().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            level = rarity.value[tokens & (len(rarity.value) - 1)]
            order = np.lexsort((tokens, (rows << 8) | level))
            n = sizes[rows]
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # a token of level 0 is in no other set
            kept = np.flatnonzero((pos <= n - (percent * n + 99) // 100) & (level[order] > 0))
            ids, comps = (batch.column(c).take(pa.array(rows[kept])) for c in (0, 1))
            numbers = [pa.array(x) for x in (n[kept], tokens[order[kept]], pos[kept])]
            yield pa.RecordBatch.from_arrays([ids, comps, *numbers], names=schema.names)

    prefix = materialize(held.mapInArrow(run, schema))
    x = prefix.withColumnsRenamed({c: f"{c}x" for c in prefix.columns})
    y = prefix.withColumnsRenamed({c: f"{c}y" for c in prefix.columns})
    total = F.col("_nx") + F.col("_ny")
    most = F.least(F.col("_nx") - F.col("_posx"), F.col("_ny") - F.col("_posy"))
    on = (
        (F.col("_tokx") == F.col("_toky"))
        & (F.col("_idx") < F.col("_idy"))
        & (F.col("_compx") != F.col("_compy"))
        & ((100 + percent) * most >= percent * total)
    )
    return x.join(y, on).select(F.col("_idx").alias("a"), F.col("_idy").alias("b")).distinct()


def links_within_buckets(crowd: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links among the members ``b`` of a bucket ``_key`` (its smallest one
    aside) that do not all lie in one component of ``roots`` yet; None if all
    buckets are settled."""
    placed = crowd.join(roots, F.col("b") == F.col("node"), "left").select("_key", "b", F.coalesce("root", "b").alias("_comp"))
    unsettled = placed.groupBy("_key").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi").select("_key")
    wanted = materialize(placed.join(unsettled, "_key", "left_semi").select(F.col("b").alias("_id"), "_comp").distinct())
    if wanted.isEmpty():
        return None
    return verified(rare_token_pairs(sets, wanted, percent), sets, percent)


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles`` (size of its set),
    ``component_id`` (the smallest id it is linked to, over any number of
    links, itself included) and ``kept`` (whether that is its own id).
    Documents are linked where 100 * common shingles >= ``percent`` * all.

    Words are runs of anything but the spaces \\x20 and \\x09-\\x0D, A-Z
    lower-cased. A text of fewer words than a shingle is one shingle; without
    words (empty and null texts) the set is empty and linked with nothing.
    Rows that share an id are one document that has all their links; each
    stays as a row. A row without an id is linked with nothing: its
    component is null and it is kept. An empty table gives no rows; other
    columns are not read.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_body"))
    signed = materialize(with_signatures(source, "_body", shingle, ["_id"]))
    rows = signed.drop("_halves")
    members = signed.where("_id IS NOT NULL AND _n > 0")
    classes = members.groupBy("_d1", "_d2", "_n").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.first("_halves").alias("_halves"))
    classes = materialize(classes)

    classes = classes.withColumnRenamed("_rep", "_id")
    buckets = table_keys(classes).groupBy("_key").agg(F.count(F.lit(1)).alias("_m"), F.min("_id").alias("a"), F.max("_id").alias("b"))
    buckets = materialize(buckets.where("_m > 1 AND a < b"))
    # the members of buckets of three and more, without the smallest
    big = buckets.where("_m > 2").select("_key", "a")
    crowd = table_keys(classes, bitmap_of(big, "_key")).join(big, "_key").where("_id <> a")
    crowd = materialize(crowd.select("_key", "a", F.col("_id").alias("b")))
    pairs = materialize(buckets.where("_m = 2").select("a", "b").union(crowd.select("a", "b")).distinct())
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    sets = materialize(sets_of(source, used, shingle))
    links = materialize(verified(pairs, sets, percent))
    roots = components(links)

    more = links_within_buckets(crowd, roots, sets, percent)

    # an id with several sets belongs to the class of each
    reps = classes.where("_copies > 1").select("_d1", "_d2", "_n", F.col("_id").alias("_rep"))
    if not members.groupBy("_id").count().where("count > 1").isEmpty():
        named = _with_rep(members.drop("_halves"), reps)
        several = named.groupBy("_id").agg(F.min("_rep").alias("_lo"), F.max("_rep").alias("_hi")).where("_lo < _hi").select("_id")
        same_id = named.join(several, "_id", "left_semi").select(F.col("_id").alias("a"), F.col("_rep").alias("b"))
        more = same_id if more is None else more.union(same_id)
    if more is not None:
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # classes with copies take their root along; a lone document looks it up itself
    reps = reps.join(roots, F.col("_rep") == F.col("node"), "left").select("_d1", "_d2", "_n", F.coalesce("root", "_rep").alias("_rep"))
    named = _with_rep(rows, reps, lone=F.lit(None).cast("long"))
    final = named.join(roots, (F.col("_id") == F.col("node")) & F.col("_rep").isNull(), "left")
    component = F.coalesce("_rep", "root", "_id")
    return final.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def _with_rep(rows: DataFrame, reps: DataFrame, lone=None, salts: int = 16) -> DataFrame:
    """``rows`` with ``_rep`` of their class; a row of a class without copies
    gets ``lone``, its own id by default. Each class that has copies is put
    in ``salts`` places, so a class with a third of all rows is spread."""
    spread = reps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    keyed = salted.withColumn("_size", F.col("_n")).withColumn("_n", F.when(F.col("_id").isNotNull() & (F.col("_size") > 0), F.col("_size")))
    joined = keyed.join(spread, ["_d1", "_d2", "_n", "_salt"], "left")
    own = F.col("_id") if lone is None else lone
    return joined.select("_id", F.col("_size").alias("_n"), F.coalesce("_rep", own).alias("_rep"))


def _without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``ids`` (``_found``, distinct and
    written). A few ids are broadcast, whatever else the rows carry. For more, a
    bitmap of their hashes lets pass the rows that cannot meet one, and only
    the others are shuffled to the exact join."""
    same = F.col(key) == F.col("_found")
    if ids.count() <= tables.BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), same, "left_anti")
    bitmap = bitmap_of(ids.select(F.xxhash64("_found").alias("_h")), "_h")
    hashed, columns = rows.withColumn("_h", F.xxhash64(key)), rows.columns

    def passing(hit: bool):
        def run(batches):
            for batch in batches:
                some = np.flatnonzero(in_bitmap(bitmap, batch.column(batch.num_columns - 1).to_numpy()) == hit)
                yield batch.select(columns).take(pa.array(some))

        return hashed.mapInArrow(run, rows.schema)

    return passing(False).unionByName(passing(True).join(ids, same, "left_anti"))


def without_near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group of :func:`near_duplicates` (the one of the
    smallest id), with all its columns. Rows that share the kept id are cut
    to one, the smallest by a hash of its columns; rows without an id stay."""
    rows, names = numbered(docs)
    key = F.col(names[id_col])
    found = materialize(near_duplicates(docs, shingle, percent, id_col, text_col).select(F.col(id_col).alias("_found"), "kept").where("_found IS NOT NULL"))
    dropped = found.where("NOT kept").select("_found").distinct()
    left = _without(rows, names[id_col], materialize(dropped))
    again = materialize(found.where("kept").groupBy("_found").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_found"))
    if not again.isEmpty():
        single = left.join(again, key == F.col("_found"), "left_anti")
        repeated = left.join(again, key == F.col("_found"), "left_semi").withColumn("_row", F.xxhash64(*names.values()))
        first = repeated.groupBy(key.alias("_found")).agg(F.min("_row").alias("_first"))
        one = repeated.join(first, (key == F.col("_found")) & (F.col("_row") == F.col("_first"))).dropDuplicates([names[id_col]])
        left = single.unionByName(one.select(*names.values()))
    return left.select(*original(names))
