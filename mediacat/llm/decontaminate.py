"""Operator 3: benchmark decontamination by CGK embeddings.

Texts and benchmark items are sequences of words (runs of letters and digits
in lower case). The CGK embedding reads a window by a random walk: step j
writes the word under the pointer and moves on by a random bit of (j, word).
Two windows at a small edit distance get embeddings that differ in few
places, as a walk that met an edit tends to fall back into step; so a key
made of a few sampled steps is often the same, and ``REPEATS`` independent
walks reach the target recall. Windows are sized by the items: half an item,
8 words at most, so that every occurrence of an item holds whole windows of
the text's grid (one every half window). Items are indexed at every word, so
the grid needs no luck: an exact copy always collides.

A collision says where the item would lie; there its edit distance to the
text (over words, the ends of the text's side free) is computed exactly. A
document is contaminated by an item where the distance is at most
``max_edits_percent`` of the item's words.

The benchmark goes to the executors in blocks of at most ``BLOCK_WORDS`` words
(one item at least); documents are read once for each block and not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .textblocks import Block, blocks, mix, row_of, words

#: words that the index of one pass over the documents holds
BLOCK_WORDS = 200_000
REPEATS = 8
#: sampled steps of a walk, per window size; a walk takes twice the window's words
SAMPLED = {8: 6, 4: 4, 2: 2, 1: 1}
MAX_EDITS_PERCENT = 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SEED = np.uint64(0x9E3779B97F4A7C15)


def window_size(n: int) -> int:
    """Words of the windows for an item of ``n`` words."""
    return next(w for w in (8, 4, 2, 1) if n >= 2 * w or w == 1)


def embed(hashes: np.ndarray, starts: np.ndarray, size: int, repeat: int) -> np.ndarray:
    """Keys of the windows of ``size`` words at ``starts``: a hash of the
    sampled steps of the ``repeat``-th walk. A window's end reads as a blank."""
    steps = 2 * size
    rng = np.random.default_rng([size, repeat])
    sampled = np.sort(rng.choice(steps, SAMPLED[size], replace=False)) if size > 1 else np.array([0])
    # bit j of a word: does step j move on from it?
    bits = np.zeros(len(hashes) + steps, np.uint16)
    bits[: len(hashes)] = mix(hashes * _SEED + np.uint64(repeat + 1)).astype(np.uint16)
    read = np.append(hashes, np.zeros(steps, np.uint64))
    at, end = starts.astype(np.intp), starts + size
    key = np.full(len(starts), repeat * 1000 + size, np.uint64)
    for j in range(int(sampled[-1]) + 1):
        if j in sampled:
            key = mix(key * np.uint64(0xD1342543DE82EF95) + np.where(at < end, read[at], np.uint64(0)))
        at += (bits[at] >> np.uint16(j)) & np.uint16(1)
    return key


def alignments(item: np.ndarray, regions: np.ndarray, free_start: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of ``item`` to the best piece of each row of ``regions``
    and the piece's end (exclusive). With ``free_start`` off, the piece has
    to start where the row does. Of equal distances the earliest end wins."""
    m = regions.shape[1]
    places = np.arange(m + 1)
    row = np.zeros((len(regions), m + 1), np.int64)
    if not free_start:
        row += places
    for i, word in enumerate(item):
        step = np.empty_like(row)
        step[:, 0] = row[:, 0] + 1
        step[:, 1:] = np.minimum(row[:, :-1] + (regions != word), row[:, 1:] + 1)
        # words of the row that the item lacks: a running minimum along it
        row = np.minimum.accumulate(step - places, axis=1) + places
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


@dataclass
class Index:
    """A block of items: their words, and for each window size and repeat the
    sorted keys of the items' windows with item and offset."""

    ids: list
    items: list[np.ndarray]
    tables: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    max_edits_percent: int

    def max_edits(self, item: int) -> int:
        return len(self.items[item]) * self.max_edits_percent // 100


def build_index(ids: list, texts: list[str], max_edits_percent: int) -> Index:
    items: list[np.ndarray] = []
    for b in blocks(pc.utf8_lower(pa.array(texts, pa.string()))):
        hashes, at = words(b, _WORD[b.data])
        items += [hashes[at[i] : at[i + 1]] for i in range(b.rows)]
    tables = []
    for size in (8, 4, 2, 1):
        own = [i for i, x in enumerate(items) if len(x) and window_size(len(x)) == size]
        if not own:
            continue
        flat = np.concatenate([items[i] for i in own])
        lengths = np.array([len(items[i]) for i in own])
        heads = np.concatenate([[0], np.cumsum(lengths)])
        offset = np.concatenate([np.arange(n - size + 1) for n in lengths])
        item = np.repeat(np.arange(len(own)), lengths - size + 1)
        starts = heads[item] + offset
        for repeat in range(REPEATS):
            key = embed(flat, starts, size, repeat)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            tables.append((size, repeat, key[order], np.array(own)[item[order]], offset[order], seen))
    return Index(ids, items, tables, max_edits_percent)


def grid(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows on each text's grid (one every half window, and
    one at the text's end) and their texts. A text of fewer words than a
    window is too short for an item of that size; its one window reads on
    into the next text, and what it may find there fails the verification."""
    counts = np.diff(at)
    stride = max(1, size // 2)
    n = np.where(counts > 0, np.maximum(-(-(counts - size) // stride), 0) + 1, 0)
    heads = np.concatenate([[0], np.cumsum(n)])
    row = row_of(heads)
    place = (np.arange(heads[-1]) - heads[row]) * stride
    place = np.minimum(place, np.maximum(counts[row] - size, 0))
    return at[row] + place, row


def candidates(index: Index, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, word at which the item would start), each once."""
    out = []
    grids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, repeat, keys, items, offsets, seen in index.tables:
        if size not in grids:
            grids[size] = grid(at, size)
        starts, row = grids[size]
        if not len(starts):
            continue
        key = embed(hashes, starts, size, repeat)
        maybe = np.flatnonzero(seen[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo = np.searchsorted(keys, key[maybe], "left")
        hi = np.searchsorted(keys, key[maybe], "right")
        n = hi - lo
        if not n.sum():
            continue
        at_key = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        window = np.repeat(maybe, n)
        out.append(np.stack([row[window], items[at_key], starts[window] - offsets[at_key]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


_CELLS = 1 << 20


def hits(index: Index, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, end word) for each text of the block
    and each item it holds, at the place of least distance (the first one)."""
    hashes, at = words(block, _WORD[block.data])
    if not len(hashes):
        return
    row, item, start = candidates(index, hashes, at)
    order = np.argsort(item, kind="stable")
    row, item, start = row[order], item[order], start[order]
    edge = np.flatnonzero(np.diff(item)) + 1
    for part in np.split(np.arange(len(item)), edge):
        if not len(part):
            continue
        i = int(item[part[0]])
        word, edits = index.items[i], index.max_edits(i)
        width = len(word) + 2 * edits
        best: dict[int, tuple[int, int]] = {}
        own = np.unique(word)
        # at a time as many places as keep the table of an alignment small
        for lo in range(0, len(part), max(1, _CELLS // (width + 1))):
            some = part[lo : lo + max(1, _CELLS // (width + 1))]
            region = _region(hashes, at, row[some], start[some] - edits, width)
            # all but ``edits`` of the item's words have to stand there
            known = own[np.minimum(np.searchsorted(own, region), len(own) - 1)] == region
            likely = np.flatnonzero(known.sum(axis=1) >= len(word) - edits)
            distance, end = alignments(word, region[likely])
            for k in np.flatnonzero(distance <= edits):
                r = int(row[some[likely[k]]])
                found = int(distance[k]), int(start[some[likely[k]]] - edits + end[k])
                best[r] = min(best.get(r, found), found)
        for r, (d, end) in best.items():
            # backwards from its end, the place begins where the same distance is reached
            back = _region(hashes, at, np.array([r]), np.array([end - len(word) - edits]), len(word) + edits)
            _, size = alignments(word[::-1], back[:, ::-1], free_start=False)
            yield r, i, d, end - int(size[0]) - int(at[r]), end - int(at[r])


def _region(hashes: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each place the ``width`` words from ``first`` on; 0 where the text has none."""
    place = first[:, None] + np.arange(width)
    inside = (place >= at[row][:, None]) & (place < at[row + 1][:, None])
    return np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(0))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about ``BLOCK_WORDS`` words; only one block is on
    the driver at a time. Items without an id or words hold for nothing."""
    words_in = F.size(F.split(F.trim(F.col(text_col)), r"\s+"))
    rows = benchmark.select(F.col(id_col).cast("string").alias("_item"), F.col(text_col).cast("string").alias("_text")).dropna().distinct()
    total = benchmark.agg(F.sum(words_in)).first()[0] or 0
    n = -(-int(total) // BLOCK_WORDS)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == b).orderBy("_item", "_text").collect()
        if part:
            yield [r["_item"] for r in part], [r["_text"] for r in part]


def contaminations(
    docs: DataFrame, benchmark: DataFrame, max_edits_percent: int = MAX_EDITS_PERCENT,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row for each document and benchmark item it holds: ``id_col``,
    ``item_col``, ``distance`` (edits), ``item_words``, ``first_word`` and
    ``end_word`` (exclusive) of the best place in the document.

    Null and empty texts hold nothing, and no document holds an item without
    words. Each of repeated rows has its own result rows, equal ones, also
    where the id is null; repeated items count once. Empty tables give no
    rows; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    item_type = benchmark.schema[item_col].dataType
    numbers = ["distance", "item_words", "first_word", "end_word"]
    schema = StructType([narrow.schema["_id"], StructField("_item", StringType()), *[StructField(c, LongType()) for c in numbers]])
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for ids, texts in item_blocks(benchmark, item_col, item_text_col):
        index = spark.sparkContext.broadcast(build_index(ids, texts, max_edits_percent))

        def run(batches, index=index):
            items = index.value
            for batch in batches:
                for b in blocks(pc.utf8_lower(batch.column(1))):
                    found = list(hits(items, b))
                    if found:
                        row, item, distance, first, end = zip(*found, strict=True)
                        ids = batch.column(0).take(pa.array([b.lo + r for r in row]))
                        longs = (distance, [len(items.items[i]) for i in item], first, end)
                        columns = [ids, pa.array([items.ids[i] for i in item], pa.string()), *[pa.array(x, pa.int64()) for x in longs]]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        out = out.union(narrow.mapInArrow(run, schema))
    return out.select(F.col("_id").alias(id_col), F.col("_item").cast(item_type).alias(item_col), *numbers)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, max_edits_percent: int = MAX_EDITS_PERCENT,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns.
    Rows are judged where they lie, by their texts alone."""
    spark = docs.sparkSession
    kept = docs
    for ids, texts in item_blocks(benchmark, item_col, item_text_col):
        index = spark.sparkContext.broadcast(build_index(ids, texts, max_edits_percent))
        at = docs.columns.index(text_col)

        def run(batches, index=index):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for b in blocks(pc.utf8_lower(batch.column(at))):
                    for row, *_ in hits(index.value, b):
                        clean[b.lo + row] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
