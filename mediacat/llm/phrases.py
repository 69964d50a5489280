"""Operator 12: phrase collocations by weighted acyclic automata.

The n-grams of a shard (a run of texts) are sorted, counted and laid out as a
count transducer: a state for each prefix, an arc for each next word, a weight
for each path. A transducer is split by prefix range: the ranges of a hash of
language and first two words (of the first word for single words), so a
frequent first word lies in many ranges. The transducers of one range, from all
shards, are united and their weights summed in one place; paths below the
least count are pruned, and equal lists of last arcs are stored once. No
n-gram crosses the shuffle by itself, only as a piece of a shard's transducer.

A phrase's parts are phrases too, in other ranges: the parts asked for in a
range, each once, are composed with the range's transducer, which gives their
counts. The number of ranges follows from the bytes of the texts, so a range
is about ``RANGE_BYTES`` worth of text whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..operators.materialize import materialize
from .tables import lookup
from .textblocks import LOWER, Block, blocks, mix, span_hashes, word_spans

#: bytes of text of a shard (one text at least), and worth of text in a prefix range
SHARD_BYTES = 3 << 20
RANGE_BYTES = 8 << 20

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
SHARES = 32

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?"]] = True
_BREAKS[0x0A:0x0E] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True


class Transducer:
    """Paths of 1 to ``len(levels)`` words with their weights. ``words`` is
    the sorted vocabulary. Level 1 is (label, weight), level 2 (label of the
    first word, label, weight), a further level (path of the level before it,
    label, weight); each is sorted, so a path is found by bisection."""

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, ...]]):
        self.words, self.levels = words, levels

    def keys(self, m: int) -> np.ndarray:
        """Level ``m``'s arcs as sorted numbers: where they start and their label."""
        arcs = self.levels[m - 1]
        return arcs[0] if m == 1 else arcs[0] * np.int64(len(self.words)) + arcs[1]

    def compose(self, labels: list[np.ndarray]) -> np.ndarray:
        """The weights of the paths spelled by ``labels`` (one array for each
        word; -1 is a word that is not in the vocabulary), 0 for no path."""
        state = labels[0]
        for m in range(1 if len(labels) == 1 else 2, len(labels) + 1):
            keys, wanted = self.keys(m), state if m == 1 else state * np.int64(len(self.words)) + labels[m - 1]
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            known = (state >= 0) & (labels[m - 1] >= 0)
            known = known & (keys[at] == wanted) if len(keys) else np.zeros(len(known), bool)
            state = np.where(known, at, -1)
        weight = self.levels[len(labels) - 1][-1]
        return np.where(state >= 0, weight[np.maximum(state, 0)], 0) if len(weight) else np.zeros(len(state), np.int64)

    def paths(self, m: int) -> list[np.ndarray]:
        """The labels of all paths of ``m`` words, word by word."""
        if m == 1:
            return [self.levels[0][0]]
        at, out = np.arange(len(self.levels[m - 1][-1])), []
        for k in range(m, 2, -1):
            start, label = self.levels[k - 1][0][at], self.levels[k - 1][1][at]
            out, at = [label, *out], start
        return [self.levels[1][0][at], self.levels[1][1][at], *out]


def _sorted_words(dictionary: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A vocabulary in byte order, and the rank of each of its words."""
    order = pc.sort_indices(dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return dictionary.take(pa.array(order)), rank


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, their summed weights, and the place of each key."""
    distinct, place = np.unique(key, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, weight)
    return distinct, total, place


def _words_of(block: Block) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words as an Arrow array, the text and the piece of each
    (pieces are numbered on, over all texts), and the words' places."""
    parting = _BREAKS[block.data] | _SPACE[block.data]
    starts, ends, at = word_spans(block, ~parting)
    row = np.repeat(np.arange(block.rows), np.diff(at))
    before = np.concatenate([[0], np.cumsum(_BREAKS[block.data])])
    piece = before[starts] + row
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    raw = LOWER[block.data[~parting]].tobytes()
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), row, piece, starts


def _word_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return span_hashes(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _range_of(first: np.ndarray, second: np.ndarray | None, ranges: int) -> np.ndarray:
    """The prefix range of paths, by the hashes of their first two words."""
    h = mix(first) if second is None else mix(mix(first) * np.uint64(0xD1342543DE82EF95) + second)
    return (h % np.uint64(ranges)).astype(np.int64)


def _schema(max_words: int) -> StructType:
    """A transducer as a row: words are spelled one after the other, with a
    space behind each, and packed (a word of many phrases is spelled in many
    ranges); the other columns are the bytes of arrays, whose numbers have as
    many bytes as ``widths`` says, column by column."""
    names = ["widths", "words", "label1", "weight1", "first2", "label2", "weight2"]
    names += [f"{c}{m}" for m in range(3, max_words + 1) for c in ("arcs", "label", "weight")]
    return StructType([StructField("lang", StringType()), StructField("range", LongType()), *[StructField(n, BinaryType()) for n in names]])


_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold the largest."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(k for k in _KINDS.values() if most <= np.iinfo(k).max))


def _cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An array's bytes, cut at the given places."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _rows(langs: list, lang: list[np.ndarray], words: pa.Array, t: Transducer, ranges: int) -> pa.RecordBatch:
    """A transducer as rows, one for each language and prefix range; ``lang``
    has the language (a place in ``langs``) of each path of levels 1 and 2."""
    max_words, v = len(t.levels), np.int64(max(len(words), 1))
    hashes = _word_hashes(words)
    (label1, weight1), (first2, label2, weight2) = t.levels[:2]
    group = [lang[0] * ranges + _range_of(hashes[label1], None, ranges), lang[1] * ranges + _range_of(hashes[first2], hashes[label2], ranges)]
    for m in range(3, max_words + 1):
        group.append(group[-1][t.levels[m - 1][0]])
    order = [np.argsort(g, kind="stable") for g in group]
    used = [(group[0], label1), (group[1], first2), *[(group[m], t.levels[m][1]) for m in range(1, max_words)]]
    small = np.uint32 if len(langs) * ranges * v < 2**32 else np.int64
    pairs, place = np.unique(np.concatenate([(g * v + x).astype(small) for g, x in used]), return_inverse=True)
    pairs = pairs.astype(np.int64)
    owner = pairs // v
    groups, heads = np.unique(owner, return_index=True)
    place = place - heads[np.searchsorted(groups, owner)][place]
    local = np.split(place, np.cumsum([len(x) for _, x in used])[:-1])
    widths = []

    def cut(m: int, values: np.ndarray) -> pa.Array:
        g, values = group[m - 1][order[m - 1]], _narrow(values)
        widths.append(values.itemsize)
        return _cut(values[order[m - 1]], np.append(np.searchsorted(g, groups), len(g)))

    spelled = pc.binary_join_element_wise(words.take(pa.array(pairs % v)), b"", b" ")
    ends = np.frombuffer(spelled.buffers()[1], np.int32)[: len(spelled) + 1]
    at = np.append(heads, len(pairs))
    raw = memoryview(spelled.buffers()[2] or b"")
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(raw[ends[lo] : ends[hi]]) for lo, hi in zip(at[:-1], at[1:], strict=True)]
    whose = [pa.array(langs).take(pa.array(groups // ranges)), pa.array(groups % ranges)]
    columns = [
        pa.array(packed, pa.binary()), cut(1, local[0]), cut(1, weight1), cut(2, local[1]), cut(2, local[2]), cut(2, weight2),
    ]
    for m in range(3, max_words + 1):
        start, _, weight = t.levels[m - 1]
        arcs = np.bincount(start, minlength=len(t.levels[m - 2][-1]))
        columns += [cut(m - 1, arcs), cut(m, local[m]), cut(m, weight)]
    width = pa.repeat(pa.scalar(bytes(widths), pa.binary()), len(groups))
    return pa.RecordBatch.from_arrays([*whose, width, *columns], names=_schema(max_words).names)


def _shard(block: Block, langs: pa.Array, max_words: int, ranges: int) -> pa.RecordBatch | None:
    """The count transducers of a block's texts."""
    spelled, row, piece, _ = _words_of(block)
    if not len(spelled):
        return None
    coded = spelled.dictionary_encode()
    words, rank = _sorted_words(coded.dictionary)
    label = rank[coded.indices.to_numpy()]
    names = langs.dictionary_encode()
    v, n, levels, parents = np.int64(len(words)), len(label), [], []
    start = names.indices.to_numpy().astype(np.int64)[row]
    for m in range(1, max_words + 1):
        inside = np.flatnonzero(piece[: max(n - m + 1, 0)] == piece[m - 1 :]) if m <= n else np.zeros(0, np.int64)
        keys = start[inside] * v + label[inside + m - 1]
        distinct, path, count = np.unique(keys, return_inverse=True, return_counts=True)
        levels.append((distinct % v, count.astype(np.int64)))
        parents.append(distinct // v)
        start = np.full(n, -1)
        start[inside] = path
    lang1 = parents[0]
    first, arcs = levels[0], [(levels[0][0][parents[1]], *levels[1])]
    arcs += [(parents[m], *levels[m]) for m in range(2, max_words)]
    return _rows(names.dictionary.to_pylist(), [lang1, lang1[parents[1]]], words, Transducer(words, [first, *arcs]), ranges)


def shard_transducers(docs: DataFrame, ranges: int, max_words: int = MAX_WORDS) -> DataFrame:
    """The count transducers of all shards of ``docs`` (``lang``, ``text``), by range."""
    schema = _schema(max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), SHARD_BYTES):
                out = _shard(block, batch.column(0)[block.lo : block.hi], max_words, ranges)
                if out is not None:
                    yield out

    return docs.select("lang", "text").mapInArrow(run, schema)


def _joined(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column, one row after the other, and how many each row has."""
    place = table.column_names.index(name) - table.column_names.index("label1")
    parts = [np.frombuffer(raw, _KINDS[w[place]]) for raw, w in zip(table[name].to_pylist(), table["widths"].to_pylist(), strict=True) if w]
    sizes = np.array([len(x) for x in parts], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), sizes


def _read(table: pa.Table, max_words: int) -> Transducer:
    """The transducers of a table's rows in one: the union, with summed weights."""
    table = table.filter(pc.greater(pc.binary_length(table["widths"]), 0))
    unpacker = zstandard.ZstdDecompressor()
    spelled = [unpacker.decompress(x) for x in table["words"].to_pylist()]
    sizes, data = np.array([len(x) for x in spelled], np.int64), np.frombuffer(b"".join(spelled), np.uint8)
    behind = np.flatnonzero(data == 0x20)
    offsets = np.concatenate([[0], behind - np.arange(len(behind))]).astype(np.int32)
    spelled = pa.Array.from_buffers(pa.binary(), len(behind), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 0x20].tobytes())])
    coded = spelled.dictionary_encode()
    words, rank = _sorted_words(coded.dictionary)
    label = rank[coded.indices.to_numpy()]
    base = np.searchsorted(behind, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    v = np.int64(max(len(words), 1))

    def labels(name: str) -> np.ndarray:
        local, count = _joined(table, name)
        return label[local + np.repeat(base, count)] if len(local) else local

    one, total, _ = _summed(labels("label1"), _joined(table, "weight1")[0])
    two, weight, place = _summed(labels("first2") * v + labels("label2"), _joined(table, "weight2")[0])
    levels = [(one, total), (two // v, two % v, weight)]
    for m in range(3, max_words + 1):
        arcs, _ = _joined(table, f"arcs{m}")
        start = np.repeat(place, arcs)
        keys, weight, place = _summed(start * v + labels(f"label{m}"), _joined(table, f"weight{m}")[0])
        levels.append((keys // v, keys % v, weight))
    return Transducer(words, levels)


def _pruned(t: Transducer, least: int) -> Transducer:
    """Without the paths below the least count; what follows one is below it too."""
    levels, at = [], None
    for m, arcs in enumerate(t.levels, 1):
        keep = arcs[-1] >= least
        if m > 2:
            keep &= at[arcs[0]] >= 0
            arcs = (at[arcs[0]], *arcs[1:])
        at = np.where(keep, np.cumsum(keep) - 1, -1)
        levels.append(tuple(x[keep] for x in arcs))
    return Transducer(t.words, levels)


def count_transducers(docs: DataFrame, ranges: int, max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> DataFrame:
    """A row for each language and prefix range: its count transducer over
    all ``docs`` (paths of ``least`` and more), and ``n``, the occurrences of the
    single words that lie in it, rare ones too."""
    schema = StructType([*_schema(max_words).fields, StructField("n", LongType())])

    def union(table: pa.Table) -> pa.Table:
        t = _read(table, max_words)
        n = int(t.levels[0][-1].sum())
        kept = _pruned(t, least)
        lang = [np.zeros(len(kept.levels[0][-1]), np.int64), np.zeros(len(kept.levels[1][-1]), np.int64)]
        own = table["lang"][0].as_py()
        rows = _rows([own], lang, kept.words, kept, 1)
        if not rows.num_rows:
            empty = [pa.array([own]), pa.array([0]), *[pa.array([b""])] * (len(schema) - 3)]
            rows = pa.RecordBatch.from_arrays(empty, names=schema.names[:-1])
        columns = [rows.column(0), table["range"][:1].combine_chunks(), *rows.columns[2:], pa.array([n])]
        return pa.Table.from_arrays(columns, names=schema.names)

    return shard_transducers(docs, ranges, max_words).groupBy("lang", "range").applyInArrow(union, schema)


def _phrase(words: pa.Array, labels: list[np.ndarray]) -> pa.Array:
    parts = [words.take(pa.array(x)) for x in labels]
    return pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]


_CUTS = StructType(
    [StructField("lang", StringType()), StructField("a", LongType()), StructField("k", LongType())]
    + [StructField(f"{side}{c}", t) for side in ("left", "right") for c, t in (("", StringType()), ("_range", LongType()))]
)


def cuts(transducers: DataFrame, ranges: int, max_words: int = MAX_WORDS) -> DataFrame:
    """Every path of 2 words and more, cut after each word but the last: a
    row with its count, and both parts with their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(i, 1)])
                t = _read(table, max_words)
                hashes = _word_hashes(t.words)
                for m in range(2, max_words + 1):
                    path, weight = t.paths(m), t.levels[m - 1][-1]
                    if not len(weight):
                        continue
                    for k in range(1, m):
                        columns = [pa.repeat(table["lang"][0], len(weight)), pa.array(weight), pa.repeat(pa.scalar(k), len(weight))]
                        for part in (path[:k], path[k:]):
                            to = _range_of(hashes[part[0]], hashes[part[1]] if len(part) > 1 else None, ranges)
                            columns += [_phrase(t.words, part).cast(pa.string()), pa.array(to)]
                        yield pa.RecordBatch.from_arrays(columns, names=_CUTS.names)

    return transducers.drop("n").mapInArrow(run, _CUTS)


def part_counts(transducers: DataFrame, asked: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``asked`` (``lang``, ``range``, ``part``; distinct) with the parts'
    counts ``f``: each range's parts composed with its transducer."""
    schema = StructType([StructField("lang", StringType()), StructField("part", StringType()), StructField("f", LongType())])

    def composed(parts: pa.Table, rows: pa.Table) -> pa.Table:
        if not parts.num_rows:
            return pa.Table.from_batches([], pa.schema([("lang", pa.string()), ("part", pa.string()), ("f", pa.int64())]))
        t = _read(rows, max_words)
        spelled = pc.split_pattern(parts["part"].combine_chunks(), " ")
        size, flat = pc.list_value_length(spelled).to_numpy(), pc.list_flatten(spelled).cast(pa.binary())
        label = pc.fill_null(pc.index_in(flat, value_set=t.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        head = np.concatenate([[0], np.cumsum(size)[:-1]])
        f = np.zeros(len(size), np.int64)
        for m in np.unique(size):
            some = np.flatnonzero(size == m)
            f[some] = t.compose([label[head[some] + j] for j in range(m)])
        return pa.Table.from_arrays([parts["lang"], parts["part"], pa.array(f)], names=schema.names)

    by = ["lang", "range"]
    return asked.groupBy(*by).cogroup(transducers.drop("n").groupBy(*by)).applyInArrow(composed, schema)


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP, percent: int = 50, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language:
    ``lang``, ``rank``, ``phrase``, its count ``a``, the counts ``l`` and ``r``
    of the parts at its worst cut, ``n`` words of the language, and ``score``,
    floor(1000000 * a * a / (l * r)) there.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line
    ends and these into words at spaces and tabs; phrases lie within a piece and
    have a count of ``least`` or more. A phrase with a longer one around it that
    has ``percent`` of its count is left out, whatever becomes of the longer one.
    Ties go to the larger count, then the smaller phrase by its bytes. A null
    text is an empty one, a null language is ``und``; repeated rows each count;
    an empty table gives no rows; other columns are not read.
    """
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words at least, and a count of one")
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = size // RANGE_BYTES + 1
    transducers = materialize(count_transducers(texts, ranges, max_words, least))
    cut = materialize(cuts(transducers, ranges, max_words))
    sides = [cut.select("lang", F.col(f"{s}_range").alias("range"), F.col(s).alias("part")) for s in ("left", "right")]
    counts = materialize(part_counts(transducers, sides[0].union(sides[1]).distinct(), max_words))
    # a very frequent part is a skewed key of the cuts, which adaptive execution splits
    cut = cut.drop("left_range", "right_range")
    for side, f in (("left", "l"), ("right", "r")):
        cut = lookup(cut, counts.select("lang", F.col("part").alias(side), F.col("f").alias(f)), ["lang", side], 1, "inner")
    cut = cut.withColumn("phrase", F.concat_ws(" ", "left", "right"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    cut = cut.withColumns({f"_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("(_a * _a * 1000000BD) div (_l * _r)"))
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_c"))
    scored = materialize(scored.select("lang", "phrase", "a", "_c.score", "_c.l", "_c.r"))

    # the largest count of a longer phrase around each phrase
    spelled = F.split("phrase", " ")
    whole = scored.select("lang", "a", spelled.alias("_w")).where(F.size("_w") > 2)
    inner = whole.select("lang", "a", "_w", F.explode(F.sequence(F.lit(2), F.size("_w") - 1)).alias("_m"))
    inner = inner.select("lang", "a", "_w", "_m", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_m") + 1)).alias("_i"))
    inner = inner.groupBy("lang", F.array_join(F.slice("_w", F.col("_i"), F.col("_m")), " ").alias("phrase")).agg(F.max("a").alias("_longer"))
    scored = lookup(scored, materialize(inner), ["lang", "phrase"], 1)  # both have a phrase once
    scored = scored.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")

    # the best of small shares first, then of larger ones: a task ranks SHARES * top rows of a language at most
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares, best = SHARES ** max(1, math.ceil(math.log(ranges, SHARES))), scored
    while shares > 1:
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        best = best.withColumn("_share", share).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order)))
        best, shares = best.where(F.col("_r") <= top).drop("_r", "_share"), shares // SHARES
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = materialize(transducers.groupBy("lang").agg(F.sum("n").alias("n")))
    return lookup(ranked, n, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
