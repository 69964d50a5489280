"""Operator 2: passages that repeat across documents, by paragraph MinHash.

Paragraphs are of two kinds. A text's own ones are its lines and its blocks
(lines with no blank line between them) of ``MIN_WORDS`` words or more; a
whole text without blank lines is a block only if none of its lines is that
long. But passages do not begin where lines do, so paragraphs are also cut by
content. Of every ``ANCHOR_WINDOW`` consecutive word pairs the one of the
least hash is an anchor; a cut paragraph goes from an anchor to the first
anchor at least ``MIN_WORDS`` words on. Equal words give equal anchors whatever stands around
them, and a passage of 50 words holds a whole paragraph wherever it lies:
12 pairs to its first anchor, 24 words, 12 more to the next.

A text's own paragraphs have ``OWN_BANDS`` bands of two MinHash values over
their five-word shingles: two of similarity 0.8 miss each other with a
probability of (1 - 0.8**2)**6, 0.2 %, wherever they differ. Cut paragraphs
are there for passages that repeat word for word. They have ``BANDS`` bands
of one value, and a band's key joins it with the word pair at the anchor,
else the overlapping paragraphs of one text would all meet each other. Cut
paragraphs at different anchors are thus not compared, those at the same one
miss each other at 0.8 in 4 % of cases, and one changed word can take a piece
so short below 0.8: an edited stretch within a longer line or block that is
not itself like another may stay. The texts are read three times
so that little is shuffled. First the keys alone, to find those that occur
twice: a bitmap of these, sized by their number up to a limit, lets few other
paragraphs leave their task in the second reading (very many repeated keys let
more pass; all that follows is exact). The third gives the places.

Equal paragraphs are one class. Classes that share a key with the least class
of its bucket are compared with it on full shingle sets, members still apart
by the exact prefix join of :mod:`.minhash_dedup`, and the links joined into
components; a component's first document keeps its passage, the others lose it.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.materialize import materialize
from .components import components
from .minhash_dedup import links_within_buckets, verified
from .tables import TWO_PLACES, bitmap_of, in_bitmap
from .textblocks import LOWER, SPACES, Block, blocks, combined, mix, row_of, span_hashes, windows, word_spans

MIN_WORDS = 24
ANCHOR_WINDOW = 13
SHINGLE = 5
#: bytes of a run of texts; its arrays of words and shingles stay in the processor's cache
RUN_BYTES = 1 << 18
BANDS = 2
OWN_BANDS = 6

_rng = np.random.default_rng(20230917)
_A = _rng.integers(1, 2**62, BANDS + 2 * OWN_BANDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.uint64(0xD1342543DE82EF95)
_PLACE = (1 << 28) - 1


class Paragraphs:
    """The paragraphs of a block: text, number in it, first and end word; and,
    made when they are asked for, digests, shingle hashes and keys."""

    def __init__(self, block: Block):
        self.starts, self.ends, at = word_spans(block, ~SPACES[block.data])
        self.words = span_hashes(LOWER[block.data], self.starts, self.ends)
        pairs, of = windows(at, 2)
        anchors, texts = _anchors(mix(combined(self.words, pairs, 2)), pairs, of)
        stop = np.searchsorted(anchors, anchors + MIN_WORDS)
        inside = stop < len(anchors)
        inside[inside] = texts[stop[inside]] == texts[inside]
        n = len(self.words) + 1
        cut = anchors[inside] * n + anchors[stop[inside]]  # ascending, each once
        first, end = _own_paragraphs(block, self.starts, self.ends, at)
        own = np.sort(first * n + end)
        spans = np.sort(np.concatenate([cut, own]), kind="stable")  # two ascending runs are merged
        spans = spans[np.append(spans[1:] != spans[:-1], len(spans) > 0)] if len(spans) else spans
        self.first, self.end = np.divmod(spans, n)
        self.text = row_of(at)[self.first]
        #: the kinds: bands x paragraphs, whether a paragraph has the band's key
        kinds = np.zeros((2, len(spans)), bool)
        kinds[0, np.searchsorted(spans, cut)] = True
        kinds[1, np.searchsorted(spans, own)] = True
        self.has = np.repeat(kinds, [BANDS, OWN_BANDS], axis=0)
        self.number = np.arange(len(self.text)) - np.searchsorted(self.text, self.text)

    @cached_property
    def digest(self) -> np.ndarray:
        """A polynomial hash of the words of each paragraph, from running sums."""
        n = len(self.words)
        up, down = np.full(n + 1, _ORDER, np.uint64), np.full(n + 1, pow(int(_ORDER), -1, 2**64), np.uint64)
        up[:1] = down[:1] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.first]) * down[self.first] + (self.end - self.first).astype(np.uint64))

    @cached_property
    def shingles(self) -> np.ndarray:
        return combined(self.words, np.arange(max(len(self.words) - SHINGLE + 1, 0)), SHINGLE)

    @cached_property
    def keys(self) -> np.ndarray:
        out = np.zeros(self.has.shape, np.uint64)

        def least(which: np.ndarray, value: np.ndarray) -> np.ndarray:
            bounds = np.stack([self.first[which], self.end[which] - SHINGLE + 1], axis=1).ravel()
            return np.minimum.reduceat(np.append(value, np.uint64(2**64 - 1)), bounds)[::2]

        if len(cut := np.flatnonzero(self.has[0])):
            anchor = combined(self.words, self.first[cut], 2)
            for b in range(BANDS):
                out[b, cut] = mix(least(cut, mix(self.shingles * _A[b])) + anchor * np.uint64(2 * b + 1))
        if len(own := np.flatnonzero(self.has[-1])):
            for b in range(OWN_BANDS):
                one, two = (least(own, mix(self.shingles * _A[BANDS + 2 * b + j])) for j in range(2))
                out[BANDS + b, own] = mix(mix(one + np.uint64(b + 1)) * _ORDER + two)
        return out


def _own_paragraphs(block: Block, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the lines and blocks of ``MIN_WORDS`` words or
    more; a block that is one line comes twice."""
    n, text = len(starts), row_of(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feed = block.data == 10
    feed |= (block.data == 13) & ~np.append(feed[1:], False)  # of CR LF only one counts
    feeds = np.concatenate([[0], np.cumsum(feed)])
    gap = feeds[starts[1:]] - feeds[ends[:-1]]
    gap[text[1:] != text[:-1]] = 2
    lines = np.flatnonzero(np.append(2, gap) > 0)
    runs = np.flatnonzero(np.append(2, gap) > 1)
    line_end, run_end = np.append(lines[1:], n), np.append(runs[1:], n)
    long = line_end - lines >= MIN_WORDS
    # a whole text that has long lines is no paragraph: its lines are
    whole = (runs == at[text[runs]]) & (run_end == at[text[runs] + 1])
    has_long = np.bincount(text[lines[long]], minlength=block.rows)[text[runs]] > 0
    taken = (run_end - runs >= MIN_WORDS) & ~(whole & has_long)
    return np.concatenate([lines[long], runs[taken]]), np.concatenate([line_end[long], run_end[taken]])


def _anchors(hashes: np.ndarray, pairs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which an anchor stands, ascending, and their texts."""
    first, starts = windows(of, ANCHOR_WINDOW)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(hashes))
    least = (hashes & ~np.uint64(_PLACE)) | place.astype(np.uint64)
    width = 1
    while width * 2 <= ANCHOR_WINDOW:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[first], least[first + ANCHOR_WINDOW - width])
    chosen = (least & np.uint64(_PLACE)).astype(np.int64)
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    return pairs[chosen[new]], row_of(starts)[new]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Each key once, or twice if it occurs more often, ascending."""
    keys = np.sort(keys)
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    return keys[~same | (same & np.append(True, ~same[:-1]))]


def _repeated_keys(source: DataFrame) -> DataFrame:
    """The keys (``_key``) that two paragraphs or more have. Keys travel as
    packed bytes, dealt into buckets by their own bits; a batch sends a key
    at most twice, so a very common one stays small everywhere."""
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * tasks

    def pack(batches):
        for batch in batches:
            keys = [p.keys[p.has] for p in map(Paragraphs, blocks(batch.column(1), RUN_BYTES))]
            keys = _twice(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            bucket = ((keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            packed = [keys[order[cuts[i] : cuts[i + 1]]].tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packed, pa.binary())], names=["_bucket", "_keys"])

    def unpack(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(bucket, []).append(np.frombuffer(packed.as_buffer(), np.uint64).copy())
                size += len(held[bucket][-1])
            if size > 1 << 23:
                held = {k: [_twice(np.concatenate(v))] for k, v in held.items()}
                size = 0
        for parts in held.values():
            keys = _twice(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(keys[1:][keys[1:] == keys[:-1]].view(np.int64))], names=["_key"])

    packed = source.mapInArrow(pack, "_bucket long, _keys binary")
    return packed.repartition(tasks, "_bucket").mapInArrow(unpack, "_key long")


def _classes(source: DataFrame, bitmap) -> DataFrame:
    """The classes of equal paragraphs that may have a repeated key: digest,
    keys (null for those that no other paragraph has, and for bands of a kind
    that none of them is of), number of paragraphs and the least and largest id."""
    keys = [f"_k{b}" for b in range(BANDS + OWN_BANDS)]
    schema = StructType([source.schema["_id"], *[StructField(c, LongType()) for c in ("_digest", *keys)]])

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1), RUN_BYTES):
                p = Paragraphs(b)
                maybe = np.zeros(p.has.shape, bool)
                maybe[p.has] = in_bitmap(bitmap, p.keys[p.has], TWO_PLACES)
                k = np.flatnonzero(maybe.any(axis=0))
                ids = batch.column(0).take(pa.array(b.lo + p.text[k]))
                found = [pa.array(c[k].view(np.int64), mask=~m[k]) for c, m in zip(p.keys, maybe, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(p.digest[k].view(np.int64)), *found], names=schema.names)

    rows = source.mapInArrow(run, schema).groupBy("_digest")
    return rows.agg(*[F.min(k).alias(k) for k in keys], F.count(F.lit(1)).alias("_c"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))


def _occurrences(source: DataFrame, bitmap) -> DataFrame:
    """The paragraphs whose digest may be in the bitmap, with their places."""
    numbers = ["_digest", "paragraph", "first_word", "end_word", "start", "end"]
    schema = StructType([source.schema["_id"], *[StructField(c, LongType()) for c in numbers]])

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1), RUN_BYTES):
                p = Paragraphs(b)
                k = np.flatnonzero(in_bitmap(bitmap, p.digest, TWO_PLACES))
                points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
                head = b.offsets[p.text[k]]
                word = np.searchsorted(p.starts, head)
                columns = (
                    p.digest[k].view(np.int64), p.number[k], p.first[k] - word, p.end[k] - word,
                    points[p.starts[p.first[k]]] - points[head], points[p.ends[p.end[k] - 1]] - points[head],
                )
                ids = batch.column(0).take(pa.array(b.lo + p.text[k]))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int64)) for c in columns]], names=schema.names)

    return source.mapInArrow(run, schema)


def _before(values: np.ndarray) -> np.ndarray:
    """Where each value stands last before its place, -1 where it does not."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def _shingle_sets(source: DataFrame, bitmap) -> DataFrame:
    """Digest and shingle set of the paragraphs whose digest may be wanted.
    Of a paragraph's shingles those count that do not stand in it before."""
    schema = StructType([StructField("_id", LongType()), StructField("_set", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1), RUN_BYTES):
                p = Paragraphs(b)
                _, k = np.unique(p.digest, return_index=True)
                k = k[in_bitmap(bitmap, p.digest[k], TWO_PLACES)]
                first, sizes = p.first[k], p.end[k] - SHINGLE + 1 - p.first[k]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
                new = _before(p.shingles)[at] < np.repeat(first, sizes)
                offsets = np.concatenate([[0], np.cumsum(new)])[offsets].astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.shingles[at[new]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(p.digest[k].view(np.int64)), sets], names=schema.names)

    return source.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each paragraph that also stands in another document, in a
    like form: ``id_col``, ``paragraph`` (its number in the text), ``first_word``
    and ``end_word``, ``start`` and ``end`` (code points, ends exclusive),
    ``cluster_id`` (the smallest id of a document in its cluster),
    ``copies`` (paragraphs in the cluster) and ``removed`` (all but those of
    the cluster's first document, by id). Paragraphs overlap; what goes from
    a text is the union of its removed spans. Lines and blocks go whole. Of a
    repeated passage that is neither, what lies between its first and last
    anchor goes: up to 12 words at either end stay, although they repeat too.

    Likeness is a Jaccard similarity of five-word shingles of ``percent`` per
    cent or more, directly or over other paragraphs; words are compared with
    A-Z lower-cased. A line or block that repeats as one is found from
    ``MIN_WORDS`` words on, a passage that lies elsewhere surely from 50 on
    (24 to 49: if it happens to hold a cut paragraph). What has fewer than
    ``MIN_WORDS`` words is no paragraph, so short lines, and texts that are
    that short, empty or null, give no rows. Rows that share an id are one document and do
    not repeat each other; rows without an id are left out. An empty table
    gives no rows; other columns are not read.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    classes = materialize(_classes(source, bitmap_of(materialize(_repeated_keys(source)), "_key", TWO_PLACES)))

    # buckets of several classes; each class meets the bucket's least one
    members = classes.select(F.explode(F.array(*[c for c in classes.columns if c.startswith("_k")])).alias("_key"), "_digest")
    members = members.where("_key IS NOT NULL")
    least = members.groupBy("_key").agg(F.min("_digest").alias("a"), F.max("_digest").alias("_top")).where("a < _top").drop("_top")
    crowd = materialize(members.join(least, "_key").where("_digest <> a").select("_key", "a", F.col("_digest").alias("b")))
    pairs = materialize(crowd.select("a", "b").distinct())
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    sets = materialize(_shingle_sets(source, bitmap_of(used, "_id", TWO_PLACES)).join(used, "_id", "left_semi").dropDuplicates(["_id"]))
    links = materialize(verified(pairs, sets, percent))
    roots = components(links)
    more = links_within_buckets(crowd, roots, sets, percent)
    if more is not None:
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # class -> cluster, then the cluster's extent; both tables hold one row per class
    rooted = classes.join(roots, F.col("_digest") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_digest"))
    rooted = materialize(rooted.select("_digest", "_root", "_c", "_lo", "_hi"))
    clusters = rooted.groupBy("_root").agg(F.sum("_c").alias("copies"), F.min("_lo").alias("cluster_id"), F.max("_hi").alias("_last"))
    verdicts = rooted.select("_digest", "_root").join(clusters.where("cluster_id < _last").drop("_last"), "_root").drop("_root")
    verdicts = materialize(verdicts)
    # an inner join of two shuffled sides: a passage that very many documents
    # share is a skewed key of the first, which adaptive execution splits
    out = _occurrences(source, bitmap_of(verdicts, "_digest", TWO_PLACES)).join(verdicts, "_digest")
    return out.select(
        F.col("_id").alias(id_col), "paragraph", "first_word", "end_word", "start", "end", "cluster_id", "copies",
        (F.col("_id") != F.col("cluster_id")).alias("removed"),
    )
