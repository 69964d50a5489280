"""Operator 13: audit of how sources diverge, from CountVectorizer vectors.

One CountVectorizer (``minDF``, the largest integer as ``vocabSize``) fits the
vocabularies of all languages at once, because terms carry their language. Every
document then becomes the exact sparse vector of its counts in that
vocabulary, and the vectors of a (language, source) group are summed, sparsely,
inside the tasks that make them and then by key. (The vectors equal those of the
model's ``transform``, but are made from Arrow batches: over lists of strings the
operator took 4,500 task seconds a GB instead of 2,650.)

A group gives a term that it lacks the same smoothed probability as any other
it lacks. So two sources are compared by the terms they have: what a source's
own terms add against the other's constant, and a correction for the terms that
both have. The terms of a language are dealt into blocks, each block sums its
terms for all pairs of sources, and the blocks' sums are added up.

A fitted vocabulary lies on the driver. Its size is bounded: if the terms, rare
ones too, may be more than ``FIT_TERMS``, they are dealt by hash into so many
parts that none is larger, and each part is fitted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..operators.materialize import materialize
from .tables import lookup
from .textblocks import LOWER, Block, blocks, row_of, span_hashes, word_spans

MIN_DOCS = 10
TOP_TERMS = 10
#: most different terms of a fit, and entries that a task sums up before it passes them on
FIT_TERMS = 4_000_000
TASK_ENTRIES = 1 << 20
#: sources of a tile and rows of a block of the pair evaluation
TILE = 512
BLOCK_ROWS = 100_000

#: bytes of text that are looked up in the vocabulary at once
LOOKUP_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: parts a language from a term; no term holds it
_MARK = "\x01"


def _terms(block: Block, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of a block's texts: the text and the code of each, and the
    different terms by code, with their language in front."""
    inside = _LETTER[block.data]
    starts, ends, at = word_spans(block, inside)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    raw = LOWER[block.data[inside]].tobytes()
    spelled = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    lang = langs.dictionary_encode()
    row, v = row_of(at), np.int64(max(len(spelled.dictionary), 1))
    cell = lang.indices.to_numpy().astype(np.int64)[row] * v + spelled.indices.to_numpy()
    if len(lang.dictionary) * v <= 8 * max(len(cell), 1):
        used = np.bincount(cell, minlength=len(lang.dictionary) * v) > 0
        pairs, code = np.flatnonzero(used), (np.cumsum(used) - 1)[cell]
    else:
        pairs, code = np.unique(cell, return_inverse=True)
    fronts = pc.binary_join_element_wise(lang.dictionary, "", _MARK)
    return row, code, pc.binary_join_element_wise(fronts.take(pa.array(pairs // v)), spelled.dictionary.take(pa.array(pairs % v)), "")


def _hashes(spelled: pa.Array) -> np.ndarray:
    if not len(spelled):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(spelled.buffers()[1], np.int32)[: len(spelled) + 1].astype(np.int64)
    return span_hashes(np.frombuffer(spelled.buffers()[2], np.uint8), offsets[:-1], offsets[1:])


def _term_count(docs: DataFrame) -> int:
    """About how many different terms there are, rare ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2), LOOKUP_BYTES):
                _, _, spelled = _terms(b, batch.column(0)[b.lo : b.hi])
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(spelled).view(np.int64))], names=["h"])

    return docs.mapInArrow(run, "h long").agg(F.approx_count_distinct("h", 0.02)).first()[0]


def _term_sets(docs: DataFrame, part: int, parts: int) -> DataFrame:
    """A list of the different terms of each document, those of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                row, code, spelled = _terms(b, batch.column(0)[b.lo : b.hi])
                if parts > 1:
                    mine = (_hashes(spelled) % np.uint64(parts) == np.uint64(part))[code]
                    row, code = row[mine], code[mine]
                v = np.int64(max(len(spelled), 1))
                own = np.sort(row * v + code)
                own = own[np.append(True, own[1:] != own[:-1])[: len(own)]]
                at = np.searchsorted(own // v, np.arange(b.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), spelled.take(pa.array(own % v)))], names=["terms"])

    return docs.mapInArrow(run, StructType([StructField("terms", ArrayType(StringType()))]))


def document_vectors(block: Block, langs: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse vectors of a block's texts as (text, index in the
    vocabulary, count), by text and index."""
    row, code, spelled = _terms(block, langs)
    index = pc.fill_null(pc.index_in(spelled, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    v = np.int64(max(len(vocabulary), 1))
    known = index[code] >= 0
    cells, count = np.unique(row[known] * v + index[code[known]], return_counts=True)
    return cells // v, cells % v, count


def _group_sums(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per (``lang``, ``source``, ``term``) the summed ``count`` of the documents' vectors."""
    words = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))
    schema = StructType([StructField(c, StringType()) for c in ("lang", "source", "term")] + [StructField("count", LongType())])
    v = np.int64(len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            groups, group = list(names), pa.array(keys // v)
            columns = [pa.array([g[i] for g in groups], pa.string()).take(group) for i in (0, 1)]
            term = pc.list_element(pc.split_pattern(words.value.take(pa.array(keys % v)), _MARK, max_splits=1, reverse=True), 1)
            return pa.RecordBatch.from_arrays([*columns, term, pa.array(total)], names=schema.names)

        for batch in batches:
            named = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            group = np.array([names.setdefault(g, len(names)) for g in named], np.int64)
            for b in blocks(batch.column(2), LOOKUP_BYTES):
                row, index, count = document_vectors(b, batch.column(0)[b.lo : b.hi], words.value)
                keys, place = np.unique(np.concatenate([keys, group[b.lo + row] * v + index]), return_inverse=True)
                before, total = total, np.zeros(len(keys), np.int64)
                np.add.at(total, place, np.concatenate([before, count]))
                if len(keys) >= TASK_ENTRIES:
                    yield out()
                    keys, total = keys[:0], total[:0]
        if len(keys):
            yield out()

    return docs.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))


def group_term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, fit_terms: int = FIT_TERMS) -> DataFrame:
    """The kept terms of ``docs`` (``lang``, ``source``, ``text``) with their
    count in each group that has them: ``lang``, ``source``, ``term``, ``count``."""
    # an estimate of 2 % deviation: a tenth more than the estimate is a bound
    parts = int(_term_count(docs) * 1.1) // fit_terms + 1
    out = None
    for part in range(parts):
        vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1)
        try:
            model = vectorizer.fit(_term_sets(docs, part, parts))
        except IllegalArgumentException as e:
            if "vocabulary size" not in str(e):
                raise
            continue  # no term of this part is in so many documents
        sums = _group_sums(docs, model.vocabulary)
        out = sums if out is None else out.unionByName(sums)
    if out is None:
        out = docs.select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("count")).limit(0)
    return out


def _probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (n + 2 * v)), exactly."""
    c, small = count.cast("long"), F.lit(1).cast("long") + F.call_function("div", (count.cast("long") + 2) * 10**9, n + v * 2)
    wide = F.call_function("div", (count.cast("decimal(20,0)") + 2) * F.lit(10**9).cast("decimal(10,0)"), (n + v * 2).cast("decimal(20,0)"))
    return F.when(c < 2**33, small).otherwise(F.lit(1).cast("long") + wide)


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(table: pa.Table) -> pa.Table:
    """The sums of one block of terms over all pairs of the sources of two
    tiles. Rows without a term name the sources, ``p`` is there what they give
    to a term that they lack and ``terms`` the number of the block's terms."""
    named = table.filter(table["term"].is_null())
    order = np.argsort(named["no"].to_numpy())
    names, no = named["source"].take(pa.array(order)), named["no"].to_numpy()[order]
    tile, base, terms = named["tile"].to_numpy()[order], named["p"].to_numpy()[order], int(named["terms"][0].as_py())
    rows = table.filter(table["term"].is_valid())
    source, p = np.searchsorted(no, rows["no"].to_numpy()), rows["p"].to_numpy()
    term = rows["term"].combine_chunks().dictionary_encode()
    term = (term.indices if isinstance(term, pa.DictionaryArray) else term.combine_chunks().indices).to_numpy()
    n = len(no)

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b) ** 2 // (a + b)

    # a source's own terms against the others' constants, equal probabilities at once
    alone = np.zeros((n, n), np.int64)
    pairs, times = np.unique(np.stack([source, p]), axis=1, return_counts=True) if len(p) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    for lo in range(0, len(times), 4096):
        s, x, t = pairs[0, lo : lo + 4096], pairs[1, lo : lo + 4096], times[lo : lo + 4096]
        np.add.at(alone, s, f(x[:, None], base[None, :]) * t[:, None])
    held = np.bincount(source, minlength=n)
    constant = f(base[:, None], base[None, :])
    total = alone + alone.T + (terms - held[:, None] - held[None, :]) * constant

    # terms that both have: rows of a term stand next to each other
    order = np.lexsort((source, term))
    source, p, term = source[order], p[order], term[order]
    both = np.zeros((n, n), np.int64)
    left = np.arange(len(term))
    for apart in range(1, n):
        left = left[left + apart < len(term)]
        left = left[term[left] == term[left + apart]]
        if not len(left):
            break
        a, b, x, y = source[left], source[left + apart], p[left], p[left + apart]
        np.add.at(both, (a, b), f(x, y) - f(x, base[b]) - f(base[a], y) + constant[a, b])
    total += both + both.T
    a, b = np.nonzero(~np.eye(n, dtype=bool) & ((tile[:, None] != tile[None, :]) | (tile.min() == tile.max())))
    columns = [pa.repeat(table["lang"][0], len(a)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(total[a, b])]
    return pa.Table.from_arrays(columns, names=["lang", "source", "item", "value"])


def _pairs(entries: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """``lang``, ``source``, ``item`` (each other source) and ``value`` from
    ``entries`` (``lang``, ``no``, ``term``, ``p``) and ``groups`` (``lang``,
    ``source``, ``no``, ``p``, number of ``sources`` of the language)."""
    most = groups.agg(F.max("no")).first()[0] or 1
    blocks = entries.count() // max(BLOCK_ROWS, min(most, tile) ** 2) + 1
    tiles = F.floor((F.col("sources") - 1) / tile)
    entries = entries.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    sizes = entries.groupBy("lang", "block", "term").agg(F.lit(1)).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    every = groups.select("lang").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    sizes = materialize(every.join(sizes, ["lang", "block"], "left").select("lang", "block", F.coalesce("terms", F.lit(0).cast("long")).alias("terms")))
    named = groups.join(sizes, "lang").select("lang", "block", "source", "no", "sources", F.lit(None).cast("string").alias("term"), "p", "terms")
    rows = entries.select("lang", "block", F.lit(None).cast("string").alias("source"), "no", "sources", "term", "p", F.lit(0).cast("long").alias("terms"))
    rows = named.unionByName(rows).withColumn("tile", F.floor((F.col("no") - 1) / tile))
    rows = rows.withColumn("_u", F.explode(F.sequence(F.lit(0).cast("long"), tiles)))
    rows = rows.withColumns({"_i": F.least("tile", "_u"), "_j": F.greatest("tile", "_u")}).drop("_u", "sources")
    schema = StructType([StructField(c, StringType()) for c in ("lang", "source", "item")] + [StructField("value", LongType())])
    return rows.groupBy("lang", "block", "_i", "_j").applyInArrow(_pair_sums, schema).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    fit_terms: int = FIT_TERMS, tile: int = TILE,
) -> DataFrame:
    """How the sources of each language diverge: ``lang``, ``source``,
    ``part``, ``item``, ``value`` and ``rank`` (from 1, by value descending and
    item ascending).

    A language keeps the terms (runs of letters, here A-Z, a-z and all beyond
    ASCII, A-Z lower-cased) of ``min_docs`` documents or more. A group, and
    a language, gives each of the V kept terms p = 1 + floor(10**9 * (count +
    2) / (N + 2 * V)), N being its occurrences of kept terms. Part ``pair`` has
    for each other source of the language the sum of floor((p - q)**2 / (p + q))
    over all kept terms; part ``term`` the ``top`` terms of the group that it
    gives more than the language does, with that value.

    Null texts, languages and sources are empty ones; repeated rows each count;
    a group without terms is compared too, and the only source of its language
    has no rows. An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = materialize(group_term_counts(texts, min_docs, fit_terms))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("N"))
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    kept = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("count").alias("lang_N"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["N", "V", "lang_N"])
    per_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"no": F.row_number().over(per_lang.orderBy("source")).cast("long"), "sources": F.count(F.lit(1)).over(per_lang)})
    none = _probability(F.lit(0), F.col("N"), F.col("V"))
    groups = materialize(groups.withColumn("p", F.when(F.col("V") > 0, none).otherwise(F.lit(1).cast("long"))))

    totals = counts.withColumn("_all", F.sum("count").over(Window.partitionBy("term", "lang")))
    entries = lookup(totals, groups.drop("p"), ["lang", "source"], how="inner")
    entries = entries.withColumns({"p": _probability(F.col("count"), F.col("N"), F.col("V")), "q": _probability(F.col("_all"), F.col("lang_N"), F.col("V"))})
    entries = materialize(entries.select("lang", "source", "no", "sources", "term", "p", "q"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = _pairs(entries, groups, tile).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    over = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _difference(F.col("p"), F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
