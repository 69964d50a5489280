"""Operator 9: language ID by error-correcting output codes.

Each language has a codeword of bits; for each bit one binary classifier says
from a text's character n-grams on which side of the bit its language lies.
The classifiers are log odds of n-gram frequencies, counted over all training
texts (partial counts in the tasks, then one sum). Decoding is loss-weighted:
a language's distance is the sum, over the bits, of an exponential loss of
the classifier's margin, weighted by how well that bit's classifier does on
that language; the nearest codeword wins. Two codewords at nearly the same
distance flag the text as ambiguous.

N-grams are the runs of three bytes of the text's letters in lower case; any
other character is one space. They are counted in ``FEATURES`` hashed cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..operators.materialize import materialize
from .tables import numbered, original
from .textblocks import Block, blocks, map_texts, row_of

FEATURES = 1 << 15
#: most labels that a model is made for; more are refused, as the counts of all come to the driver
MAX_LANGUAGES = 400
#: expected number of a language's texts in the sample that weighs the bit classifiers
WEIGHING_TEXTS = 500
SEED = 9
AMBIGUOUS_BELOW = 0.6
UNKNOWN = "und"

#: letters to lower case; bytes of other scripts as they are; the rest to a space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hashed cells of a block's n-grams, and the offsets of each text's.
    A text is taken with a space before and after it; spaces count once."""
    folded = _FOLD[block.data]
    first = np.zeros(len(folded) + 1, bool)
    first[block.offsets] = True
    space = folded == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~first[1:-1]
    # a space in front of every text; a text's own leading space goes
    kept_at = np.flatnonzero(keep)
    sizes = np.searchsorted(kept_at, block.offsets)
    line = np.insert(folded[kept_at], sizes, 32).astype(np.uint32)
    heads = sizes + np.arange(len(sizes))
    if len(line) < 3:
        return np.zeros(0, np.int64), np.zeros(block.rows + 1, np.int64)
    code = (line[:-2] << 16) | (line[1:-1] << 8) | line[2:]
    cells = (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64) & (FEATURES - 1)
    # the n-grams of a text start between its own space and two before the next text's space ends
    size = np.maximum(np.diff(heads) - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(heads[:-1] - offsets[:-1], size)
    return cells[at], offsets


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language. Up to five languages get every
    way to split them in two; more get rows of a Hadamard matrix without its
    constant column, any two of which differ in half of their bits."""
    if languages <= 1:
        return np.ones((languages, 0), np.int8)
    if languages <= 5:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.array([np.where(splits >> i & 1, 1, -1) for i in range(languages)], np.int8)
    size = 1
    h = np.ones((1, 1), np.int8)
    while size < languages:
        h = np.block([[h, h], [h, -h]])
        size *= 2
    return h[:languages, 1:]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # bits x FEATURES, log odds of a cell
    weight: np.ndarray  # languages x bits, each language's sum to 1

    def margins(self, block: Block) -> np.ndarray:
        """For each text the bits' mean log odds, in units of a typical margin."""
        cells, offsets = ngrams(block)
        sums = np.zeros((block.rows, self.code.shape[1]))
        if len(cells):
            size = np.diff(offsets)
            some = size > 0
            for b in range(self.code.shape[1]):
                sums[some, b] = np.add.reduceat(self.odds[b][cells], offsets[:-1][some]) / size[some]
        return sums

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text from each language's codeword."""
        agree = np.clip(margins[:, None, :] * self.code[None, :, :], -30, 30)
        return (np.exp(-agree) * self.weight[None, :, :]).sum(axis=2)


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str | None = None) -> Model:
    """Learn from the rows of ``texts`` with a non-null ``lang_col``.

    The driver gets one count for each language and cell (``FEATURES`` cells
    at most for each) and, for the bits' weights, sums over a sample of
    about ``WEIGHING_TEXTS`` texts of each language, drawn by a seeded hash of text
    and ``id_col`` (without one, copies of a text are drawn together), so that the
    model does not depend on how the rows lie in files. No labelled row at all gives a
    model without languages, which predicts only ``und``.
    """
    drawn_by = F.xxhash64(*[F.col(c) for c in (id_col, text_col) if c is not None], F.lit(SEED)).alias("_draw")
    rows = texts.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_body"), drawn_by)
    # the cells' counts of each row's language, summed up within a task first;
    # one more cell counts its texts
    schema = StructType([StructField("_lang", StringType()), StructField("_cells", ArrayType(LongType())), StructField("_counts", ArrayType(LongType()))])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for b in blocks(batch.column(1)):
                cells, offsets = ngrams(b)
                of = row_of(offsets)
                here = langs[b.lo : b.hi]
                for lang in set(here):
                    own = here == lang
                    sums[lang] = sums.get(lang, 0) + np.append(np.bincount(cells[own[of]], minlength=FEATURES), own.sum())
        for lang, total in sums.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([cells], pa.list_(pa.int64())), pa.array([total[cells]], pa.list_(pa.int64()))], names=schema.names)

    partial = rows.drop("_draw").mapInArrow(count, schema).select("_lang", F.explode(F.arrays_zip("_cells", "_counts")).alias("_c"))
    counts = partial.groupBy("_lang", F.col("_c._cells").alias("cell")).agg(F.sum("_c._counts").alias("n"))
    counts = materialize(counts)
    if counts.where(F.col("cell") == FEATURES).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: {lang_col} does not hold languages")
    table = counts.toArrow()
    languages = sorted(table["_lang"].unique().to_pylist())
    code = codewords(len(languages))
    index = {x: i for i, x in enumerate(languages)}
    total = np.zeros((len(languages), FEATURES + 1))
    names = table["_lang"].combine_chunks().dictionary_encode()
    rows_of = np.array([index[x] for x in names.dictionary.to_pylist()], np.int64)
    if len(table):
        total[rows_of[names.indices.to_numpy()], table["cell"].to_numpy()] = table["n"].to_numpy()
    total, texts_of = total[:, :-1], dict(zip(languages, total[:, -1], strict=True))
    share = (total + 0.5) / (total + 0.5).sum(axis=1, keepdims=True) if len(languages) else total
    odds = np.zeros((code.shape[1], FEATURES))
    for b in range(code.shape[1]):
        odds[b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    scale = np.maximum(np.abs(odds @ share.T).mean(axis=1, keepdims=True), 1e-9) if len(languages) else 1.0
    model = Model(languages, code, (odds / scale).astype(np.float32), np.ones(code.shape))
    if code.shape[1]:
        model.weight = _weights(model, rows, texts_of)
    return model


def _weights(model: Model, rows: DataFrame, texts_of: dict[str, float]) -> np.ndarray:
    """For each language the share of its texts that each bit's classifier
    gets right, over the sample of them, normalised to sum to 1."""
    shares = F.create_map(*[x for lang, n in texts_of.items() for x in (F.lit(lang), F.lit(min(1.0, WEIGHING_TEXTS / n)))])
    place = F.pmod(F.col("_draw"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(place < shares[F.col("_lang")]).drop("_draw")
    schema = StructType([StructField("_lang", StringType()), StructField("_right", ArrayType(LongType()))])
    index = {x: i for i, x in enumerate(model.languages)}

    def run(texts_langs):
        for batch in texts_langs:
            langs = batch.column(0).to_pylist()
            for b in blocks(batch.column(1)):
                right = model.margins(b) * model.code[[index[x] for x in langs[b.lo : b.hi]]] > 0
                yield pa.RecordBatch.from_arrays([pa.array(langs[b.lo : b.hi]), pa.array(list(right.astype(np.int64)), pa.list_(pa.int64()))], names=schema.names)

    bits = sample.mapInArrow(run, schema).select("_lang", F.posexplode("_right").alias("_bit", "_ok"))
    right = np.ones(model.code.shape)
    texts = np.full(model.code.shape, 2.0)
    for r in bits.groupBy("_lang", "_bit").agg(F.sum("_ok").alias("ok"), F.count(F.lit(1)).alias("n")).collect():
        right[index[r["_lang"]], r["_bit"]] += r["ok"]
        texts[index[r["_lang"]], r["_bit"]] += r["n"]
    weight = right / texts
    return weight / weight.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32(doc_id as text) mod 4 = 2.
    False where there is no doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred``, ``score`` (0 to
    1), ``second_lang`` and ``ambiguous`` (the score is below
    ``AMBIGUOUS_BELOW``). A text without a letter of any script, empty and
    null ones too, is ``und`` with a score of 0. Only the text is looked at."""
    fields = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("second_lang", StringType()), StructField("ambiguous", BooleanType())])
    labels = np.array(model.languages, object)

    def run(texts: pa.Array) -> list[pa.Array]:
        best, second, score = [], [], []
        for b in blocks(texts):
            if len(labels) < 2:
                best += [labels[0] if len(labels) else UNKNOWN] * b.rows
                second += [None] * b.rows
                score += [float(len(labels))] * b.rows
                continue
            d = model.distances(model.margins(b))
            order = np.argsort(d, axis=1, kind="stable")
            near = np.take_along_axis(d, order[:, :2], axis=1)
            best += list(labels[order[:, 0]])
            second += list(labels[order[:, 1]])
            score += list(near[:, 1] / np.maximum(near.sum(axis=1), 1e-300))
        return [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array([s < AMBIGUOUS_BELOW for s in score], pa.bool_())]

    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in fields.fieldNames()]
    rows, names = numbered(docs.select(*kept, F.col(text_col).alias("_body")))
    body = names.pop("_body")
    letters = F.coalesce(F.col(body).rlike(r"\p{L}"), F.lit(False))
    source = rows.select(*names.values(), letters.alias("_letters"), F.when(letters, F.col(body)).alias("_body"))
    out = map_texts(source, "_body", fields, run, keep=[*names.values(), "_letters"])
    known = F.col("_letters")
    return out.select(
        *original(names),
        F.when(known, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(known, F.col("second_lang")).alias("second_lang"),
        (~known | F.col("ambiguous")).alias("ambiguous"),
    )


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the labelled rows outside the held-out fold and predict every
    row: ``id_col``, ``held_out``, ``lang_pred``, ``score``, ``second_lang``,
    ``ambiguous``.

    Rows without an id are not learned from (they have no fold) but are
    predicted. Repeated rows each count and stay; an empty table gives no
    rows; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_doc"), F.col(lang_col).alias("_label"))
    model = train(narrow.where(F.col("_id").isNotNull() & ~held_out(F.col("_id"))), "_doc", "_label", "_id")
    out = predict(narrow, model, "_doc", keep=["_id"])
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score", "second_lang", "ambiguous")
