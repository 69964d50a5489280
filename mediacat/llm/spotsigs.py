"""Operator 11: document fingerprints by SpotSigs, with DataFrame functions only.

A signature is an anchor, one of the common words of a language, and the chain
of the next ``CHAIN`` content words that follow it, common words skipped. The
common words stand all over natural prose, so a change of a text changes only
the few signatures next to it, while menus and lists hold hardly any. A text's
fingerprint is its set of signatures. Sets fall into classes of length, so wide
that two sets of likeness ``LEAST`` or more lie in the same class or in
neighbouring ones: others are not compared, and of these the pairs whose sizes
alone forbid that likeness are pruned.

Texts in other languages, tables and code have few common words or none. So
the start of a text is an anchor, and a word drawn by its hash (one in 16) is
one too, and still a content word.

Neighbours by id meet in blocks of ids: each text is shuffled once, to its
block, and the first text of a block also goes to the end of the block before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import rank_among

# fixed values: the most frequent function words of four languages
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from or an he not have has his which but were".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec ce il ne se sont plus ou aux son".split(),
    "de": "der die und in den zu von das mit sich des ein für auf ist im nicht dem eine als auch es an er wird aus bei nach sind".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus le ha sin este".split(),
}
CHAIN = 2
LEAST = 0.1

#: documents of a block, and the most blocks: their bounds are one literal of the plan
BLOCK_ROWS = 64
MAX_BLOCKS = 1 << 14

#: letters, marks and digits by Unicode blocks, without those of the next line
_SPACED = (
    r"a-z0-9A-Z\xC0-\xD6\xD8-\xF6\xF8-\x{DFF}\xAA\xB5\xBA\x{F00}-\x{FFF}\x{10A0}-\x{177F}\x{1800}-\x{1FFF}\x{2070}-\x{218F}"
    r"\x{2C00}-\x{2E7F}\x{A000}-\x{F8FF}\x{FB00}-\x{FE0F}\x{FE70}-\x{FEFE}\x{FF10}-\x{FF19}\x{FF21}-\x{1EFFF}"
)
#: scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han): each character is a word
_UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FFF}\x{3041}-\x{9FFF}\x{20000}-\x{3FFFF}"
WORD = f"[{_SPACED}]+|[{_UNSPACED}]"

#: ends of an anchor and of a content word in a marked text; no word holds them
_ANCHOR, _CONTENT = "\x01", "\x02"
_START = "^" + _ANCHOR


def _marked(text: Column, common: list[str] | None) -> Column:
    """The words of a text, lower-cased, each with the mark of its kind after it."""
    common = sorted({w for ws in COMMON_WORDS.values() for w in ws}) if common is None else common

    def mark(w: Column) -> Column:
        # a drawn word ends as a content word, then stands as an anchor before the next
        drawn = F.concat(w, F.lit(_CONTENT), w, F.lit(_ANCHOR))
        plain = F.when(F.substring(F.md5(w), 1, 1) == "0", drawn).otherwise(F.concat(w, F.lit(_CONTENT)))
        return F.when(w.isin(common), F.concat(w, F.lit(_ANCHOR))).otherwise(plain) if common else plain

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), mark), "")


def _with_spots(df: DataFrame, marked: Column, name: str, chain: int, seam: str | None = None) -> DataFrame:
    """``df`` with ``name`` added: the signatures of a marked text, in its
    order. With ``seam`` only those whose chain is complete, and what the others
    need of the text in front of its continuation as a column of that name."""
    gaps, words = f"{name}_gaps", f"{name}_words"
    # a piece for each content word, with the anchors in front of it; the last one has anchors at most
    out = df.withColumn(gaps, F.split(marked, _CONTENT))
    out = out.withColumn(words, F.transform(gaps, lambda g: F.substring_index(g, _ANCHOR, -1)))
    chained = [F.slice(words, i + 1, F.size(words)).alias(f"w{i}") for i in range(chain)]
    pieces = F.arrays_zip(F.col(gaps).alias("gap"), *chained)
    if seam is not None:
        complete = F.greatest(F.size(gaps) - chain, F.lit(0))
        out = out.withColumn(seam, F.array_join(F.slice(gaps, complete + 1, F.lit(chain)), _CONTENT))
        pieces = F.slice(pieces, F.lit(1), complete)

    def signed(z: Column) -> Column:
        anchors = F.split(z["gap"], _ANCHOR)
        following = F.concat_ws(" ", *[z[f"w{i}"] for i in range(chain)])

        def number(a: Column) -> Column:
            return F.conv(F.substring(F.md5(F.concat(a, F.lit(":"), following)), 1, 15), 16, 10).cast("long")

        return F.transform(F.slice(anchors, 1, F.size(anchors) - 1), number)

    spots = F.filter(pieces, lambda z: F.contains(z["gap"], F.lit(_ANCHOR)))
    return out.withColumn(name, F.flatten(F.transform(spots, signed))).drop(gaps, words)


def _set(*lists: str) -> Column:
    """Signatures as a set: distinct and ascending. The start's alone is that of a text without words."""
    distinct = F.array_sort(F.array_distinct(F.concat(*[F.col(x) for x in lists])))
    return F.when((F.size(distinct) == 1) & (distinct[0] == _no_word()), F.array().cast("array<bigint>")).otherwise(distinct)


def _no_word() -> Column:
    return F.conv(F.substring(F.md5(F.lit("^:")), 1, 15), 16, 10).cast("long")


def with_signatures(df: DataFrame, text_col: str, name: str, common: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """``df`` with ``name`` added: the signatures of the text as 60-bit
    numbers, distinct and ascending. A text without words has none, a null
    text neither. ``common``: the anchors, lower-case (default: those of four
    languages). Words are runs of letters and digits, and single characters of
    scripts without spaces, lower-cased. Chains at a text's end are shorter."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = _with_spots(df, F.concat(F.lit(_START), _marked(text, common)), "_spots", chain)
    return out.withColumn(name, _set("_spots")).drop("_spots")


def fingerprint(signatures: Column) -> Column:
    """The digest of a set of signatures; empty for the empty set."""
    return F.when(F.size(signatures) > 0, F.sha2(F.array_join(signatures.cast("array<string>"), ","), 256)).otherwise(F.lit(""))


def length_class(signatures: Column, least: float = LEAST) -> Column:
    """The number of ``1 / least``-fold steps up to the set's size; -1 for the
    empty set. Sets of likeness ``least`` or more are in the same or in
    neighbouring classes."""
    steps = [math.ceil(least**-k - 1e-9) for k in range(1, 64) if least**-k < 2**31]
    return sum((F.when(F.size(signatures) >= n, 1).otherwise(0) for n in [1, *steps]), F.lit(-1))


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard likeness of two sets of signatures. Sets whose lengths alone
    keep it below ``least`` are not compared, it is 0 then; two empty sets
    are alike, an empty one and another are not."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    near = (F.abs(length_class(a, least) - length_class(b, least)) <= 1) & (small >= F.lit(least) * large)
    common = F.size(F.array_intersect(a, b))
    exact = common.cast("double") / (small + large - common)
    return F.when(large == 0, F.lit(1.0)).when(near & (small > 0), exact).otherwise(F.lit(0.0))


def beside_next(docs: DataFrame, prepared, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each document: ``_id``, ``_text`` (null: empty), the columns
    that ``prepared`` adds to such rows, and ``_next_text`` and ``_next_set`` with the
    text and the ``_set`` of the next document. Next is by ascending id, null ids
    first and ties by the MD5 of the text; after the last comes the first. Ids are
    whole numbers, few rows share one."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ids = rows.select("_id")
    n = ids.count()
    blocks = min(MAX_BLOCKS, n // block_rows + 1)
    shares = [i / blocks for i in range(1, blocks)]
    found = ids.agg(F.percentile_approx("_id", F.lit(shares), 4 * max(blocks, 2500)).alias("x")).first()["x"] if shares else None
    block = rank_among(F.col("_id"), sorted(set(found or [])))

    # the first text of each block, for the end of the block before: one row for each block
    firsts = ids.groupBy(block.alias("_at")).agg(F.min(F.struct("_id")).alias("_first"))
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_at").over(Window.orderBy("_at")), F.max("_at").over(Window.partitionBy())))
    firsts = firsts.select(F.col("_first._id").alias("_first_id"), F.col("_before").cast("int").alias("_block"))
    ordered = rows.withColumn("_md5", F.md5(F.col("_text")))
    tails = ordered.join(F.broadcast(firsts), F.col("_id").eqNullSafe(F.col("_first_id")))
    tails = tails.groupBy("_block").agg(F.min(F.struct("_md5", "_text", "_id")).alias("_t"))
    tails = tails.select("_t._id", "_t._text", "_t._md5", "_block", F.lit(1).alias("_tail"))
    ordered = ordered.withColumns({"_block": block.cast("int"), "_tail": F.lit(0)})
    placed = prepared(ordered.unionByName(tails).repartition("_block"))
    turn = Window.partitionBy("_block").orderBy("_tail", F.col("_id").asc_nulls_first(), "_md5")
    out = placed.withColumns({"_next_text": F.lead("_text").over(turn), "_next_set": F.lead("_set").over(turn)}).where("_tail = 0")
    return out.drop("_md5", "_block", "_tail")


def spot_fingerprints(
    docs: DataFrame, common: list[str] | None = None, chain: int = CHAIN, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each document: ``id_col``, ``n_chars`` (code points),
    ``signatures`` and ``edited_signatures`` of the text and of its edited
    text, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``length_class`` and the likeness of its signatures to those of the edited
    text (``near_edited``) and of the next document (``near_next``), see
    :func:`likeness`. The edited text has its last quarter of code points,
    rounded down, replaced by as many of the next document's first ones (all, if
    there are fewer).

    A null text is an empty one; a text without words has the empty
    fingerprint. Equal texts have equal fingerprints. Repeated rows each stay
    and follow each other; a lone document is its own next one. An empty table
    gives no rows; other columns are not read.
    """

    def prepared(rows: DataFrame) -> DataFrame:
        """The set of a text, from its head, which the edited text has too
        (up to the last space in front of the cut), and the rest."""
        out = rows.withColumn("_n", F.char_length("_text"))
        out = out.withColumn("_cut", F.expr("_n div 4").cast("int"))
        out = out.withColumn("_kept", F.substring("_text", F.lit(1), F.col("_n") - F.col("_cut")))
        out = out.withColumn("_stub", F.substring_index("_kept", " ", -1))
        out = out.withColumn("_whole", F.char_length("_kept") - F.char_length("_stub")).drop("_kept")
        head, rest = F.substring("_text", F.lit(1), F.col("_whole")), F.substring("_text", F.col("_whole") + 1, F.col("_n"))
        out = _with_spots(out, F.concat(F.lit(_START), _marked(head, common)), "_head", chain, seam="_seam")
        out = _with_spots(out, F.concat("_seam", _marked(rest, common)), "_rest", chain)
        return out.withColumn("_set", _set("_head", "_rest")).drop("_rest")

    rows = beside_next(docs, prepared, id_col, text_col)
    added = F.substring("_next_text", F.lit(1), F.col("_cut"))
    kept = F.substring("_text", F.lit(1), F.col("_n") - F.col("_cut"))
    rows = rows.withColumns({"_edited": F.concat(kept, added), "_end": F.concat(F.col("_stub"), added)}).drop("_text", "_next_text")
    rows = _with_spots(rows, F.concat("_seam", _marked(F.col("_end"), common)), "_tail", chain)
    rows = rows.withColumn("_edited_set", _set("_head", "_tail"))
    own, edited, following = F.col("_set"), F.col("_edited_set"), F.col("_next_set")
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_chars"),
        own.alias("signatures"),
        edited.alias("edited_signatures"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        length_class(own, least).alias("length_class"),
        likeness(own, edited, least).alias("near_edited"),
        likeness(own, following, least).alias("near_next"),
    )
