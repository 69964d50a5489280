"""Operator 10: quality rules judged by host.

Each text is measured once (words, symbols, repeated lines and windows). A
document that fails a base rule goes in any case. The failures of all rules
are summed by host (pre-aggregated before the shuffle), each host's failure
rate is shrunk towards the mean of all hosts with a beta prior fitted to the
hosts' own spread, and the host verdict is joined back: in a
distrusted host a document also has to pass the strict rules, elsewhere
failing one of these is forgiven. A document that passes every rule is kept
whatever its host.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.materialize import materialize
from .tables import lookup, numbered, original
from .textblocks import SPACES, Block, blocks, combined, map_texts, mix, row_of, span_hashes, windows, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class HostPolicy:
    """A host is distrusted where its shrunk failure rate is at least
    ``max_rate``. The strict rules: symbols per 100 words, repeated lines per
    100 lines, and mean code points of a word."""

    max_rate: float = 0.3
    symbols_per_100_words: int = 10
    dup_lines_per_100: int = 30
    min_word_chars: int = 3
    max_word_chars: int = 12


def _later_equals(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the number of items equal to an earlier item of the row."""
    _, first = np.unique(mix(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(rows, minlength=n) - np.bincount(rows[first], minlength=n)


def measure(block: Block) -> list[np.ndarray]:
    """``MEASURES`` of the texts of a block."""
    n, data = block.rows, block.data
    inside = ~SPACES[data]
    starts, ends, at = word_spans(block, inside)
    counts = np.diff(at)

    def total(marked: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marked)])
        return sums[block.offsets[1:]] - sums[block.offsets[:-1]]

    chars = total(inside & ((data & 0xC0) != 0x80))
    symbols = total(SYMBOLS[data])

    # lines with a word; two lines are equal when all their bytes are
    line_at, line_end, lines = word_spans(block, data != 10)
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_at)
    rows = row_of(lines)[with_word]
    hashes = span_hashes(data, line_at[with_word], line_end[with_word])
    dup_lines = _later_equals(hashes, rows, n)
    n_lines = np.bincount(rows, minlength=n)

    # words that some 3-word window covers which the text has twice
    first, of = windows(at, 3)
    repeated = np.zeros(n, np.int64)
    if len(first):
        window = combined(span_hashes(data, starts, ends), first, 3)
        key = mix(window + row_of(of).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:].copy()
        hit = first[order[twin]]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[hit + k] = True
        sums = np.concatenate([[0], np.cumsum(covered)])
        repeated = sums[at[1:]] - sums[at[:-1]]
    return [counts, chars, symbols, dup_lines, repeated, n_lines]


def with_measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns ``_q_<measure>`` of its texts added."""

    def run(texts: pa.Array) -> list[pa.Array]:
        parts = [measure(b) for b in blocks(texts)]
        return [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(len(MEASURES))]

    return map_texts(docs, text_col, StructType([StructField(f"_q_{m}", LongType()) for m in MEASURES]), run, keep)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))


def strict_failed(policy: HostPolicy) -> Column:
    words, chars = F.col("_q_n_words"), F.col("_q_word_chars")
    return (
        (100 * F.col("_q_n_symbols") > policy.symbols_per_100_words * words)
        | (100 * F.col("_q_n_dup_lines") > policy.dup_lines_per_100 * F.col("_q_n_lines"))
        | (chars < policy.min_word_chars * words)
        | (chars > policy.max_word_chars * words)
    )


def host_verdicts(measured: DataFrame, policy: HostPolicy) -> DataFrame:
    """One row per host (column ``_host``): documents ``_n``, failing ones
    ``_failed``, shrunk rate ``host_rate``, verdict ``host_distrusted``.

    The prior beta(a, b) has the mean rate of all documents, and a + b is
    1 / rho - 1 for the share rho of the variance that lies between hosts,
    estimated from the mean squares between and within hosts (the ANOVA
    estimator for unequal sizes). Without a spread beyond what sampling gives,
    with one host, or with one document in every host, the prior overwhelms
    the hosts and all have the mean.
    """
    failed = (base_failed() | strict_failed(policy)).cast("long")
    hosts = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"), F.sum(failed).alias("_failed"))
    hosts = materialize(hosts)
    # five sums over the hosts come to the driver
    k, n, x, n2, x2 = hosts.agg(
        F.count(F.lit(1)), F.sum(F.col("_n").cast("double")), F.sum(F.col("_failed").cast("double")),
        F.sum(F.col("_n").cast("double") ** 2), F.sum(F.col("_failed").cast("double") ** 2 / F.col("_n")),
    ).first()
    mean, strength = beta_prior(k, n or 0.0, x or 0.0, n2 or 0.0, x2 or 0.0)
    shrunk = (F.col("_failed") + mean * strength) / (F.col("_n") + strength)
    return hosts.select("_host", "_n", "_failed", shrunk.alias("host_rate"), (shrunk >= policy.max_rate).alias("host_distrusted"))


def beta_prior(k: int, n: float, x: float, n2: float, x2: float) -> tuple[float, float]:
    """Mean and strength (a + b) from ``k`` hosts with ``n`` documents, ``x`` of
    them failing, the sum ``n2`` of squared host sizes and the sum ``x2`` of
    failures squared over host size."""
    if not n:
        return 0.0, 1.0
    rho = 0.0
    if 1 < k < n:
        between = (x2 - x * x / n) / (k - 1)
        within = (x - x2) / (n - k)
        total = between + ((n - n2 / n) / (k - 1) - 1) * within
        rho = (between - within) / total if total else 0.0
    return x / n, 1 / min(max(rho, 1e-6), 0.5) - 1


def quality_verdicts(
    docs: DataFrame, policy: HostPolicy = HostPolicy(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """One row per document: ``id_col``, the measures, ``base_failed``,
    ``strict_failed``, ``host_rate``, ``host_distrusted`` and ``kept``.

    A null or empty text has no words, so it fails a base rule. Documents
    without a host are one host of their own. Repeated rows and rows without
    an id are judged like any other and stay; an empty table gives no rows;
    other columns are not read.
    """
    narrow = docs.select(F.col(id_col), F.col(host_col).alias("_host"), F.col(text_col).alias("_body"))
    measured = materialize(with_measures(narrow, "_body", keep=[id_col, "_host"]))
    joined = lookup(measured, materialize(host_verdicts(measured, policy)).drop("_n", "_failed"), ["_host"])
    judged = joined.withColumn("base_failed", base_failed()).withColumn("strict_failed", strict_failed(policy))
    kept = ~F.col("base_failed") & ~(F.col("host_distrusted") & F.col("strict_failed"))
    return judged.select(
        id_col, *[F.col(f"_q_{m}").alias(m) for m in MEASURES], "base_failed", "strict_failed", "host_rate", "host_distrusted",
        kept.alias("kept"),
    )


def keep_good(
    docs: DataFrame, policy: HostPolicy = HostPolicy(), text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_verdicts` keeps, with all their
    columns. The texts are measured twice (for the hosts, then for the rows)
    so that no text is shuffled and no row is looked up by an id that may
    repeat or be null."""
    rows, names = numbered(docs)
    rows = rows.select("*", F.col(names[host_col]).alias("_host"), F.col(names[text_col]).alias("_body"))
    measured = with_measures(rows, "_body", keep=["_host"])
    hosts = materialize(host_verdicts(measured, policy)).select("_host", "host_distrusted")
    joined = lookup(with_measures(rows, "_body", keep=[*names.values(), "_host"]), hosts, ["_host"])
    return joined.where(~base_failed() & ~(F.col("host_distrusted") & strict_failed(policy))).select(*original(names))
