"""Whole texts as flat arrays, inside Arrow tasks.

The operators of this package read texts with ``mapInArrow`` and work on the
UTF-8 bytes of a run of rows at once: :func:`blocks` cuts an Arrow batch into
runs of about ``BLOCK_BYTES`` (one text at least, so a longer text is a run
of its own), and :func:`words` finds the words of a run with their 64-bit
hashes. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 20

#: separators of the contract's words: space and \x09-\x0D
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True

#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, one after the other,
    and the ``hi - lo + 1`` offsets of the texts in them."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, row: int) -> bytes:
        """The bytes of a text, by its row in the block."""
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes hash equally wherever they stand."""
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``inside`` marks,
    never across texts, and the ``rows + 1`` offsets of each text's runs."""
    n = len(block.data)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:n] = inside
    starts = np.flatnonzero(here & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~here))
    return starts, ends, np.searchsorted(starts, block.offsets)


def words(block: Block, inside: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and the offsets of each text's words."""
    starts, ends, at = word_spans(block, inside)
    return span_hashes(LOWER[block.data] if lower else block.data, starts, ends), at


def windows(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``size`` items that lie within one text, and
    the offsets of each text's windows; ``at`` has the texts' item offsets."""
    counts = np.maximum(np.diff(at) - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], counts)
    return starts, offsets


def combined(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One hash for each window of ``size`` consecutive hashes; order counts."""
    out = hashes[starts]
    for k in range(1, size):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + hashes[starts + k])
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The text of each item, from the texts' item offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def map_texts(
    df: DataFrame, text_col: str, fields: StructType, fn: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None
) -> DataFrame:
    """``df``'s columns (or ``keep`` of them) with those of ``fields`` added,
    which ``fn`` makes of the texts of a batch, row for row. A column of the
    same name is replaced. The text column is dropped unless it is kept."""
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = StructType([*[source.schema[i] for i in range(len(kept))], *fields])

    def run(batches):
        for batch in batches:
            out = fn(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=schema.names)

    return source.mapInArrow(run, schema)
