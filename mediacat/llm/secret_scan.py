"""Operator 4: secret scans.

One pass over each whole text: an Aho-Corasick automaton finds the keywords
of all rules at once; regular expressions are only tried where they can
start, anchored at a keyword's hit (a run of hex digits has no keyword: its
places come from one look at the byte classes); tokens that carry a checksum
are reported only if it holds. Texts are scanned as UTF-8 bytes, so "either
case" is that of A-Z alone, and spans are turned into code points at the end.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .textblocks import Block, blocks, map_texts, word_spans

#: The rules that the base count has to follow.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
BASE_KINDS = ["assign", "access", "hex"]

#: Token formats with an embedded checksum: a prefix, 30 random characters and
#: the CRC-32 of these in six base-62 digits.
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
CHECKED_BODY = re.compile(rb"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = [*BASE_KINDS, "github", "npm"]

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def crc62(body: bytes) -> bytes:
    """The CRC-32 of ``body`` as six base-62 digits."""
    left, out = zlib.crc32(body), b""
    for _ in range(6):
        left, digit = divmod(left, 62)
        out = BASE62[digit : digit + 1] + out
    return out


def _automaton() -> ahocorasick.Automaton:
    """Keywords in lower case; each says which rule its hits start."""
    out = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        out.add_word(word, ("assign", len(word)))
    out.add_word("akia", ("access", 4))
    for prefix, kind in CHECKED_PREFIXES.items():
        out.add_word(prefix, (kind, len(prefix)))
    out.make_automaton()
    return out


def keyword_spans(text: bytes, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, str]]:
    """Spans of the rules that start with a keyword, leftmost and not
    overlapping within a kind. A match can start only at a hit, so trying the
    hits from left to right and skipping those inside the last match gives
    what a search of the whole text gives. A match that is too short takes
    its bytes all the same, as it does there."""
    done: dict[str, int] = {}
    # one character for each byte, so hits are byte offsets
    for last, (kind, size) in automaton.iter(text.lower().decode("latin-1")):
        at = last + 1 - size
        if at < done.get(kind, 0):
            continue
        if kind == "assign":
            m = ASSIGN.match(text, at)
            good = m and len(m[1]) >= MIN_ASSIGN
        elif kind == "access":
            m = ACCESS.match(text, at)
            good = m and m.end() - at >= MIN_ACCESS
        else:
            m = CHECKED_BODY.match(text, at + size)
            inside = at and text[at - 1 : at].isalnum()
            good = m and not inside and text[at:at + size].islower() and crc62(m[0][:30]) == m[0][30:]
        if m:
            done[kind] = m.end()
            if good:
                yield at, m.end(), kind


def scan(block: Block, automaton: ahocorasick.Automaton) -> list[list[tuple[int, int, str]]]:
    """For each text its spans (start, end, kind), in code points, by start
    and then by kind as listed in ``KINDS``."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(block.rows)]
    starts, ends, at = word_spans(block, _HEX[block.data])
    long = np.flatnonzero(ends - starts >= MIN_HEX)
    for i, row in zip(long, np.searchsorted(at, long, "right") - 1, strict=True):
        base = block.offsets[row]
        found[row].append((int(starts[i] - base), int(ends[i] - base), "hex"))
    for row in range(block.rows):
        text = block.text(row)
        spans = found[row]
        spans.extend(keyword_spans(text, automaton))
        if spans and not text.isascii():
            before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            spans[:] = [(int(before[s]), int(before[e]), k) for s, e, k in spans]
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, the number of base spans of each kind
    (``n_assign``, ``n_access``, ``n_hex``), of checksummed tokens
    (``n_checked``), ``base_sha256`` over the base spans, and ``spans``, all
    spans as ``kind:start:end`` joined by commas.

    A null or empty text has no spans: counts of 0, the digest of the empty
    string and empty ``spans``. Rows are scanned one by one: repeated rows and
    rows without an id stay; an empty table gives no rows; other columns are
    not read. A text is held whole in one task, with a few bytes for each of
    its characters.
    """
    counts = ["n_assign", "n_access", "n_hex", "n_checked"]
    fields = StructType([*[StructField(c, LongType()) for c in counts], StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def run(texts: pa.Array) -> list[pa.Array]:
        automaton = _automaton()
        rows = []
        for b in blocks(texts):
            for spans in scan(b, automaton):
                base = [x for x in spans if x[2] in BASE_KINDS]
                n = [sum(x[2] == k for x in base) for k in BASE_KINDS]
                rows.append((*n, len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]

    narrow = docs.select(F.col(id_col), F.col(text_col).alias("_body"))
    return map_texts(narrow, "_body", fields, run, keep=[id_col])
