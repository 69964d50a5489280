"""Operator 1: URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into the bits of a few 64-bit words (multiword
Shift-And): one bit for each state of each rule. A batch of canonical URLs is
read byte by byte, all URLs and all rules at once: the state words are
shifted by one bit (the carry goes to the next word), masked by the byte, and
states that stand at a ``*`` stay. The cost of a byte is the number of words,
whatever the number of rules in them.

A canonical URL is ``.host/path``: the host lower-cased (A-Z), query and
fragment gone, and a dot in front so that a rule for a host also fits its
subdomains. In a glob ``*`` stands for any run and ``?`` for one character;
before the glob's first ``/`` neither goes past a ``/``, so host parts match
hosts only. A ``?`` is one byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .textblocks import blocks, map_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``glob`` over canonical URLs; of the rules that fit the one of the
    highest ``rank`` decides (of equal ranks the one listed first)."""

    glob: str
    verdict: str
    rank: int
    name: str | None = None


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``;
    the longer rule wins, and any of them wins over a plain glob."""
    return Rule(f"*.{host}{path}*", verdict, 1 << 20 | len(host + path), host + path)


#: The host rules that the query has to follow.
HOST_RULES = [
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
]

#: Globs for what is rarely worth reading; they decide where no host rule does.
GLOB_RULES = [
    Rule("*/*.exe", "block", 0),
    Rule("*/*.zip", "block", 0),
    Rule("*.ads.*/*", "block", 0),
    Rule("*/*/login*", "block", 0),
    Rule("*/*/cart/*", "block", 0),
]

DEFAULT_VERDICT = "allow"


class Automaton:
    """The rules' states as bits of ``words`` 64-bit words."""

    def __init__(self, globs: list[str]):
        step: list[np.ndarray] = []  # the bytes that lead into a state
        stay: list[np.ndarray] = []  # the bytes on which a state stays
        start, final = [], []
        for glob in globs:
            in_host = True
            start.append(len(step))
            step.append(np.zeros(256, bool))
            stay.append(np.zeros(256, bool))
            for c in glob.encode():
                free = np.ones(256, bool)
                free[ord("/")] = not in_host
                if c == ord("*"):
                    stay[-1] |= free
                    continue
                here = free if c == ord("?") else np.arange(256) == c
                step.append(here)
                stay.append(np.zeros(256, bool))
                in_host &= c != ord("/")
            final.append(len(step) - 1)
        self.words = max(1, -(-len(step) // 64))
        self.step, self.stay = self._pack(step), self._pack(stay)
        self.start = self._bits(start)
        self.final = final

    def _bits(self, at: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def _pack(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), np.uint64)
        for i, s in enumerate(sets):
            out[s, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text and rule, whether the rule's glob fits the whole text."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        at, left = offsets[:-1][order], lengths[order]
        state = np.tile(self.start, (len(order), 1))
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -i, "left"))  # texts with a byte i stand first
            byte, now = data[at[:live] + i], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        out = np.empty((len(order), len(self.final)), bool)
        for r, f in enumerate(self.final):
            out[order, r] = (state[:, f // 64] >> np.uint64(f % 64)) & one
        return out


def url_parts(name: str) -> tuple[Column, Column]:
    """(host, path) of the url column ``name``: after the first ``://`` up to
    ``/``, ``?``, ``#`` or the end, lower-cased; then up to ``?``, ``#`` or
    the end. Both are empty for a null url or one without ``://``."""
    rest = F.expr(f"CASE WHEN instr({name}, '://') > 0 THEN substring({name}, instr({name}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: list[Rule], default: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule`` (the name of
    the host rule that decided, else null), ``glob`` (the glob that decided,
    else null) and ``verdict`` (that of the deciding rule, else ``default``).

    Rows are judged one by one: repeated rows and rows without an id or url
    stay, each with its own verdict; a null url has an empty host and path
    and fits no host rule. An empty table gives no rows; other columns are
    not read. A very long url costs its own length only.
    """
    order = sorted(range(len(rules)), key=lambda i: (rules[i].rank, -i))
    automaton = Automaton([r.glob for r in rules])
    narrow = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    host, path = url_parts("_url")
    narrow = narrow.select(id_col, host.alias("host"), path.alias("path"))
    names = np.array([r.name for r in rules] + [None], object)
    globs = np.array([r.glob for r in rules] + [None], object)
    verdicts = np.array([r.verdict for r in rules] + [default], object)

    def judge(texts: pa.Array) -> list[pa.Array]:
        chosen = np.full(len(texts), len(rules))
        for b in blocks(texts):
            fits = automaton.fits(b.data, b.offsets)
            for r in order:
                chosen[b.lo : b.hi][fits[:, r]] = r
        return [pa.array(x[chosen], pa.string()) for x in (names, globs, verdicts)]

    fields = StructType([StructField(c, StringType()) for c in ("rule", "glob", "verdict")])
    canonical = narrow.withColumn("_canonical", F.concat(F.lit("."), "host", "path"))
    return map_texts(canonical, "_canonical", fields, judge, keep=[id_col, "host", "path"])
