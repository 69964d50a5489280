"""SRT-1 empty directories.

A directory strictly below the root is removed when no file survives in
it or in any descendant; the plan lists them deepest first, so a chain of
empty directories goes child before parent. The files' directories are
made distinct first (partial aggregates, however many files one holds); each
of these, not each file, then contributes its ancestors (bounded by path depth,
built with ``transform(sequence(...))`` - no loop), and the empty ones are an
anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import dir_of


def ancestors(dir_col) -> F.Column:
    """'/a/b/c' -> ['/a', '/a/b', '/a/b/c'] (the directory itself included)."""
    parts = F.split(dir_col, "/")
    return F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )


def empty_directories(dirs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``dirs``: dir (every directory below root); ``files``: path of the
    surviving files. Returns dir, depth ordered deepest first."""
    r = root.rstrip("/")
    holding = files.select(dir_of(F.col("path")).alias("dir")).distinct()
    occupied = holding.select(F.explode(ancestors(F.col("dir"))).alias("dir")).filter(F.col("dir").startswith(r + "/")).distinct()
    below = dirs.select("dir").filter(F.col("dir").startswith(r + "/")).distinct()
    empty = below.join(occupied, "dir", "left_anti")
    depth = F.size(F.split(F.col("dir"), "/")) - 1
    return empty.select("dir", depth.alias("depth")).orderBy(F.col("depth").desc(), F.col("dir"))
