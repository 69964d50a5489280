"""Hash-set membership (JN-2..4).

The build side is reduced to its distinct keys first, so the join never
multiplies rows. The probe side may have a hot key (many copies of one
file share a hash): :func:`mediacat.operators.skew.skew_safe_join` attaches
the flags of the most frequent keys map-side (a broadcast of at most
``MAX_HOT_KEYS`` rows) and spreads those rows over the shuffle join that
serves every other key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import skew_safe_join


def flag_member(
    df: DataFrame, members: DataFrame, key: str, member_key: str, flag: str, unique: str | None = None
) -> DataFrame:
    """Add boolean ``flag``: ``df[key]`` occurs in ``members[member_key]``.
    ``unique`` names a per-row unique column of ``df`` (default ``path``)."""
    keys = members.select(F.col(member_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    keys = keys.withColumn(flag, F.lit(True))
    if unique is None and "path" in df.columns:
        unique = "path"
    out = skew_safe_join(df, keys, key, "left", unique=unique)
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def flag_members(
    df: DataFrame, key: str, sets: dict[str, tuple[DataFrame | None, str]], unique: str
) -> DataFrame:
    """Add a boolean for each entry ``flag: (members, column)`` of ``sets``:
    ``df[key]`` occurs in the set (False where there is none). All sets are
    joined at once, so the rows are shuffled and their hot keys measured
    once, whatever the number of sets."""
    given = {flag: x for flag, x in sets.items() if x[0] is not None}
    if given:
        tagged = None
        for flag, (members, column) in given.items():
            one = members.select(F.col(column).alias(key), *[F.lit(flag == f).alias(f) for f in given]).where(F.col(key).isNotNull())
            tagged = one if tagged is None else tagged.unionByName(one)
        flags = tagged.groupBy(key).agg(*[F.max(f).alias(f) for f in given])
        df = skew_safe_join(df, flags, key, "left", unique=unique)
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(False)) if f in given else F.lit(False) for f in sets})


def match_trash(files: DataFrame, trash: DataFrame) -> DataFrame:
    """JN-2: sha1 in the trash set."""
    return flag_member(files, trash, "sha1", "sha1", "in_trash")


def match_skip_ledger(files: DataFrame, skip: DataFrame) -> DataFrame:
    """JN-3: sha256 in the read-only skip ledger."""
    return flag_member(files, skip, "sha256", "sha256", "in_skip")


def match_import_ledger(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """JN-4: sha256 anywhere in the import ledger (path independent)."""
    return flag_member(files, ledger, "sha256", "sha256", "in_import_ledger")
