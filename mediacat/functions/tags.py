"""Checksums, path tags, tag merge and destinations (COL-13..16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
SHA1_BYTES = 20
DEFAULT_DATE_FORMAT = "yyyy/MM/dd"
# --------------------------------------------------------------------------

_B64 = r"^[A-Za-z0-9+/]*={0,2}\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def checksum_to_hex(b64) -> Column:
    """COL-13: base64 SHA-1 -> lowercase hex; blank, malformed (bad
    characters or padding) or not 20 bytes -> null."""
    t = F.regexp_replace(_c(b64), r"^\s+|\s+\z", "")
    ok = t.rlike(_B64) & (F.length(t) % 4 == 0) & (t != "")
    raw = F.when(ok, F.try_to_binary(t, F.lit("base64")))
    return F.when(F.octet_length(raw) == SHA1_BYTES, F.lower(F.hex(raw)))


def path_tags(path, root: str) -> Column:
    """COL-14: trimmed, non-empty directory components of ``path`` below
    ``root``; a file directly in root has no tags."""
    p = _c(path)
    r = root.rstrip("/")
    d = F.regexp_extract(p, r"(?s)^(.*)/", 1)
    rel = F.when(d.startswith(r + "/"), F.substring(d, len(r) + 2, 1 << 30)).otherwise(F.lit(""))
    parts = F.transform(F.split(rel, "/"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    return F.filter(parts, lambda x: x != "")


def explicit_tags(csv: str | None) -> list[str]:
    """Comma separated option value -> trimmed non-empty tags (a parameter,
    so it is split once on the driver)."""
    if not csv:
        return []
    return [t.strip() for t in csv.split(",") if t.strip()]


def merge_tags(existing, new_tags: Column, writable: Column) -> Column:
    """COL-15: tags after applying ``new_tags`` with remove-then-add per
    value: existing tags are kept, no duplicates are created; nothing is
    applied when the file type is not tag-writable."""
    ex = F.coalesce(_c(existing), F.array().cast("array<string>"))
    applied = F.when(writable, new_tags).otherwise(F.array().cast("array<string>"))
    # remove each new value, then append it once
    kept = F.filter(ex, lambda x: ~F.array_contains(applied, x))
    return F.concat(kept, F.array_distinct(applied))


def destination(date: Column, name: Column, fmt: str = DEFAULT_DATE_FORMAT, outpath: str = "") -> Column:
    """COL-16: ``outpath/format(date)/name`` where a missing date is
    0001-01-01. ``fmt`` must be a date-only Spark pattern."""
    d = F.coalesce(date, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    prefix = outpath.rstrip("/") + "/" if outpath else ""
    return F.concat(F.lit(prefix), F.date_format(d, fmt), F.lit("/"), name)


def check_date_only_format(spark, fmt: str) -> None:
    """COL-16 option check: the destination pattern must not depend on the
    time of day (same output at 08:00:00 and 20:30:45), else ValueError."""
    a, b = (
        spark.range(1)
        .select(
            F.date_format(F.lit("2000-01-02 08:00:00").cast("timestamp_ntz"), fmt).alias("a"),
            F.date_format(F.lit("2000-01-02 20:30:45").cast("timestamp_ntz"), fmt).alias("b"),
        )
        .first()
    )
    if a != b:
        raise ValueError(f"date format {fmt!r} must be date-only")
