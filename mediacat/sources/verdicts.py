"""Decoder verdict lines (SRC-7).

The decoder prints one JSON object per line mixed with noise. A line is
trimmed; lines not starting with ``{``, unparsable JSON and objects without
a path are dropped; unknown fields are ignored; for a path seen several
times the last line wins (``max_by`` over the line number: a partial
aggregate, so a path repeated a million times is still combined map-side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VERDICT


def parse_verdict_lines(lines: DataFrame, line_no: str = "line_no", text: str = "line") -> DataFrame:
    """(line_no, line) -> path, ok, via, error (one row per path)."""
    t = F.regexp_replace(F.col(text), r"^\s+|\s+\z", "")
    parsed = (
        lines.select(F.col(line_no).alias("line_no"), t.alias("t"))
        .filter(F.col("t").startswith("{"))
        .select("line_no", F.from_json(F.col("t"), VERDICT).alias("v"))
        .filter(F.col("v.path").isNotNull())
    )
    last = parsed.groupBy(F.col("v.path").alias("path")).agg(
        F.max_by(
            F.struct(F.coalesce(F.col("v.ok"), F.lit(False)).alias("ok"), F.col("v.via").alias("via"), F.col("v.error").alias("error")),
            F.col("line_no"),
        ).alias("r")
    )
    return last.select("path", "r.ok", "r.via", "r.error")


def read_verdict_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read the decoder's output: one file, or a folder of files whose names
    sort in the order of their runs. A line's place is (file, offset of the
    split it lies in, position within the split), so a later file's verdict
    wins over an earlier one's in whatever order the files are scanned."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("position"),
    )
    return parse_verdict_lines(spark.read.text(path).select(place.alias("line_no"), F.col("value").alias("line")))
