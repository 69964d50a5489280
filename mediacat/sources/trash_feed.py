"""Trash feed pages and the trash set (SRC-5, SRC-6).

Feed responses are landed as JSON documents, one per requested page
(``{"assets": {"items": [...], "nextPage": "2"}}``). They are read with an
explicit schema and exploded into one row per asset; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEED_RESPONSE, TRASH, assert_columns


def parse_feed_pages(pages: DataFrame, page_col: str = "page", json_col: str = "body") -> DataFrame:
    """Landed page documents (page, body) -> page, next_page, item_no, id,
    checksum, original_file_name, is_trashed. An empty page keeps one row
    with null item fields so the traversal can see it."""
    doc = F.from_json(F.col(json_col), FEED_RESPONSE)
    parsed = pages.select(F.col(page_col).cast("long").alias("page"), doc.alias("doc"))
    exploded = parsed.select(
        "page",
        F.col("doc.assets.nextPage").alias("next_page"),
        F.posexplode_outer("doc.assets.items").alias("item_no", "item"),
    )
    return exploded.select(
        "page",
        "next_page",
        "item_no",
        F.col("item.id").alias("id"),
        F.col("item.checksum").alias("checksum"),
        F.col("item.originalFileName").alias("original_file_name"),
        F.col("item.isTrashed").alias("is_trashed"),
    )


def read_feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Read landed page files named ``page-<n>.json`` below ``path``."""
    raw = spark.read.option("wholetext", "true").text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"page-(\d+)\.json$", 1).cast("long").alias("page"),
        F.col("value").alias("body"),
    )
    return parse_feed_pages(raw)


def read_trash_set(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: load a trash set snapshot; a missing table is an error that
    tells the user to run the trash sync first."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - AnalysisException for a missing path
        raise FileNotFoundError(f"trash set not found at {path}: run the trash sync first") from e
    assert_columns(df, TRASH, "trash set")
    return df.select("sha1", "original_file_name")
