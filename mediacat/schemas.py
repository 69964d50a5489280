"""Fixed schemas of the catalogue tables (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("file_size", T.LongType(), True),
        T.StructField("mtime_ticks", T.LongType(), True),
    ]
)

HASHES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("sha256", T.StringType(), True),
        T.StructField("sha1", T.StringType(), True),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("sha256", T.StringType(), False),
        T.StructField("sha1", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("mtime_ticks", T.LongType(), False),
        T.StructField("is_processed", T.BooleanType(), False),
    ]
)
LEDGER_COLUMNS = [f.name for f in LEDGER.fields]

TRASH = T.StructType(
    [
        T.StructField("sha1", T.StringType(), False),
        T.StructField("original_file_name", T.StringType(), True),
    ]
)

TRASH_PAGE = T.StructType(
    [
        T.StructField("page", T.LongType(), False),
        T.StructField("next_page", T.StringType(), True),
        T.StructField("id", T.StringType(), True),
        T.StructField("checksum", T.StringType(), True),
        T.StructField("original_file_name", T.StringType(), True),
        T.StructField("is_trashed", T.BooleanType(), True),
    ]
)

# One feed response as landed JSON: {"assets": {"items": [...], "nextPage": ...}}
FEED_RESPONSE = T.StructType(
    [
        T.StructField(
            "assets",
            T.StructType(
                [
                    T.StructField(
                        "items",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("id", T.StringType(), True),
                                    T.StructField("checksum", T.StringType(), True),
                                    T.StructField("originalFileName", T.StringType(), True),
                                    T.StructField("isTrashed", T.BooleanType(), True),
                                ]
                            )
                        ),
                        True,
                    ),
                    T.StructField("nextPage", T.StringType(), True),
                ]
            ),
            True,
        )
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("path", T.StringType(), True),
        T.StructField("ok", T.BooleanType(), True),
        T.StructField("via", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

PLAN = T.StructType(
    [
        T.StructField("seq", T.LongType(), True),
        T.StructField("action", T.StringType(), False),
        T.StructField("path", T.StringType(), True),
        T.StructField("target", T.StringType(), True),
        T.StructField("reason", T.StringType(), True),
    ]
)


def assert_columns(df, schema: T.StructType, what: str) -> None:
    """Raise when ``df`` lacks a column of ``schema`` (type-checked by name)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{what}: missing column(s) {', '.join(missing)}")
    wrong = [f.name for f in schema.fields if have[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"{what}: unexpected type for column(s) {', '.join(wrong)}")
