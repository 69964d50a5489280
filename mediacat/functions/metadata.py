"""Metadata documents: typed projection and derived columns (SRC-4, COL-7..12).

A metadata document is the JSON object the metadata tool prints for one
file (optionally wrapped in ``[...]``). It is parsed once with an explicit
schema (no inference); every derived column is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the group-qualified keys that are read ----------------
METADATA_KEYS = [
    "File:FileModifyDate",
    "File:FileType",
    "File:FileTypeExtension",
    "File:MIMEType",
    "H264:DateTimeOriginal",
    "QuickTime:CreateDate",
    "QuickTime:ModifyDate",
    "ASF:CreationDate",
    "RIFF:DateTimeOriginal",
    "EXIF:ModifyDate",
    "EXIF:DateTimeOriginal",
    "EXIF:CreateDate",
    "EXIF:DNGVersion",
    "XMP:ModifyDate",
    "XMP:CreateDate",
    "XMP:Subject",
    "XMP:DateCreated",
    "IPTC:DigitalCreationTime",
    "IPTC:DigitalCreationDate",
    "IPTC:DateCreated",
    "IPTC:TimeCreated",
    "Composite:DateTimeCreated",
    "Composite:DigitalCreationDateTime",
    "Matroska:DateTimeOriginal",
    "ExifTool:Validate",
    "ExifTool:Error",
    "QuickTime:ContentIdentifier",
    "MakerNotes:ContentIdentifier",
]
# Date keys in priority order, with the placeholder values that do not count.
ZERO_QUICKTIME_DATE = "0000:00:00 00:00:00"
ZERO_ASF_PREFIX = "0000:"
METADATA_DATE_FORMAT = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})\z"
DNG_NEWER_THAN = (1, 4)
# --------------------------------------------------------------------------

# XMP:Subject is read as a string so that arrays, bare strings and bare
# numbers all keep their raw JSON text; normalise_subject turns it into an
# array<string>.
METADATA_SCHEMA = T.StructType([T.StructField(k, T.StringType(), True) for k in METADATA_KEYS])


def column_name(key: str) -> str:
    """'EXIF:DateTimeOriginal' -> 'exif_datetimeoriginal'."""
    return key.replace(":", "_").lower()


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def parse_metadata(docs: DataFrame, json_col: str = "meta_json") -> DataFrame:
    """SRC-4: typed columns for every key plus ``meta_ok`` (false, with all
    keys null, when the document is empty, malformed, cut short or not a JSON
    object)."""
    # the tool's output is trimmed of spaces, CR, LF and the array brackets
    raw = F.regexp_replace(F.col(json_col), r"^[ \n\r\[\]]+|[ \n\r\[\]]+\z", "")
    schema = T.StructType([*METADATA_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json(F.when(raw.startswith("{"), raw), schema, {"columnNameOfCorruptRecord": "_broken"})
    out = docs.withColumn("_meta", parsed)
    out = out.withColumn("_meta", F.when(F.col("_meta._broken").isNull(), F.col("_meta")))
    cols = [F.col(c) for c in docs.columns if c != json_col]
    cols.append(F.col("_meta").isNotNull().alias("meta_ok"))
    for k in METADATA_KEYS:
        cols.append(F.col("_meta").getField(k).alias(column_name(k)))
    return out.select(*cols)


def metadata_date_string(m: str = "") -> Column:
    """COL-7: first usable date string in priority order, or null."""

    def g(key):
        return F.col(m + column_name(key))

    qt = g("QuickTime:CreateDate")
    asf = g("ASF:CreationDate")
    return (
        F.when(_nonempty(g("EXIF:DateTimeOriginal")), g("EXIF:DateTimeOriginal"))
        .when(_nonempty(g("EXIF:CreateDate")), g("EXIF:CreateDate"))
        .when(_nonempty(g("XMP:CreateDate")), g("XMP:CreateDate"))
        .when(_nonempty(qt) & (qt != ZERO_QUICKTIME_DATE), qt)
        .when(_nonempty(g("H264:DateTimeOriginal")), g("H264:DateTimeOriginal"))
        .when(_nonempty(asf) & ~asf.startswith(ZERO_ASF_PREFIX), asf)
        .when(_nonempty(g("RIFF:DateTimeOriginal")), g("RIFF:DateTimeOriginal"))
    )


def metadata_date(date_string) -> Column:
    """COL-8: strict 'yyyy:MM:dd HH:mm:ss' parse (timestamp_ntz), null otherwise."""
    s = _c(date_string)
    p = [F.regexp_extract(s, METADATA_DATE_FORMAT, i).try_cast("int") for i in range(7)]
    ok = s.rlike(METADATA_DATE_FORMAT) & (p[1] >= 1) & (p[4] <= 23) & (p[5] <= 59) & (p[6] <= 59)
    return F.when(ok, F.try_make_timestamp_ntz(p[1], p[2], p[3], p[4], p[5], p[6]))


def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def validation_counts(verdict) -> tuple[Column, Column]:
    """COL-9: (errors, warnings) from a validation verdict such as
    '2 Errors, 3 Warnings' or '4 Warnings (all minor)'."""
    v = _c(verdict)

    def clause_struct(x):
        c = _strip_ws(F.regexp_replace(_strip_ws(x), r"(?s)\(.*\z", ""))
        cnt = F.regexp_extract(c, r"(?s)^([0-9]+) ", 1).try_cast("int")
        noun = F.lower(_strip_ws(F.regexp_extract(c, r"(?s)^[0-9]+ (.*)\z", 1)))
        return F.struct(
            F.when(cnt.isNotNull() & noun.startswith("error"), cnt).otherwise(F.lit(0)).alias("e"),
            F.when(cnt.isNotNull() & ~noun.startswith("error") & noun.startswith("warning"), cnt)
            .otherwise(F.lit(0))
            .alias("w"),
        )

    parts = F.transform(F.split(F.coalesce(v, F.lit("")), ","), clause_struct)
    errors = F.aggregate(parts, F.lit(0), lambda acc, s: acc + s["e"])
    warnings = F.aggregate(parts, F.lit(0), lambda acc, s: acc + s["w"])
    return errors, warnings


def is_dng_newer(version) -> Column:
    """COL-10: DNG version major.minor above 1.4; malformed -> false."""
    v = _c(version)
    rx = r"(?s)^([0-9]+)\.([0-9]+)(\..*)?\z"
    major = F.regexp_extract(v, rx, 1).try_cast("int")
    minor = F.regexp_extract(v, rx, 2).try_cast("int")
    newer = (major > DNG_NEWER_THAN[0]) | ((major == DNG_NEWER_THAN[0]) & (minor > DNG_NEWER_THAN[1]))
    return F.coalesce(v.rlike(rx) & newer, F.lit(False))


def content_identifier(m: str = "") -> Column:
    """COL-11: QuickTime content id, else the maker-notes one."""
    return F.coalesce(
        F.col(m + column_name("QuickTime:ContentIdentifier")), F.col(m + column_name("MakerNotes:ContentIdentifier"))
    )


def normalise_subject(raw) -> Column:
    """COL-12: raw XMP:Subject JSON text -> array<string> (null stays null)."""
    r = _c(raw)
    return F.when(r.isNull(), F.lit(None).cast("array<string>")).when(
        r.startswith("["), F.from_json(r, T.ArrayType(T.StringType()))
    ).otherwise(F.array(r))


def with_metadata(docs: DataFrame, json_col: str = "meta_json") -> DataFrame:
    """Whole-table job: parse documents and add every derived metadata column."""
    df = parse_metadata(docs, json_col)
    errors, warnings = validation_counts(F.col(column_name("ExifTool:Validate")))
    return (
        df.withColumn("meta_date_string", metadata_date_string())
        .withColumn("meta_date", metadata_date(F.col("meta_date_string")))
        .withColumn("validate_errors", errors)
        .withColumn("validate_warnings", warnings)
        .withColumn("dng_newer", is_dng_newer(F.col(column_name("EXIF:DNGVersion"))))
        .withColumn("content_id", content_identifier())
        .withColumn("subjects", normalise_subject(F.col(column_name("XMP:Subject"))))
        .withColumn("meta_ext", F.col(column_name("File:FileTypeExtension")))
    )
