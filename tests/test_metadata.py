"""Vector tests for metadata columns (COL-7..13)."""

import json

import pytest
from pyspark.sql import functions as F

from mediacat.functions import metadata as M
from mediacat.functions.tags import checksum_to_hex


def _meta(spark, docs):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "path string, meta_json string")
    return {r.path: r for r in M.with_metadata(df).collect()}


def test_subject_normalisation(spark):
    docs = [
        '{"XMP:Subject":["tag1",2009,"tag2"]}',
        '{"XMP:Subject":"solo"}',
        '{"XMP:Subject":2009}',
        '{"XMP:Subject":null}',
        "{}",
        '[{"XMP:Subject":["a"]}]',
    ]
    got = _meta(spark, docs)
    assert got["0"].subjects == ["tag1", "2009", "tag2"]
    assert got["1"].subjects == ["solo"]
    assert got["2"].subjects == ["2009"]
    assert got["3"].subjects is None
    assert got["4"].subjects is None
    assert got["5"].subjects == ["a"]  # tool output wrapped in [...]


def test_malformed_documents_are_not_ok(spark):
    whole = '{"File:FileTypeExtension":"JPG","EXIF:CreateDate":"2010:01:02 03:04:05"}'
    docs = [whole, "[" + whole + "]", whole[:-1], whole[:-9], "garbage", "", "  ", None, "17", '"text"', "[]", "{}"]
    got = _meta(spark, docs)
    assert [got[str(i)].meta_ok for i in range(len(docs))] == [True, True] + [False] * 9 + [True]
    assert all(got[str(i)].meta_ext is None and got[str(i)].meta_date is None for i in range(2, 11))


def test_date_priority(spark):
    docs = [
        {"EXIF:DateTimeOriginal": "2001:01:01 00:00:00", "EXIF:CreateDate": "2002:01:01 00:00:00"},
        {"EXIF:CreateDate": "", "XMP:CreateDate": "2003:01:01 00:00:00"},
        {"QuickTime:CreateDate": "0000:00:00 00:00:00", "H264:DateTimeOriginal": "2004:01:01 00:00:00"},
        {"ASF:CreationDate": "0000:01:01 00:00:00", "RIFF:DateTimeOriginal": "2005:01:01 00:00:00"},
        {"IPTC:DateCreated": "2006:01:01", "Composite:DateTimeCreated": "2006:01:01 00:00:00"},
        {"XMP:CreateDate": "2018:02:03 04:05:06.789"},
        {"EXIF:DateTimeOriginal": "2019:03:04 05:06:07+02:00"},
    ]
    got = _meta(spark, [json.dumps(d) for d in docs])
    assert got["0"].meta_date_string == "2001:01:01 00:00:00"
    assert got["1"].meta_date_string == "2003:01:01 00:00:00"
    assert got["2"].meta_date_string == "2004:01:01 00:00:00"
    assert got["3"].meta_date_string == "2005:01:01 00:00:00"
    assert got["4"].meta_date_string is None  # IPTC / Composite are never used
    # present but unparsable: date string set, parsed date null
    assert got["5"].meta_date_string is not None and got["5"].meta_date is None
    assert got["6"].meta_date is None


@pytest.mark.parametrize(
    "verdict,errors,warnings",
    [
        *[(f"{e} Error{'s' * (e > 1)}, {w} Warning{'s' * (w > 1)}", e, w) for e in (1, 7, 30) for w in (1, 8, 41)],
        ("6 Warnings (2 minor)", 0, 6),
        ("5 Errors", 5, 0),
        ("9 warnings", 0, 9),
        ("OK", 0, 0),
        ("", 0, 0),
        (None, 0, 0),
        ("none -4 Errors", 0, 0),
    ],
)
def test_validation_counts(spark, verdict, errors, warnings):
    e, w = M.validation_counts(F.lit(verdict).cast("string"))
    r = spark.range(1).select(e.alias("e"), w.alias("w")).first()
    assert (r.e, r.w) == (errors, warnings)


@pytest.mark.parametrize(
    "version,newer",
    [
        *[(f"{major}.{minor}{tail}", (major, minor) > (1, 4)) for major in (0, 1, 2, 10) for minor in (0, 4, 5, 40) for tail in ("", ".7", ".0.3")],
        *[(text, False) for text in ("", "1", "2", "9.", ".9", "x.9", "9.x", "-2.0", None)],
    ],
)
def test_dng_newer(spark, version, newer):
    assert spark.range(1).select(M.is_dng_newer(F.lit(version).cast("string")).alias("n")).first().n is newer


def test_checksum_to_hex(spark):
    import base64

    good = base64.b64encode(bytes([0xAB] * 20)).decode()
    short = base64.b64encode(bytes([1] * 19)).decode()
    rows = [(good,), ("",), ("   ",), ("not-valid-base64!!!",), (short,), (good.rstrip("="),), (None,), (" " + good + " ",)]
    df = spark.createDataFrame(rows, "c string").select(checksum_to_hex(F.col("c")).alias("h"))
    got = [r.h for r in df.collect()]
    assert got == ["ab" * 20, None, None, None, None, None, None, "ab" * 20]


def test_date_only_format(spark):
    from mediacat.functions.tags import check_date_only_format

    check_date_only_format(spark, "yyyy/MM/dd")
    check_date_only_format(spark, "yyyy/MM")
    with pytest.raises(ValueError):
        check_date_only_format(spark, "yyyy/MM/dd/HH")
