"""Date inference (COL-4..6). The vectors are made from the rules: each pattern
with each kind of time, the calendar's edges, and what must fall through."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from mediacat.functions import dates as D

DAYS = [(1904, 2, 29), (1950, 1, 31), (2000, 2, 29), (2011, 11, 30), (2016, 12, 1)]
NOT_DAYS = [(2001, 2, 29), (2010, 4, 31), (2012, 0, 9), (2012, 13, 9), (2012, 6, 0), (1900, 2, 29)]
TIMES = [(0, 0, 0), (9, 8, 7), (23, 59, 59)]
NOT_TIMES = [(24, 0, 0), (3, 60, 1), (3, 4, 60)]


def stamp(day, time=(0, 0, 0)):
    return "{:04d}:{:02d}:{:02d} ".format(*day) + "{:02d}:{:02d}:{:02d}".format(*time)


def written(day, sep):
    return sep.join(["{:04d}", "{:02d}", "{:02d}"]).format(*day)


def filename_vectors():
    for day, sep in itertools.product(DAYS, ["", "-", "_", " "]):
        bare = written(day, sep)
        yield f"roll {bare}end.jpg" if sep else f"roll{bare}.jpg", stamp(day)
        for time in TIMES + NOT_TIMES:
            want = stamp(day, time if time in TIMES else (0, 0, 0))
            clock = "{:02d}{:02d}{:02d}".format(*time)
            if sep != " ":
                yield f"x{bare}_{clock}.tif", want
                yield f"{bare}_{clock}987.tif", want  # milliseconds are not read
            else:
                yield f"x{bare}_{clock}.tif", stamp(day)
            if sep == "-":
                yield "cam {}-{:02d}-{:02d}-{:02d}.mov".format(bare, *time), want
    for hour, half, read in [(12, "AM", 0), (12, "pm", 12), (1, "am", 1), (11, "PM", 23)]:
        yield f"Shot 2014-03-02 at {hour}.05.06 {half}.png", stamp((2014, 3, 2), (read, 5, 6))
    for day in NOT_DAYS:
        for sep in ["", "-", "_", " "]:
            yield f"r{written(day, sep)}.heic", None
    # a day that is none leaves the word to the next pattern, of which only the first match counts
    yield "20121399 2012-08-09.jpg", stamp((2012, 8, 9))
    yield "2012-02-30 2012-03-01.jpg", None
    yield "2012-02-30 2012_03_01.jpg", stamp((2012, 3, 1))
    yield "12-3-4.jpg", None
    yield "", None


def path_vectors():
    for day in DAYS:
        for sep in ("-", "_", "", "/", chr(92)):
            yield f"q/{written(day, sep)}/n.jpg", stamp(day)
        for sep in ("-", "_", ""):
            yield f"q/{written(day, sep)}n.jpg", None  # no separator after it
        yield f"q/{day[0]}/n.jpg", stamp((day[0], 1, 1))
    yield "q/2012/08/n.jpg", stamp((2012, 1, 1))
    yield "q/2030/n.jpg", None  # later than the year of the run
    yield "q/1899/n.jpg", None
    yield "q/2012-08-09/2013/01/02/n.jpg", stamp((2012, 8, 9))
    yield "q/2012/20130102/n.jpg", stamp((2013, 1, 2))
    yield "n.jpg", None


def run(spark, rows, expr):
    df = spark.createDataFrame(rows, "x string, expected string")
    return df.select("x", "expected", D.format_date(expr(F.col("x"))).alias("got")).collect()


def test_date_from_filename(spark):
    for r in run(spark, list(filename_vectors()), D.date_from_filename):
        assert r.got == r.expected, r.x


def test_date_from_path(spark):
    for r in run(spark, list(path_vectors()), lambda c: D.date_from_path(c, 2024)):
        assert r.got == r.expected, r.x


def test_with_dates_matches_column_version(spark):
    names = [(f"/k/z/{n}",) for n, _ in filename_vectors()] + [(p,) for p, _ in path_vectors()]
    df = spark.createDataFrame(names, "path string").distinct()
    staged = D.with_dates(df, 2024).select("path", D.format_date(F.col("created_date")).alias("a"))
    direct = df.select("path", D.format_date(D.infer_created_date(F.col("path"), 2024)).alias("b"))
    rows = staged.join(direct, "path").collect()
    assert rows and all(r.a == r.b for r in rows)


@pytest.mark.parametrize("year", [1899, 1900, 2024, 2025])
@pytest.mark.parametrize("folder", ["2007", "2007-05-06", "1880-05-06", "plain"])
def test_name_then_path_and_no_second_chance(spark, year, folder):
    path = f"/k/{folder}/clip {year}0203.mp4"
    in_name = dt.date(year, 2, 3) if 1900 <= year <= 2024 else None
    in_path = {"2007": dt.date(2007, 1, 1), "2007-05-06": dt.date(2007, 5, 6)}.get(folder)
    want = in_name or in_path
    got = spark.range(1).select(D.infer_created_date(F.lit(path), 2024).cast("date").alias("g")).first().g
    assert got == want
