"""Creation-date inference from file names and directory paths (COL-4..6).

Each rule is a leftmost regex match; a calendar-invalid date sends the
value to the next rule, an invalid time keeps midnight of the date. All
work is native Column expressions (regexp_extract + try_make_timestamp_ntz),
so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the date patterns, in the order they are tried --------
# file name
FILENAME_COMPACT = r"(\d{8})(?:_(\d{6,9}))?"
FILENAME_HYPHEN = (
    r"(?i)(\d{4})-(\d{2})-(\d{2})(?:_(\d{6,9})|-(\d{2})-(\d{2})-(\d{2})"
    r"|\s+at\s+(\d{1,2})\.(\d{2})\.(\d{2})\s*(AM|PM))?"
)
FILENAME_UNDERSCORE = r"(\d{4})_(\d{2})_(\d{2})(?:_(\d{6,9}))?"
FILENAME_SPACE = r"(\d{4})\s+(\d{2})\s+(\d{2})"
# directory path (separators on both sides)
PATH_HYPHEN = r"[/\\](\d{4})-(\d{2})-(\d{2})[/\\]"
PATH_UNDERSCORE = r"[/\\](\d{4})_(\d{2})_(\d{2})[/\\]"
PATH_COMPACT = r"[/\\](\d{8})[/\\]"
PATH_YEAR_MONTH_DAY = r"[/\\](\d{4})[/\\](\d{2})[/\\](\d{2})[/\\]"
PATH_YEAR_ONLY = r"[/\\](\d{4})[/\\]"
MIN_VALID_YEAR = 1900
OUTPUT_FORMAT = "yyyy:MM:dd HH:mm:ss"
# --------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _int(s: Column) -> Column:
    return F.when(s != "", s.try_cast("int"))


def _ts(y, m, d, hh=None, mi=None, ss=None) -> Column:
    zero = F.lit(0)
    y, m, d = _int(y), _int(m), _int(d)
    ts = F.try_make_timestamp_ntz(
        y, m, d, hh if hh is not None else zero, mi if mi is not None else zero, ss if ss is not None else zero
    )
    return F.when(y >= 1, ts)


def _hms_ok(hh, mi, ss) -> Column:
    return (hh >= 0) & (hh <= 23) & (mi >= 0) & (mi <= 59) & (ss >= 0) & (ss <= 59)


def _with_compact_time(date: Column, y, m, d, digits: Column) -> Column:
    """date plus the first six digits of a 6-9 digit run as HHmmss, or the
    date at midnight when that time is not valid."""
    hh, mi, ss = _int(F.substring(digits, 1, 2)), _int(F.substring(digits, 3, 2)), _int(F.substring(digits, 5, 2))
    timed = F.when((digits != "") & _hms_ok(hh, mi, ss), _ts(y, m, d, hh, mi, ss))
    return F.when(date.isNotNull(), F.coalesce(timed, date))


# Each rule is written as stages: regex groups -> integers -> candidate
# timestamps -> choice. A stage reads the previous ones through ``g``; in a
# DataFrame job every stage is its own projection, so a value used many
# times is computed once and the generated code stays small.


def _filename_stages(name: Column):
    def groups(g):
        out = {"c8": F.regexp_extract(name, FILENAME_COMPACT, 1), "t1": F.regexp_extract(name, FILENAME_COMPACT, 2)}
        for i, k in enumerate(["y2", "m2", "d2", "t2", "h2", "mi2", "s2", "h12", "m12", "s12", "ap"], start=1):
            out[k] = F.regexp_extract(name, FILENAME_HYPHEN, i)
        for i, k in enumerate(["y3", "m3", "d3", "t3"], start=1):
            out[k] = F.regexp_extract(name, FILENAME_UNDERSCORE, i)
        for i, k in enumerate(["y4", "m4", "d4"], start=1):
            out[k] = F.regexp_extract(name, FILENAME_SPACE, i)
        return out

    def ints(g):
        out = {}
        for tag, y, m, d, t in (
            ("1", F.substring(g("c8"), 1, 4), F.substring(g("c8"), 5, 2), F.substring(g("c8"), 7, 2), g("t1")),
            ("2", g("y2"), g("m2"), g("d2"), g("t2")),
            ("3", g("y3"), g("m3"), g("d3"), g("t3")),
        ):
            out["iy" + tag], out["im" + tag], out["id" + tag] = _int(y), _int(m), _int(d)
            out["th" + tag] = _int(F.substring(t, 1, 2))
            out["tm" + tag] = _int(F.substring(t, 3, 2))
            out["ts" + tag] = _int(F.substring(t, 5, 2))
        out["iy4"], out["im4"], out["id4"] = _int(g("y4")), _int(g("m4")), _int(g("d4"))
        out["dh2"], out["dm2"], out["ds2"] = _int(g("h2")), _int(g("mi2")), _int(g("s2"))
        h12 = _int(g("h12"))
        pm = F.upper(g("ap")) == "PM"
        out["ph2"] = F.when(h12 == 12, F.when(pm, F.lit(12)).otherwise(F.lit(0))).otherwise(
            F.when(pm, h12 + 12).otherwise(h12)
        )
        out["ok12"] = (h12 >= 1) & (h12 <= 12) & (_int(g("m12")) <= 59) & (_int(g("s12")) <= 59)
        out["pm2"], out["ps2"] = _int(g("m12")), _int(g("s12"))
        return out

    def candidates(g):
        out = {}
        for tag, present in (("1", g("c8") != ""), ("2", g("y2") != ""), ("3", g("y3") != ""), ("4", g("y4") != "")):
            y, m, d = g("iy" + tag), g("im" + tag), g("id" + tag)
            out["date" + tag] = F.when(present & (y >= 1), F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0)))
        for tag in ("1", "2", "3"):
            y, m, d = g("iy" + tag), g("im" + tag), g("id" + tag)
            hh, mi, ss = g("th" + tag), g("tm" + tag), g("ts" + tag)
            t = g("t" + tag)
            out["timed" + tag] = F.when(
                (t != "") & (y >= 1) & _hms_ok(hh, mi, ss), F.try_make_timestamp_ntz(y, m, d, hh, mi, ss)
            )
        y, m, d = g("iy2"), g("im2"), g("id2")
        out["dashed2"] = F.when(
            (y >= 1) & _hms_ok(g("dh2"), g("dm2"), g("ds2")), F.try_make_timestamp_ntz(y, m, d, g("dh2"), g("dm2"), g("ds2"))
        )
        out["dotted2"] = F.when((y >= 1) & g("ok12"), F.try_make_timestamp_ntz(y, m, d, g("ph2"), g("pm2"), g("ps2")))
        return out

    def choice(g):
        r1 = F.when(g("date1").isNotNull(), F.coalesce(g("timed1"), g("date1")))
        d2 = g("date2")
        r2 = F.when(
            d2.isNotNull(),
            F.when(g("t2") != "", F.coalesce(g("timed2"), d2))
            .when(g("h2") != "", F.coalesce(g("dashed2"), d2))
            .when(g("h12") != "", F.coalesce(g("dotted2"), d2))
            .otherwise(d2),
        )
        r3 = F.when(g("date3").isNotNull(), F.coalesce(g("timed3"), g("date3")))
        return {"value": F.coalesce(r1, r2, r3, g("date4"))}

    return [groups, ints, candidates, choice]


def _path_stages(p: Column, as_of_year: int):
    def groups(g):
        out = {}
        for rx, tag in ((PATH_HYPHEN, "h"), (PATH_UNDERSCORE, "u"), (PATH_YEAR_MONTH_DAY, "s")):
            for i, k in enumerate("ymd", start=1):
                out[k + tag] = _int(F.regexp_extract(p, rx, i))
        c8 = F.regexp_extract(p, PATH_COMPACT, 1)
        out["yc"], out["mc"], out["dc"] = _int(F.substring(c8, 1, 4)), _int(F.substring(c8, 5, 2)), _int(F.substring(c8, 7, 2))
        out["yo"] = _int(F.regexp_extract(p, PATH_YEAR_ONLY, 1))
        return out

    def choice(g):
        def ts(tag):
            y = g("y" + tag)
            return F.when(y >= 1, F.try_make_timestamp_ntz(y, g("m" + tag), g("d" + tag), F.lit(0), F.lit(0), F.lit(0)))

        yo = g("yo")
        return {
            "value": F.coalesce(
                ts("h"),
                ts("u"),
                ts("c"),
                ts("s"),
                F.when(
                    (yo >= MIN_VALID_YEAR) & (yo <= as_of_year),
                    F.try_make_timestamp_ntz(yo, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
                ),
            )
        }

    return [groups, choice]


def _compose(stages) -> Column:
    env: dict[str, Column] = {}
    for st in stages:
        env.update(st(env.__getitem__))
    return env["value"]


def _staged(df, stages, prefix: str, out: str):
    made: list[str] = []
    for st in stages:
        cols = st(lambda k: F.col(prefix + k))
        df = df.withColumns({prefix + k: v for k, v in cols.items()})
        made += [prefix + k for k in cols]
    return df.withColumn(out, F.col(prefix + "value")).drop(*made)


def date_from_filename(name) -> Column:
    """COL-4: timestamp_ntz parsed from a file name, or null."""
    return _compose(_filename_stages(_c(name)))


def date_from_path(path, as_of_year: int) -> Column:
    """COL-5: timestamp_ntz from a directory segment of the path, or null."""
    return _compose(_path_stages(_c(path), as_of_year))


def is_valid_year(ts: Column, as_of_year: int) -> Column:
    y = F.year(ts)
    return ts.isNotNull() & (y >= MIN_VALID_YEAR) & (y <= as_of_year)


def infer_created_date(path, as_of_year: int) -> Column:
    """COL-6: file-name date when its year is valid, else the path date when
    valid, else null. ``as_of_year`` stands for the current year so runs are
    reproducible."""
    p = _c(path)
    from_name = date_from_filename(F.substring_index(p, "/", -1))
    from_path = date_from_path(p, as_of_year)
    return F.when(is_valid_year(from_name, as_of_year), from_name).when(
        is_valid_year(from_path, as_of_year), from_path
    )


def format_date(ts) -> Column:
    """Timestamp printed as the metadata date string 'yyyy:MM:dd HH:mm:ss'."""
    return F.date_format(_c(ts), OUTPUT_FORMAT)


def with_dates(df, as_of_year: int, path: str = "path"):
    """Whole-table job: add name_date, path_date and created_date, one small
    projection per stage."""
    p = F.col(path)
    df = _staged(df, _filename_stages(F.substring_index(p, "/", -1)), "_dn_", "name_date")
    df = _staged(df, _path_stages(p, as_of_year), "_dp_", "path_date")
    return df.withColumn(
        "created_date",
        F.when(is_valid_year(F.col("name_date"), as_of_year), F.col("name_date")).when(
            is_valid_year(F.col("path_date"), as_of_year), F.col("path_date")
        ),
    )
