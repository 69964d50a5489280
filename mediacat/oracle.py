"""DuckDB oracle SQL for the registered queries.

Each entry is plain SQL over the driver tables; the fixture views it needs
are prepended as CTEs by :func:`mediacat.fixtures.duckdb_with`. The SQL is
written independently of the Spark code path (set-oriented, no shared
helpers beyond the fixed extension lists).
"""

from __future__ import annotations

import re

from .fixtures import AS_OF_YEAR, duckdb_with
from .functions import dates as DT
from .functions import names as N

ORACLE: dict[str, str] = {}


def _lst(values) -> str:
    return "(" + ",".join("'" + v + "'" for v in values) + ")"


SUPPORTED = _lst(N.SUPPORTED_EXTENSIONS)


def ext(col: str) -> str:
    return f"regexp_extract({col}, '(\\.[^./]+)$', 1)"


def supported(col: str) -> str:
    return f"lower({ext(col)}) IN {SUPPORTED}"


_STRUCT_FIELD = re.compile(r"\b(_[a-z][a-z0-9]*)\.([a-z][a-z0-9]*)\b")


def add(name: str, views: list[str], body: str) -> None:
    # lateral struct aliases are addressed as _alias['field'] in DuckDB
    body = _STRUCT_FIELD.sub(lambda m: f"{m.group(1)}['{m.group(2)}']", body)
    ORACLE[name] = duckdb_with(views, body)


# ---------------------------------------------------------------- index
_INDEX_BODY = """
, f AS (SELECT path, file_size, mtime_ticks, sha256, sha1 FROM media_files),
r AS (
 SELECT f.path, f.file_size, f.mtime_ticks, l.path AS lpath, l.is_processed AS lproc,
   l.sha256 AS lsha,
   CASE WHEN l.path IS NOT NULL AND f.file_size = l.file_size AND f.mtime_ticks = l.mtime_ticks
        THEN l.sha256 ELSE f.sha256 END AS sha256,
   CASE WHEN l.path IS NOT NULL AND f.file_size = l.file_size AND f.mtime_ticks = l.mtime_ticks
        THEN l.sha1 ELSE f.sha1 END AS sha1,
   (l.path IS NOT NULL AND (f.file_size <> l.file_size OR f.mtime_ticks <> l.mtime_ticks)) AS touched
 FROM f LEFT JOIN ledger l ON f.path = l.path
 WHERE {sup}
),
o AS (
 SELECT path, file_size, mtime_ticks, sha256, sha1, lpath,
  CASE WHEN lpath IS NULL THEN 'Inserted'
       WHEN sha256 <> lsha THEN 'Updated'
       WHEN touched THEN CASE WHEN lproc THEN 'Unchanged' ELSE 'Updated' END
       ELSE 'Unchanged' END AS status,
  CASE WHEN lpath IS NULL THEN {mark}
       WHEN sha256 <> lsha THEN false
       ELSE lproc END AS was_processed
 FROM r
)
"""


def _index_with(mark: str) -> str:
    return _INDEX_BODY.format(sup=supported("f.path"), mark=mark)


def _index_ctes(mark="false"):
    # leading comma joins the fixture CTE list
    return _index_with(mark)


add(
    "index_outcomes",
    ["media_files", "ledger"],
    _index_ctes()
    + f"""
SELECT path, status, was_processed FROM o
UNION ALL
SELECT path, 'Ignored' AS status, CAST(NULL AS BOOLEAN) AS was_processed FROM f WHERE NOT ({supported('path')})
""",
)

add(
    "index_mark_processed_outcomes",
    ["media_files", "ledger"],
    _index_ctes("true")
    + f"""
SELECT path, status, was_processed FROM o
UNION ALL
SELECT path, 'Ignored' AS status, CAST(NULL AS BOOLEAN) AS was_processed FROM f WHERE NOT ({supported('path')})
""",
)

add(
    "index_ledger",
    ["media_files", "ledger"],
    _index_ctes()
    + """
SELECT path, sha256, sha1, file_size, mtime_ticks, was_processed AS is_processed FROM o
UNION ALL
SELECT path, sha256, sha1, file_size, mtime_ticks, is_processed FROM ledger
WHERE path NOT IN (SELECT path FROM o)
""",
)

add(
    "index_summary",
    ["media_files", "ledger"],
    _index_ctes()
    + f"""
, allrows AS (
 SELECT status FROM o
 UNION ALL SELECT 'Ignored' FROM f WHERE NOT ({supported('path')})
)
SELECT count(*) AS total,
 CAST(count_if(status = 'Inserted') AS BIGINT) AS n_inserted, CAST(count_if(status = 'Updated') AS BIGINT) AS n_updated,
 CAST(count_if(status = 'Unchanged') AS BIGINT) AS n_unchanged, CAST(count_if(status = 'Ignored') AS BIGINT) AS n_ignored,
 CAST(count_if(status = 'Failed') AS BIGINT) AS n_failed,
 CASE WHEN CAST(count_if(status = 'Failed') AS BIGINT) > 0 THEN 2 ELSE 0 END AS run_status
FROM allrows
""",
)


# ------------------------------------------------------------ column jobs


def q(s: str) -> str:
    """SQL string literal (DuckDB keeps backslashes literally)."""
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    return q(p.replace(r"\z", "$"))


def dts(y, m, d, hh="'00'", mi="'00'", ss="'00'") -> str:
    return (
        f"(CASE WHEN TRY_CAST({y} AS INTEGER) >= 1 THEN try_strptime({y} || '-' || {m} || '-' || {d} || ' ' || "
        f"{hh} || ':' || {mi} || ':' || {ss}, '%Y-%m-%d %H:%M:%S') END)"
    )


def tfmt(ts: str) -> str:
    return f"strftime({ts}, '%Y:%m:%d %H:%M:%S')"


def date_columns(path: str = "path", as_of: int = AS_OF_YEAR) -> str:
    """Select-list (DuckDB lateral aliases) computing name_date_ts,
    path_date_ts and created_ts for ``path``."""
    nm = f"regexp_extract({path}, '([^/]*)$', 1)"
    p1, p2, p3, p4 = (rx(DT.FILENAME_COMPACT), rx(DT.FILENAME_HYPHEN), rx(DT.FILENAME_UNDERSCORE), rx(DT.FILENAME_SPACE))

    def ctime(date, y, m, d, t):
        return (
            f"CASE WHEN {date} IS NOT NULL THEN coalesce(CASE WHEN {t} <> '' THEN "
            f"{dts(y, m, d, f'substr({t},1,2)', f'substr({t},3,2)', f'substr({t},5,2)')} END, {date}) END"
        )

    cols = [
        f"regexp_extract({nm}, {p1}, ['c8','t']) AS _g1",
        f"CASE WHEN _g1.c8 <> '' THEN {dts('substr(_g1.c8,1,4)', 'substr(_g1.c8,5,2)', 'substr(_g1.c8,7,2)')} END AS _d1",
        ctime("_d1", "substr(_g1.c8,1,4)", "substr(_g1.c8,5,2)", "substr(_g1.c8,7,2)", "_g1.t") + " AS _r1",
        f"regexp_extract({nm}, {p2}, ['y','m','d','t','h','mi','s','h12','m12','s12','ap']) AS _g2",
        f"CASE WHEN _g2.y <> '' THEN {dts('_g2.y', '_g2.m', '_g2.d')} END AS _d2",
        "TRY_CAST(_g2.h12 AS INTEGER) AS _h12",
        "CASE WHEN _h12 = 12 THEN (CASE WHEN upper(_g2.ap) = 'PM' THEN 12 ELSE 0 END) "
        "ELSE (CASE WHEN upper(_g2.ap) = 'PM' THEN _h12 + 12 ELSE _h12 END) END AS _h24",
        "CASE WHEN _d2 IS NULL THEN NULL "
        f"WHEN _g2.t <> '' THEN {ctime('_d2', '_g2.y', '_g2.m', '_g2.d', '_g2.t')} "
        f"WHEN _g2.h <> '' THEN coalesce({dts('_g2.y', '_g2.m', '_g2.d', '_g2.h', '_g2.mi', '_g2.s')}, _d2) "
        "WHEN _g2.h12 <> '' THEN coalesce(CASE WHEN _h12 BETWEEN 1 AND 12 THEN "
        f"{dts('_g2.y', '_g2.m', '_g2.d', 'lpad(CAST(_h24 AS VARCHAR),2,chr(48))', '_g2.m12', '_g2.s12')} END, _d2) "
        "ELSE _d2 END AS _r2",
        f"regexp_extract({nm}, {p3}, ['y','m','d','t']) AS _g3",
        f"CASE WHEN _g3.y <> '' THEN {dts('_g3.y', '_g3.m', '_g3.d')} END AS _d3",
        ctime("_d3", "_g3.y", "_g3.m", "_g3.d", "_g3.t") + " AS _r3",
        f"regexp_extract({nm}, {p4}, ['y','m','d']) AS _g4",
        f"CASE WHEN _g4.y <> '' THEN {dts('_g4.y', '_g4.m', '_g4.d')} END AS _r4",
        "coalesce(_r1, _r2, _r3, _r4) AS name_date_ts",
        f"regexp_extract({path}, {rx(DT.PATH_HYPHEN)}, ['y','m','d']) AS _p1",
        f"regexp_extract({path}, {rx(DT.PATH_UNDERSCORE)}, ['y','m','d']) AS _p2",
        f"regexp_extract({path}, {rx(DT.PATH_COMPACT)}, 1) AS _p3",
        f"regexp_extract({path}, {rx(DT.PATH_YEAR_MONTH_DAY)}, ['y','m','d']) AS _p4",
        f"TRY_CAST(regexp_extract({path}, {rx(DT.PATH_YEAR_ONLY)}, 1) AS INTEGER) AS _p5",
        "coalesce("
        f"CASE WHEN _p1.y <> '' THEN {dts('_p1.y', '_p1.m', '_p1.d')} END, "
        f"CASE WHEN _p2.y <> '' THEN {dts('_p2.y', '_p2.m', '_p2.d')} END, "
        f"CASE WHEN _p3 <> '' THEN {dts('substr(_p3,1,4)', 'substr(_p3,5,2)', 'substr(_p3,7,2)')} END, "
        f"CASE WHEN _p4.y <> '' THEN {dts('_p4.y', '_p4.m', '_p4.d')} END, "
        f"CASE WHEN _p5 BETWEEN 1900 AND {as_of} THEN make_timestamp(_p5, 1, 1, 0, 0, 0) END) AS path_date_ts",
        f"CASE WHEN year(name_date_ts) BETWEEN 1900 AND {as_of} THEN name_date_ts "
        f"WHEN year(path_date_ts) BETWEEN 1900 AND {as_of} THEN path_date_ts END AS created_ts",
    ]
    return ",\n ".join(cols)


add(
    "created_dates",
    ["media_files"],
    f"""
SELECT path, {tfmt('name_date_ts')} AS name_date, {tfmt('path_date_ts')} AS path_date, {tfmt('created_ts')} AS created_date
FROM (SELECT path, {date_columns()} FROM media_files) x
""",
)


def jget(doc: str, key: str) -> str:
    return f"json_extract_string({doc}, {q('$.' + chr(34) + key + chr(34))})"


def _ws_trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def validation_sql(v: str) -> tuple[str, str]:
    clause = _ws_trim(f"regexp_replace({_ws_trim('c')}, '(?s)\\(.*$', '')")
    cnt = f"TRY_CAST(regexp_extract({clause}, '^([0-9]+) ', 1) AS INTEGER)"
    noun = f"lower({_ws_trim(f'regexp_extract({clause}, {q(chr(40) + "?s" + chr(41) + "^[0-9]+ (.*)$")}, 1)')})"
    e = f"CASE WHEN {cnt} IS NOT NULL AND starts_with({noun}, 'error') THEN {cnt} ELSE 0 END"
    w = f"CASE WHEN {cnt} IS NOT NULL AND NOT starts_with({noun}, 'error') AND starts_with({noun}, 'warning') THEN {cnt} ELSE 0 END"
    parts = f"string_split(coalesce({v}, ''), ',')"
    return (
        f"CAST(coalesce(list_sum(list_transform({parts}, lambda c: {e})), 0) AS INTEGER)",
        f"CAST(coalesce(list_sum(list_transform({parts}, lambda c: {w})), 0) AS INTEGER)",
    )


META_DATE_STRING_SQL = """CASE
 WHEN coalesce(exif_dto,'') <> '' THEN exif_dto
 WHEN coalesce(exif_cd,'') <> '' THEN exif_cd
 WHEN coalesce(xmp_cd,'') <> '' THEN xmp_cd
 WHEN coalesce(qt_cd,'') <> '' AND qt_cd <> '0000:00:00 00:00:00' THEN qt_cd
 WHEN coalesce(h264,'') <> '' THEN h264
 WHEN coalesce(asf,'') <> '' AND NOT starts_with(asf, '0000:') THEN asf
 WHEN coalesce(riff,'') <> '' THEN riff END"""


def meta_columns(doc: str = "meta_json") -> str:
    j = f"regexp_replace({doc}, '^[ \\n\\r\\[\\]]+|[ \\n\\r\\[\\]]+$', '', 'g')"
    errors, warnings = validation_sql("validate")
    dng = "dngv"
    cols = [
        f"{j} AS _j",
        "json_valid(_j) AND _j <> '' AND starts_with(_j, '{') AS meta_ok",
        f"{jget('_j', 'File:FileTypeExtension')} AS meta_ext",
        f"{jget('_j', 'EXIF:DateTimeOriginal')} AS exif_dto",
        f"{jget('_j', 'EXIF:CreateDate')} AS exif_cd",
        f"{jget('_j', 'XMP:CreateDate')} AS xmp_cd",
        f"{jget('_j', 'QuickTime:CreateDate')} AS qt_cd",
        f"{jget('_j', 'H264:DateTimeOriginal')} AS h264",
        f"{jget('_j', 'ASF:CreationDate')} AS asf",
        f"{jget('_j', 'RIFF:DateTimeOriginal')} AS riff",
        f"{jget('_j', 'ExifTool:Validate')} AS validate",
        f"{jget('_j', 'EXIF:DNGVersion')} AS dngv",
        f"{jget('_j', 'XMP:Subject')} AS subject_raw",
        f"coalesce({jget('_j', 'QuickTime:ContentIdentifier')}, {jget('_j', 'MakerNotes:ContentIdentifier')}) AS content_id",
        f"{META_DATE_STRING_SQL} AS meta_date_string",
        "regexp_extract(meta_date_string, '^(\\d{4}):(\\d{2}):(\\d{2}) (\\d{2}):(\\d{2}):(\\d{2})$', ['y','m','d','h','mi','s']) AS _md",
        f"CASE WHEN _md.y <> '' THEN {dts('_md.y', '_md.m', '_md.d', '_md.h', '_md.mi', '_md.s')} END AS meta_date_ts",
        f"{errors} AS validate_errors",
        f"{warnings} AS validate_warnings",
        f"coalesce(regexp_matches({dng}, '(?s)^([0-9]+)\\.([0-9]+)(\\..*)?$') AND ("
        f"TRY_CAST(regexp_extract({dng}, '^([0-9]+)\\.', 1) AS INTEGER) > 1 OR "
        f"(TRY_CAST(regexp_extract({dng}, '^([0-9]+)\\.', 1) AS INTEGER) = 1 AND "
        f"TRY_CAST(regexp_extract({dng}, '^[0-9]+\\.([0-9]+)', 1) AS INTEGER) > 4)), false) AS dng_newer",
        "CASE WHEN subject_raw IS NULL THEN NULL WHEN starts_with(subject_raw, '[') "
        "THEN from_json(subject_raw, '[\"VARCHAR\"]') ELSE [subject_raw] END AS subjects",
    ]
    return ",\n ".join(cols)


add(
    "metadata_fields",
    ["media_meta"],
    f"""
SELECT path, meta_ok, meta_ext, meta_date_string, {tfmt('meta_date_ts')} AS meta_date, validate_errors,
 validate_warnings, dng_newer, content_id, CAST(to_json(subjects) AS VARCHAR) AS subjects
FROM (SELECT path, {meta_columns()} FROM media_meta) x
""",
)

_EXTS = "|".join(e[1:] for e in N.SUPPORTED_EXTENSIONS)
COMPOUND = "'^(.*?)((?:\\.(?i:" + _EXTS + "))+)$'"


def name_sql(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def compound_base_sql(path: str) -> str:
    nm = name_sql(path)
    return (
        f"CASE WHEN regexp_matches({nm}, {COMPOUND}) THEN (CASE WHEN contains({path}, '/') THEN "
        f"regexp_extract({path}, '^(.*)/', 1) || '/' || regexp_extract({nm}, {COMPOUND}, 1) "
        f"ELSE regexp_extract({nm}, {COMPOUND}, 1) END) ELSE {path} END"
    )


def compound_ext_sql(path: str) -> str:
    return f"regexp_extract({name_sql(path)}, {COMPOUND}, 2)"


add(
    "media_names",
    ["media_files"],
    f"""
SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir, {name_sql('path')} AS name, {ext('path')} AS ext,
 CASE WHEN contains({name_sql('path')}, '.') THEN regexp_extract({name_sql('path')}, '^(.*)\\.[^.]*$', 1)
      ELSE {name_sql('path')} END AS stem,
 lower({ext('path')}) IN {SUPPORTED} AS supported,
 CASE WHEN lower({ext('path')}) NOT IN {SUPPORTED} THEN NULL
      WHEN lower({ext('path')}) IN {_lst(N.RAW_EXTENSIONS)} THEN 'raw'
      WHEN lower({ext('path')}) IN {_lst(N.VIDEO_EXTENSIONS)} THEN 'video' ELSE 'image' END AS media_class,
 lower({ext('path')}) IN {_lst(N.LIVE_VIDEO_EXTENSIONS)} AS live_video,
 lower({ext('path')}) IN {_lst(N.LIVE_IMAGE_EXTENSIONS)} AS live_image,
 {compound_base_sql('path')} AS compound_base,
 {compound_ext_sql('path')} AS compound_ext,
 regexp_matches({ext('path')}, '\\p{{Ll}}') AND regexp_matches({ext('path')}, '\\p{{Lu}}') AS mixed_case_ext,
 CASE WHEN lower({ext('path')}) IN {_lst(N.REMUX_EXTENSIONS)} THEN 'remux'
      WHEN lower({ext('path')}) IN {_lst(N.REENCODE_EXTENSIONS)} THEN 'reencode'
      WHEN lower({ext('path')}) IN {_lst(N.REENCODE_AUDIO_EXTENSIONS)} AND starts_with(lower(coalesce(audio_codec,'')), 'pcm')
      THEN 'reencode_audio' END AS conversion
FROM media_files
""",
)


def mime_target_sql(path: str, meta_ext: str) -> str:
    return (
        f"CASE WHEN {meta_ext} IS NOT NULL AND {meta_ext} <> '' AND lower('.' || {meta_ext}) IN {SUPPORTED} "
        f"AND lower('.' || {meta_ext}) <> lower({compound_ext_sql(path)}) "
        f"THEN {compound_base_sql(path)} || '.' || lower({meta_ext}) END"
    )


add(
    "mime_targets",
    ["media_files", "media_meta"],
    f"""
SELECT f.path, m.meta_ext, {mime_target_sql('f.path', 'm.meta_ext')} AS target
FROM media_files f LEFT JOIN (SELECT path, {jget('meta_json', 'File:FileTypeExtension')} AS meta_ext FROM media_meta) m
ON f.path = m.path
""",
)

add(
    "backup_names",
    ["backup_listing"],
    """
SELECT path, regexp_matches(path, '\\.bak(\\d*)$') AS is_backup, regexp_matches(path, '\\.bak\\d+$') AS is_numbered,
 CASE WHEN regexp_matches(path, '\\.bak(\\d*)$') THEN regexp_replace(path, '\\.bak(\\d*)$', '') END AS base,
 CASE WHEN regexp_matches(path, '\\.bak(\\d*)$') THEN
   CASE WHEN regexp_extract(path, '\\.bak(\\d*)$', 1) = '' THEN CAST(0 AS BIGINT)
        ELSE TRY_CAST(regexp_extract(path, '\\.bak(\\d*)$', 1) AS BIGINT) END END AS backup_key
FROM backup_listing
""",
)


def checksum_sql(c: str) -> str:
    t = _ws_trim(c)
    return (
        f"CASE WHEN regexp_matches({t}, '^[A-Za-z0-9+/]*={{0,2}}$') AND length({t}) % 4 = 0 AND {t} <> '' "
        f"AND octet_length(try(from_base64({t}))) = 20 THEN lower(hex(from_base64({t}))) END"
    )


add(
    "feed_checksums",
    ["trash_pages"],
    f"SELECT id, checksum, {checksum_sql('checksum')} AS sha1_hex FROM trash_pages",
)


def path_tags_sql(path: str, root: str) -> str:
    d = f"regexp_extract({path}, '^(.*)/', 1)"
    rel = f"CASE WHEN starts_with({d}, '{root}/') THEN substr({d}, {len(root) + 2}) ELSE '' END"
    return f"list_filter(list_transform(string_split({rel}, '/'), lambda x: {_ws_trim('x')}), lambda x: x <> '')"


def import_tags_sql():
    from .catalog import EXPLICIT_TAGS
    from .fixtures import LIB_ROOT
    from .functions.tags import explicit_tags

    explicit = "[" + ",".join(q(t) for t in explicit_tags(EXPLICIT_TAGS)) + "]::VARCHAR[]"
    writable = f"lower('.' || coalesce(meta_ext, '')) IN {_lst(N.TAG_WRITABLE_EXTENSIONS)}"
    newt = f"CASE WHEN {writable} THEN list_concat({path_tags_sql('f.path', LIB_ROOT)}, {explicit}) ELSE []::VARCHAR[] END"
    return f"""
SELECT path, CAST(to_json(list_sort({path_tags_sql('path', LIB_ROOT)})) AS VARCHAR) AS path_tags,
 CAST(to_json(list_sort(list_concat(
   list_filter(coalesce(subjects, []::VARCHAR[]), lambda x: NOT list_contains(nt, x)),
   list_distinct(nt)))) AS VARCHAR) AS tags
FROM (SELECT f.path, m.subjects, m.meta_ext, {newt} AS nt
      FROM media_files f LEFT JOIN (SELECT path, {meta_columns()} FROM media_meta) m ON f.path = m.path) x
"""


add("import_tags", ["media_files", "media_meta"], import_tags_sql())


# ------------------------------------------------------------ import
def unique_names_sql(req: str, existing: str, prefix: str = "") -> str:
    """CTE text (leading comma) computing un(path, dest, final_dest) by brute
    force: enumerate candidate suffixes per name and take the j-th free."""
    nm = "regexp_extract(dest, '([^/]*)$', 1)"
    return _unique_names_body(req, existing, nm).replace("_u", prefix + "_u").replace("\nun AS", "\n" + prefix + "un AS")


def _unique_names_body(req: str, existing: str, nm: str) -> str:
    return f"""
, _ureq AS (SELECT path, dest, row_number() OVER (PARTITION BY dest ORDER BY path) AS rnk FROM {req}),
_uex AS (SELECT DISTINCT path FROM {existing}),
_utaken AS (SELECT path AS name FROM _uex UNION SELECT dest FROM {req}),
_ugrp AS (
  SELECT dest, count(*) AS n, bool_or(dest IN (SELECT path FROM _uex)) AS ex,
   regexp_extract(dest, '^(.*)/', 1) AS d, contains(dest, '/') AS hd,
   regexp_extract(any_value({nm}), '(\\.[^.]+)$', 1) AS e,
   CASE WHEN contains(any_value({nm}), '.') THEN regexp_extract(any_value({nm}), '^(.*)\\.[^.]*$', 1) ELSE any_value({nm}) END AS st
  FROM _ureq GROUP BY dest),
_ucand AS (
  SELECT g.dest, t.k,
   CASE WHEN g.hd THEN g.d || '/' ELSE '' END || g.st || '_' || CAST(t.k AS VARCHAR) || g.e AS cname
  FROM _ugrp g, range(1, (SELECT count(*) FROM _utaken) + 2 + (SELECT max(n) FROM _ugrp)) t(k)
  WHERE t.k <= g.n + (SELECT count(*) FROM _utaken) + 1),
_ufree AS (
  SELECT dest, cname, row_number() OVER (PARTITION BY dest ORDER BY k) AS fidx
  FROM _ucand WHERE cname NOT IN (SELECT name FROM _utaken)),
un AS (
  SELECT r.path, r.dest,
   CASE WHEN NOT g.ex AND r.rnk = 1 THEN r.dest ELSE fr.cname END AS final_dest
  FROM _ureq r JOIN _ugrp g ON r.dest = g.dest
  LEFT JOIN _ufree fr ON fr.dest = r.dest AND fr.fidx = (CASE WHEN g.ex THEN r.rnk ELSE r.rnk - 1 END))
"""


add(
    "unique_destinations",
    ["media_files", "existing_dest"],
    ", reqs AS (SELECT path, '2019/03/04/' || regexp_extract(path, '([^/]*)$', 1) AS dest FROM media_files)"
    + unique_names_sql("reqs", "existing_dest")
    + "SELECT path, dest, final_dest FROM un",
)

add(
    "first_copy",
    ["media_files"],
    "SELECT path, sha256, path = min(path) OVER (PARTITION BY sha256) AS is_first FROM media_files",
)
add(
    "trash_membership",
    ["media_files", "trash"],
    "SELECT path, sha1 IN (SELECT sha1 FROM trash) AS in_trash FROM media_files",
)
add(
    "skip_membership",
    ["media_files", "skip_ledger"],
    "SELECT path, sha256 IN (SELECT sha256 FROM skip_ledger) AS in_skip FROM media_files",
)
add(
    "import_ledger_membership",
    ["media_files", "import_ledger"],
    "SELECT path, sha256 IN (SELECT sha256 FROM import_ledger) AS in_ledger FROM media_files",
)


def _import_ctes() -> str:
    from .catalog import EXPLICIT_TAGS
    from .fixtures import LIB_ROOT
    from .functions.tags import explicit_tags

    explicit = "[" + ",".join(q(t) for t in explicit_tags(EXPLICIT_TAGS)) + "]::VARCHAR[]"
    writable = f"lower('.' || coalesce(meta_ext, '')) IN {_lst(N.TAG_WRITABLE_EXTENSIONS)}"
    return f"""
, f AS (
  SELECT mf.path, mf.file_size, mf.mtime_ticks,
   CASE WHEN il.path IS NOT NULL AND il.file_size = mf.file_size AND il.mtime_ticks = mf.mtime_ticks THEN il.sha256 ELSE mf.sha256 END AS sha256,
   CASE WHEN il.path IS NOT NULL AND il.file_size = mf.file_size AND il.mtime_ticks = mf.mtime_ticks THEN il.sha1 ELSE mf.sha1 END AS sha1
  FROM media_files mf LEFT JOIN import_ledger il ON il.path = mf.path
  WHERE {supported('mf.path')}),
m AS (SELECT path, {meta_columns()} FROM media_meta),
s AS (
  SELECT f.*, m.meta_ext, m.meta_date_string, m.meta_date_ts,
   CASE WHEN f.sha1 IN (SELECT sha1 FROM trash) THEN 'TrashedUpstream'
        WHEN f.sha256 IN (SELECT sha256 FROM skip_ledger) THEN 'SkippedBySkipDb'
        WHEN f.sha256 IN (SELECT sha256 FROM import_ledger) THEN 'Skipped'
        WHEN NOT coalesce(m.meta_ok, false) THEN 'Failed'
        WHEN m.validate_errors > 0 THEN 'Invalid' ELSE 'Imported' END AS o1,
   CASE WHEN f.sha1 IN (SELECT sha1 FROM trash) THEN 'trash'
        WHEN f.sha256 IN (SELECT sha256 FROM skip_ledger) THEN 'skip_ledger'
        WHEN f.sha256 IN (SELECT sha256 FROM import_ledger) THEN 'import_ledger'
        WHEN NOT coalesce(m.meta_ok, false) THEN 'no_metadata'
        WHEN m.validate_errors > 0 THEN 'validation_errors:' || CAST(m.validate_errors AS VARCHAR) END AS r1
  FROM f LEFT JOIN m ON f.path = m.path),
s2 AS (
  SELECT *, CASE WHEN o1 = 'Imported' AND path <> min(path) OVER (PARTITION BY sha256, o1) THEN 'Skipped' ELSE o1 END AS outcome,
   CASE WHEN o1 = 'Imported' AND path <> min(path) OVER (PARTITION BY sha256, o1) THEN 'duplicate' ELSE r1 END AS reason
  FROM s),
imp AS (
  SELECT path, sha256, sha1, file_size, mtime_ticks, meta_ext,
   coalesce(CASE WHEN meta_date_string IS NULL THEN created_ts END, meta_date_ts, TIMESTAMP '0001-01-01 00:00:00') AS dt
  FROM (SELECT *, {date_columns('path')} FROM s2 WHERE outcome = 'Imported') x),
imp2 AS (
  SELECT *, strftime(dt, '%Y/%m/%d') || '/' || regexp_extract(path, '([^/]*)$', 1) AS dest,
   CASE WHEN {writable} THEN list_concat({path_tags_sql('path', LIB_ROOT)}, {explicit}) ELSE []::VARCHAR[] END AS applied
  FROM imp)
{unique_names_sql('imp2', 'existing_dest')}
, plan AS (
  SELECT i.path, 'Imported' AS outcome, NULL AS reason, u.final_dest AS dest, {tfmt('i.dt')} AS created,
   CAST(to_json(list_sort(i.applied)) AS VARCHAR) AS tags
  FROM imp2 i JOIN un u ON u.path = i.path
  UNION ALL
  SELECT path, outcome, reason, NULL, NULL, NULL FROM s2 WHERE outcome <> 'Imported'
  UNION ALL
  SELECT path, 'Ignored', 'extension', NULL, NULL, NULL FROM media_files WHERE NOT ({supported('path')}))
"""


_IMPORT_VIEWS = ["media_files", "media_meta", "import_ledger", "skip_ledger", "trash", "existing_dest"]
add("import_plan", _IMPORT_VIEWS, _import_ctes() + "SELECT * FROM plan")
add(
    "import_summary",
    _IMPORT_VIEWS,
    _import_ctes()
    + """
SELECT count(*) AS total, CAST(count_if(outcome = 'Imported') AS BIGINT) AS n_imported, CAST(count_if(outcome = 'Ignored') AS BIGINT) AS n_ignored,
 CAST(count_if(outcome = 'Skipped') AS BIGINT) AS n_skipped, CAST(count_if(outcome = 'SkippedBySkipDb') AS BIGINT) AS n_skipped_by_skip_db,
 CAST(count_if(outcome = 'TrashedUpstream') AS BIGINT) AS n_trashed_upstream, CAST(count_if(outcome = 'Invalid') AS BIGINT) AS n_invalid,
 CAST(count_if(outcome = 'Failed') AS BIGINT) AS n_failed,
 CASE WHEN CAST(count_if(outcome = 'Invalid') AS BIGINT) > 0 OR CAST(count_if(outcome = 'Failed') AS BIGINT) > 0 THEN 2 ELSE 0 END AS run_status
FROM plan
""",
)
add(
    "import_ledger_next",
    _IMPORT_VIEWS,
    _import_ctes()
    + """
SELECT path, sha256, sha1, file_size, mtime_ticks, false AS is_processed FROM imp
UNION ALL
SELECT path, sha256, sha1, file_size, mtime_ticks, is_processed FROM import_ledger WHERE path NOT IN (SELECT path FROM imp)
""",
)


# ------------------------------------------------------------ trash feed
add(
    "feed_items",
    ["trash_pages"],
    "SELECT page, next_page, id, checksum, original_file_name, is_trashed FROM trash_pages",
)

_TRASH_CTES = f"""
, pt AS (
  SELECT page, CASE WHEN bool_or(id IS NOT NULL OR checksum IS NOT NULL OR original_file_name IS NOT NULL) THEN min(next_page) END AS next_page
  FROM trash_pages GROUP BY page),
pt2 AS (
  SELECT page, next_page,
   CASE WHEN TRY_CAST(next_page AS INTEGER) > page THEN CAST(TRY_CAST(next_page AS INTEGER) AS BIGINT) END AS nxt
  FROM pt),
chain AS (
  WITH RECURSIVE c(page) AS (
    SELECT page FROM pt2 WHERE page = 1
    UNION ALL
    SELECT p2.page FROM c JOIN pt2 p1 ON p1.page = c.page JOIN pt2 p2 ON p2.page = p1.nxt)
  SELECT DISTINCT page FROM c),
items AS (SELECT t.*, {checksum_sql('t.checksum')} AS hex FROM trash_pages t WHERE t.page IN (SELECT page FROM chain)),
firsts AS (
  SELECT hex AS sha1, arg_min(original_file_name, (page, id)) AS original_file_name
  FROM items WHERE coalesce(is_trashed, false) AND hex IS NOT NULL GROUP BY hex),
added AS (SELECT * FROM firsts WHERE sha1 NOT IN (SELECT sha1 FROM trash)),
after AS (SELECT sha1, original_file_name FROM trash UNION ALL SELECT sha1, original_file_name FROM added)
"""

add("trash_pages_visited", ["trash_pages"], _TRASH_CTES + "SELECT page FROM chain")
add("trash_sync_set", ["trash_pages", "trash"], _TRASH_CTES + "SELECT * FROM after")
add(
    "trash_sync_totals",
    ["trash_pages", "trash"],
    _TRASH_CTES
    + """
, lastp AS (SELECT max(page) AS last_page FROM chain),
st AS (SELECT l.last_page, CASE WHEN p.page IS NULL THEN NULL WHEN p.next_page IS NULL THEN 'end'
        WHEN p.nxt IS NULL THEN 'bad' END AS stop FROM lastp l LEFT JOIN pt2 p ON p.page = l.last_page)
SELECT (SELECT count(*) FROM items) AS fetched, (SELECT count(*) FROM added) AS inserted,
 (SELECT count(*) FROM after) AS total, coalesce(stop = 'bad', false) AS partial, last_page,
 CASE WHEN stop = 'bad' THEN 2 ELSE 0 END AS run_status
FROM st
""",
)


# ------------------------------------------------------------ process groups
def _stem_sql(nm: str) -> str:
    return f"CASE WHEN contains({nm}, '.') THEN regexp_extract({nm}, '^(.*)\\.[^.]*$', 1) ELSE {nm} END"


add(
    "case_conflicts",
    ["media_files"],
    """
, lp AS (SELECT path, lower(path) AS lpath FROM media_files),
mem AS (SELECT path, lpath AS dest FROM lp WHERE lpath IN (SELECT lpath FROM lp GROUP BY lpath HAVING count(*) > 1)),
exl AS (SELECT lpath AS path FROM lp)
"""
    + unique_names_sql("mem", "exl")
    + f"""
SELECT path,
 regexp_extract(path, '^(.*)/', 1) || '/' || {_stem_sql(name_sql('path'))} || '_' ||
 regexp_extract({_stem_sql(name_sql('final_dest'))}, '_([1-9][0-9]*)$', 1) ||
 regexp_extract({name_sql('path')}, '(\\.[^.]+)$', 1) AS new_path
FROM un
""",
)

add(
    "stem_waves",
    ["media_files"],
    f"""
SELECT path, CAST(row_number() OVER (PARTITION BY lower(regexp_extract(path, '^(.*)/', 1) || '/' || {_stem_sql(name_sql('path'))})
                                    ORDER BY path) - 1 AS BIGINT) AS wave
FROM media_files WHERE {supported('path')}
UNION ALL SELECT path, CAST(0 AS BIGINT) FROM media_files WHERE NOT ({supported('path')})
""",
)


def _companion_sql() -> str:
    exts = [e for e0 in N.LIVE_IMAGE_EXTENSIONS for e in (e0, e0.upper())]
    n = len(exts)
    direct = ",".join(f"{{'prio': {i}, 'e': '{e}', 'h': false}}" for i, e in enumerate(exts))
    hevc = ",".join(f"{{'prio': {n + i}, 'e': '{e}', 'h': true}}" for i, e in enumerate(exts))
    st = _stem_sql(name_sql("v.path"))
    return f"""
, v AS (SELECT path FROM media_files WHERE lower({ext('path')}) IN {_lst(N.LIVE_VIDEO_EXTENSIONS)}),
c AS (
  SELECT v.path, x.prio,
   regexp_extract(v.path, '^(.*)/', 1) || '/' ||
   CASE WHEN x.h THEN (CASE WHEN regexp_matches({st}, '(?i)_hevc$') THEN regexp_replace({st}, '(?i)_hevc$', '') END)
        ELSE {st} END || x.e AS companion
  FROM v, (SELECT unnest([{direct},{hevc}], recursive := true)) x),
hits AS (SELECT * FROM c WHERE companion IN (SELECT path FROM media_files))
"""


add(
    "live_photo_pairs",
    ["media_files"],
    _companion_sql() + "SELECT path, arg_min(companion, prio) AS companion FROM hits GROUP BY path",
)

add(
    "next_backup_names",
    ["backup_listing"],
    """
, orig AS (SELECT path FROM backup_listing WHERE NOT regexp_matches(path, '\\.bak(\\d*)$') AND NOT ends_with(path, '.bak.out')),
cand AS (SELECT o.path, t.k, o.path || '.bak' || CASE WHEN t.k = 0 THEN '' ELSE CAST(t.k AS VARCHAR) END AS name
         FROM orig o, range(0, (SELECT count(*) FROM backup_listing) + 2) t(k)),
free AS (SELECT * FROM cand WHERE name NOT IN (SELECT path FROM backup_listing))
SELECT path, arg_min(name, k) AS backup_path FROM free GROUP BY path
""",
)


# ------------------------------------------------------------ undo
_UNDO_CTES = f"""
, bk AS (
  SELECT path, file_size, regexp_replace(path, '\\.bak\\d*$', '') AS base,
   CASE WHEN regexp_matches(path, '\\.bak\\d+$') THEN CAST(regexp_extract(path, '\\.bak(\\d+)$', 1) AS BIGINT) ELSE 0 END AS k
  FROM backup_listing WHERE regexp_matches(path, '\\.bak\\d*$')),
grp AS (
  SELECT lower(base) AS gkey, min(base) AS base, count(*) AS n_backups,
   arg_min(path, (k, path)) FILTER (WHERE file_size > 0) AS "primary"
  FROM bk GROUP BY lower(base)),
g2 AS (
  SELECT *, lower(regexp_extract(base, '^(.*)/', 1)) AS d, lower({_stem_sql(name_sql('base'))}) AS st,
   lower(regexp_extract({name_sql('base')}, '(\\.[^./]+)$', 1)) AS e
  FROM grp),
g3 AS (
  SELECT g2.*, (SELECT count(DISTINCT x.e) FROM g2 x WHERE x.d = g2.d AND x.st = g2.st) > 1 AS has_stem_peer,
   base IN (SELECT path FROM backup_listing) AS base_exists
  FROM g2),
g AS (SELECT *, has_stem_peer AND base_exists AS derived FROM g3),
plan AS (
  SELECT base, 'delete' AS action, base AS path, CAST(NULL AS VARCHAR) AS target, true AS counted FROM g WHERE derived
  UNION ALL SELECT g.base, 'delete', bk.path, NULL, true FROM g JOIN bk ON lower(bk.base) = g.gkey WHERE g.derived
  UNION ALL SELECT base, 'fail', NULL, NULL, true FROM g WHERE NOT derived AND "primary" IS NULL
  UNION ALL SELECT base, 'delete_current', base, NULL, false FROM g WHERE NOT derived AND "primary" IS NOT NULL AND base_exists
  UNION ALL SELECT base, 'restore', "primary", base, true FROM g WHERE NOT derived AND "primary" IS NOT NULL
  UNION ALL SELECT g.base, 'delete', bk.path, NULL, true FROM g JOIN bk ON lower(bk.base) = g.gkey
    WHERE NOT g.derived AND g."primary" IS NOT NULL AND bk.path <> g."primary"
  UNION ALL SELECT base, 'delete', "primary" || '.out', NULL, true FROM g
    WHERE NOT derived AND "primary" IS NOT NULL AND "primary" || '.out' IN (SELECT path FROM backup_listing)
  UNION ALL SELECT g.base, 'delete', regexp_replace(t.output_path, '^\\s+|\\s+$', '', 'g'), NULL, true FROM g JOIN trackers t ON t.backup_path = g."primary"
    WHERE NOT g.derived AND g."primary" || '.out' IN (SELECT path FROM backup_listing)
     AND regexp_replace(t.output_path, '^\\s+|\\s+$', '', 'g') IN (SELECT path FROM backup_listing)
     AND lower(regexp_replace(t.output_path, '^\\s+|\\s+$', '', 'g')) NOT IN (SELECT gkey FROM g)
  UNION ALL SELECT base, 'delete', o, NULL, true FROM (
    SELECT base, regexp_extract(base, '^(.*)/', 1) || '/' || {_stem_sql(name_sql('base'))} || '.mp4' AS o FROM g
    WHERE NOT derived AND "primary" IS NOT NULL AND "primary" || '.out' NOT IN (SELECT path FROM backup_listing)
     AND e <> '.mp4') z
    WHERE o IN (SELECT path FROM backup_listing) AND lower(o) NOT IN (SELECT gkey FROM g))
"""
add("undo_plan", ["backup_listing", "trackers"], _UNDO_CTES + "SELECT * FROM plan")
ORACLE["undo_plan_from_disk"] = ORACLE["undo_plan"]
add(
    "undo_summary",
    ["backup_listing", "trackers"],
    _UNDO_CTES
    + """
SELECT CAST(count_if(action = 'restore' AND counted) AS BIGINT) AS restored, CAST(count_if(action = 'delete' AND counted) AS BIGINT) AS deleted,
 CAST(count_if(action = 'fail') AS BIGINT) AS failed, CASE WHEN CAST(count_if(action = 'fail') AS BIGINT) > 0 THEN 2 ELSE 0 END AS run_status
FROM plan
""",
)
add(
    "undo_groups",
    ["backup_listing"],
    _UNDO_CTES + 'SELECT base, "primary", n_backups, has_stem_peer, base_exists, derived FROM g',
)
add(
    "backup_groups",
    ["backup_listing"],
    _UNDO_CTES
    + """
SELECT bk.base, bk.path, bk.k AS backup_key, bk.file_size,
 row_number() OVER (PARTITION BY lower(bk.base) ORDER BY bk.k, bk.path) AS position,
 count(*) OVER (PARTITION BY lower(bk.base)) AS n_backups,
 bool_or(bk.file_size > 0) OVER (PARTITION BY lower(bk.base)) AS has_nonempty
FROM bk
""",
)


# ------------------------------------------------------------ verify
_VERDICT_CTE = """
, vl AS (
  SELECT line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM verdict_lines),
vj AS (SELECT line_no, t FROM vl WHERE starts_with(t, '{') AND json_valid(t)),
vp AS (
  SELECT line_no, json_extract_string(t, '$.path') AS path,
   coalesce(TRY_CAST(json_extract(t, '$.ok') AS BOOLEAN), false) AS ok,
   json_extract_string(t, '$.via') AS via, json_extract_string(t, '$.error') AS error
  FROM vj),
verd AS (
  SELECT path, arg_max(ok, line_no) AS ok, arg_max(via, line_no) AS via, arg_max(error, line_no) AS error
  FROM vp WHERE path IS NOT NULL GROUP BY path)
"""


def _container_sql(p: str) -> str:
    rel = f"substr({p}, {len('/lib') + 2})"
    return (
        f"CASE WHEN starts_with({p}, '/lib/') AND {rel} <> '' AND NOT regexp_matches({rel}, '(^|/)\\.\\.(/|$)') "
        f"AND NOT regexp_matches({p}, '[\\r\\n]') THEN '/media/' || {rel} END"
    )


add("verdicts", ["verdict_lines"], _VERDICT_CTE + "SELECT path, ok, via, error FROM verd")
add("container_paths", ["media_files"], f"SELECT path, {_container_sql('path')} AS container_path FROM media_files")

_VERIFY_CTES = (
    _index_ctes()
    + _VERDICT_CTE
    + f"""
, cand AS (SELECT * FROM o WHERE NOT (status = 'Unchanged' AND coalesce(was_processed, false))),
mapped AS (SELECT path, {_container_sql('path')} AS cpath FROM cand),
outc AS (
  SELECT m.path, CASE WHEN m.cpath IS NULL THEN 'Failed' WHEN v.path IS NULL THEN 'Failed'
                      WHEN NOT v.ok THEN 'Invalid' ELSE 'Verified' END AS outcome,
   CASE WHEN m.cpath IS NOT NULL AND NOT v.ok THEN v.error END AS error
  FROM mapped m LEFT JOIN verd v ON v.path = m.cpath
  UNION ALL SELECT path, 'Skipped', NULL FROM o WHERE status = 'Unchanged' AND coalesce(was_processed, false)
  UNION ALL SELECT path, 'Ignored', NULL FROM f WHERE NOT ({supported('path')}))
"""
)
add("verify_outcomes", ["media_files", "ledger", "verdict_lines"], _VERIFY_CTES + "SELECT * FROM outc")
add(
    "verify_summary",
    ["media_files", "ledger", "verdict_lines"],
    _VERIFY_CTES
    + """
SELECT count(*) AS total, CAST(count_if(outcome = 'Verified') AS BIGINT) AS n_verified, CAST(count_if(outcome = 'Skipped') AS BIGINT) AS n_skipped,
 CAST(count_if(outcome = 'Invalid') AS BIGINT) AS n_invalid, CAST(count_if(outcome = 'Ignored') AS BIGINT) AS n_ignored,
 CAST(count_if(outcome = 'Failed') AS BIGINT) AS n_failed,
 CASE WHEN CAST(count_if(outcome = 'Invalid') AS BIGINT) > 0 OR CAST(count_if(outcome = 'Failed') AS BIGINT) > 0 THEN 2 ELSE 0 END AS run_status
FROM outc
""",
)
add(
    "verify_ledger",
    ["media_files", "ledger", "verdict_lines"],
    _VERIFY_CTES
    + """
, nl AS (
  SELECT path, sha256, sha1, file_size, mtime_ticks, was_processed AS is_processed FROM o
  UNION ALL SELECT path, sha256, sha1, file_size, mtime_ticks, is_processed FROM ledger WHERE path NOT IN (SELECT path FROM o))
SELECT path, sha256, sha1, file_size, mtime_ticks,
 is_processed OR path IN (SELECT path FROM outc WHERE outcome = 'Verified') AS is_processed
FROM nl
""",
)


# ------------------------------------------------------------ directories
add(
    "empty_directories",
    ["media_dirs", "media_files"],
    """
, fd AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS d FROM media_files),
dd AS (SELECT DISTINCT dir FROM media_dirs WHERE starts_with(dir, '/lib/'))
SELECT dir, CAST(length(dir) - length(replace(dir, '/', '')) AS INTEGER) AS depth FROM dd
WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.d = dd.dir OR starts_with(fd.d, dd.dir || '/'))
ORDER BY depth DESC, dir
""",
)


# ------------------------------------------------------------ sources, sinks, streaming
add(
    "listed_files",
    ["media_files", "trackers"],
    "SELECT path, CAST(strlen(mn.text) AS BIGINT) AS file_size FROM media_files mf JOIN media_names mn ON mn.doc_id = mf.doc_id "
    "UNION ALL SELECT backup_path || '.out', CAST(strlen(output_path) + 1 AS BIGINT) FROM trackers",
)
add(
    "hashed_files",
    ["media_files", "trackers"],
    "SELECT path, sha256, sha1 FROM media_files "
    "UNION ALL SELECT backup_path || '.out', sha256(output_path || chr(10)), sha1(output_path || chr(10)) FROM trackers",
)
ORACLE["index_outcomes_hashed"] = ORACLE["index_outcomes"]
ORACLE["index_ledger_hashed"] = ORACLE["index_ledger"]
ORACLE["import_plan_hashed"] = ORACLE["import_plan"]
ORACLE["verify_ledger_hashed"] = ORACLE["verify_ledger"]
ORACLE["stream_index_two_runs"] = ORACLE["index_ledger"]
ORACLE["stream_index_keyed"] = ORACLE["stream_index_merged_in_part"] = ORACLE["index_ledger"]
ORACLE["stream_index_keyed_outcomes"] = ORACLE["index_outcomes"]
ORACLE["listed_files_source"] = ORACLE["listed_files"]
add(
    "listed_files_pushed",
    ["media_files"],
    "SELECT path, CAST(strlen(mn.text) AS BIGINT) AS file_size FROM media_files mf JOIN media_names mn ON mn.doc_id = mf.doc_id "
    "WHERE starts_with(path, '/lib/src1/') AND ends_with(path, '.mov')",
)
# a rejected file of these groups is gone when the decoder is done
_GONE_CTES = _VERIFY_CTES + """
, outg AS (
  SELECT o.path, CASE WHEN o.outcome = 'Invalid' AND m.g % 3 = 1 THEN 'Failed' ELSE o.outcome END AS outcome,
   CASE WHEN o.outcome = 'Invalid' AND m.g % 3 = 1 THEN NULL ELSE o.error END AS error
  FROM outc o JOIN media_files m ON m.path = o.path)
"""
add("verify_outcomes_gone", ["media_files", "ledger", "verdict_lines"], _GONE_CTES + "SELECT * FROM outg")
add(
    "verify_summary_gone",
    ["media_files", "ledger", "verdict_lines"],
    _GONE_CTES
    + """
SELECT count(*) AS total, CAST(count_if(outcome = 'Verified') AS BIGINT) AS n_verified, CAST(count_if(outcome = 'Skipped') AS BIGINT) AS n_skipped,
 CAST(count_if(outcome = 'Invalid') AS BIGINT) AS n_invalid, CAST(count_if(outcome = 'Ignored') AS BIGINT) AS n_ignored,
 CAST(count_if(outcome = 'Failed') AS BIGINT) AS n_failed,
 CASE WHEN count_if(outcome IN ('Invalid', 'Failed')) > 0 THEN 2 ELSE 0 END AS run_status
FROM outg
""",
)
ORACLE["index_summary_observed"] = ORACLE["index_summary"]
ORACLE["import_summary_observed"] = ORACLE["import_summary"]
ORACLE["verify_summary_observed"] = ORACLE["verify_summary"]
add(
    "resolved_hashes",
    ["media_files", "ledger"],
    """
SELECT f.path, CASE WHEN f.file_size = l.file_size AND f.mtime_ticks = l.mtime_ticks THEN l.sha256 ELSE f.sha256 END AS sha256,
 CASE WHEN f.file_size = l.file_size AND f.mtime_ticks = l.mtime_ticks THEN l.sha1 ELSE f.sha1 END AS sha1
FROM media_files f LEFT JOIN ledger l ON l.path = f.path
""",
)
add(
    "verify_pending",
    ["media_files", "ledger"],
    _index_ctes()
    + f"SELECT path, status FROM o WHERE NOT (status = 'Unchanged' AND coalesce(was_processed, false)) "
    f"UNION ALL SELECT path, 'Ignored' FROM media_files WHERE NOT ({supported('path')})",
)
add(
    "destinations",
    ["media_files"],
    f"""
SELECT path, strftime(created_ts, '%Y/%m/%d') || '/' || regexp_extract(path, '([^/]*)$', 1) AS dest
FROM (SELECT path, {date_columns('path')} FROM media_files) x WHERE created_ts IS NOT NULL
""",
)
_BROKEN = "regexp_replace(path, '([aeiou])', E'\\\\1\\n', 'g')"
add(
    "names_with_line_breaks",
    ["media_files"],
    f"""
SELECT path, CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[:-2], '/') ELSE '' END AS dir,
 string_split(path, '/')[-1] AS name, e AS ext, lower(e) AS ext_lower,
 CASE WHEN contains(string_split(path, '/')[-1], '.') THEN array_to_string(string_split(string_split(path, '/')[-1], '.')[:-2], '.')
      ELSE string_split(path, '/')[-1] END AS stem
FROM (SELECT *, CASE WHEN contains(n, '.') AND string_split(n, '.')[-1] <> '' THEN '.' || string_split(n, '.')[-1] ELSE '' END AS e
      FROM (SELECT path, string_split(path, '/')[-1] AS n FROM (SELECT {_BROKEN} AS path FROM media_files) a) b) c
""",
)
add(
    "metadata_malformed",
    ["media_meta"],
    f"""
SELECT path, meta_ok, CASE WHEN meta_ok THEN meta_ext END AS meta_ext FROM (
 SELECT path, {meta_columns("CASE WHEN json_valid(d) THEN d ELSE 'null' END")} FROM (
  SELECT path, CASE length(path) % 4 WHEN 0 THEN substr(meta_json, 1, length(meta_json) - 3) WHEN 1 THEN 'garbage ' || meta_json
   WHEN 2 THEN meta_json ELSE meta_json END AS d FROM media_meta) a) b
""",
)
add(
    "trash_pages_to_empty",
    ["trash_pages"],
    """
, tpe AS (SELECT page, next_page, CASE WHEN page <> 2 THEN id END AS id, CASE WHEN page <> 2 THEN checksum END AS checksum,
 CASE WHEN page <> 2 THEN original_file_name END AS original_file_name, CASE WHEN page <> 2 THEN is_trashed END AS is_trashed FROM trash_pages)
"""
    + _TRASH_CTES.replace("trash_pages", "tpe")
    + "SELECT page FROM chain",
)
add("trackers_from_disk", ["trackers"], "SELECT backup_path, output_path FROM trackers")
ORACLE["ledger_roundtrip"] = ORACLE["index_ledger"]
ORACLE["trash_set_roundtrip"] = ORACLE["trash_sync_streamed"] = ORACLE["trash_sync_set"]
ORACLE["stream_index_ledger"] = ORACLE["index_ledger"]
add(
    "archive_roundtrip",
    _IMPORT_VIEWS,
    _import_ctes()
    + "SELECT p.path, p.dest, p.created, p.tags, i.file_size, i.mtime_ticks, i.sha256, regexp_extract(p.dest, '^(.*)/', 1) AS date_dir "
    "FROM plan p JOIN imp i ON i.path = p.path WHERE p.outcome = 'Imported'",
)
add(
    "archive_contents",
    [*_IMPORT_VIEWS, "media_names"],
    _import_ctes()
    + "SELECT p.path, p.dest, CAST(strlen(n.text) AS BIGINT) AS copied_bytes, mf.sha256 AS landed_sha256 FROM plan p "
    "JOIN media_files mf ON mf.path = p.path JOIN media_names n ON n.doc_id = mf.doc_id WHERE p.outcome = 'Imported'",
)
add("plan_roundtrip", ["backup_listing", "trackers"], _UNDO_CTES + "SELECT row_number() OVER (ORDER BY base, action, path NULLS FIRST) AS seq, base, action, path, target, counted FROM plan")


# ------------------------------------------------------------ ledger merges, report
add(
    "skipped_extensions",
    ["media_files"],
    f"""
SELECT lower({ext('path')}) AS extension, count(*) AS files,
 CASE WHEN lower({ext('path')}) = '' THEN '(no extension)' ELSE lower({ext('path')}) END AS label
FROM media_files WHERE NOT ({supported('path')}) GROUP BY lower({ext('path')})
""",
)
add(
    "ledger_insert_or_ignore",
    ["media_files", "ledger"],
    """
SELECT * FROM ledger UNION ALL
SELECT path, sha256, sha1, file_size, mtime_ticks, false FROM media_files WHERE path NOT IN (SELECT path FROM ledger)
""",
)
add(
    "ledger_update_hashes",
    ["media_files", "ledger"],
    """
SELECT l.path, coalesce(f.sha256, l.sha256) AS sha256, coalesce(f.sha1, l.sha1) AS sha1,
 coalesce(f.file_size, l.file_size) AS file_size, coalesce(f.mtime_ticks, l.mtime_ticks) AS mtime_ticks,
 CASE WHEN f.path IS NULL THEN l.is_processed ELSE false END AS is_processed
FROM ledger l LEFT JOIN media_files f ON f.path = l.path
""",
)
add(
    "ledger_update_metadata",
    ["media_files", "ledger"],
    """
SELECT l.path, l.sha256, coalesce(f.sha1, l.sha1) AS sha1,
 coalesce(f.file_size, l.file_size) AS file_size, coalesce(f.mtime_ticks, l.mtime_ticks) AS mtime_ticks, l.is_processed
FROM ledger l LEFT JOIN media_files f ON f.path = l.path
""",
)
add(
    "ledger_set_processed",
    ["ledger", "verdict_lines"],
    _VERDICT_CTE
    + """
SELECT path, sha256, sha1, file_size, mtime_ticks,
 is_processed OR path IN (SELECT '/lib' || substr(path, 7) FROM verd WHERE ok) AS is_processed
FROM ledger
""",
)
add(
    "ledger_delete_trashed",
    ["ledger", "trash"],
    "SELECT * FROM ledger WHERE sha1 NOT IN (SELECT sha1 FROM trash)",
)


for _whole, _part in (
    ("insert_or_ignore", "insert"), ("update_hashes", "hashes"), ("update_metadata", "metadata"), ("set_processed", "processed"), ("delete_trashed", "delete")
):
    ORACLE[f"ledger_{_part}_in_part"] = ORACLE[f"ledger_{_whole}"]


# ------------------------------------------------------------ process
def _process_head() -> str:
    """The listing after the case renames, the index run, and what round 1 decides on."""
    return (
        """
, lp AS (SELECT path, lower(path) AS lpath FROM media_files),
mem AS (SELECT path, lpath AS dest FROM lp WHERE lpath IN (SELECT lpath FROM lp GROUP BY lpath HAVING count(*) > 1)),
exl AS (SELECT lpath AS path FROM lp)
"""
        + unique_names_sql("mem", "exl", "cc")
        + f"""
, ren AS (
  SELECT path, regexp_extract(path, '^(.*)/', 1) || '/' || {_stem_sql(name_sql('path'))} || '_' ||
   regexp_extract({_stem_sql(name_sql('final_dest'))}, '_([1-9][0-9]*)$', 1) ||
   regexp_extract({name_sql('path')}, '(\\.[^.]+)$', 1) AS new_path
  FROM ccun),
lst AS (
  SELECT coalesce(r.new_path, f.path) AS path, f.path AS origin, f.file_size, f.mtime_ticks, f.sha256 AS fsha256,
   f.sha1 AS fsha1, f.duration_s, f.audio_codec
  FROM media_files f LEFT JOIN ren r ON r.path = f.path),
idx AS (
  SELECT x.path, CASE WHEN l.path IS NOT NULL AND x.file_size = l.file_size AND x.mtime_ticks = l.mtime_ticks
                      THEN l.sha1 ELSE x.fsha1 END AS sha1,
   CASE WHEN l.path IS NULL THEN 'Inserted'
        WHEN (CASE WHEN x.file_size = l.file_size AND x.mtime_ticks = l.mtime_ticks THEN l.sha256 ELSE x.fsha256 END) <> l.sha256 THEN 'Updated'
        WHEN x.file_size <> l.file_size OR x.mtime_ticks <> l.mtime_ticks THEN CASE WHEN l.is_processed THEN 'Unchanged' ELSE 'Updated' END
        ELSE 'Unchanged' END AS status,
   CASE WHEN l.path IS NULL THEN false
        WHEN (CASE WHEN x.file_size = l.file_size AND x.mtime_ticks = l.mtime_ticks THEN l.sha256 ELSE x.fsha256 END) <> l.sha256 THEN false
        ELSE l.is_processed END AS was_processed
  FROM lst x LEFT JOIN ledger l ON l.path = x.path WHERE {supported('x.path')}),
mt AS (SELECT path AS mpath, {meta_columns()} FROM media_meta),
s AS (
  SELECT x.path, x.origin, x.duration_s, x.audio_codec, i.status, i.was_processed,
   i.sha1 IN (SELECT sha1 FROM trash) AS in_trash,
   m.meta_ok, m.validate_errors, m.meta_ext, m.content_id, m.dng_newer
  FROM lst x LEFT JOIN idx i ON i.path = x.path LEFT JOIN mt m ON m.mpath = x.origin),
st1 AS (
  SELECT path, origin, duration_s, audio_codec, coalesce(in_trash, false) AS in_trash,
   coalesce(status = 'Unchanged' AND was_processed, false) AS skip, meta_ok, validate_errors, meta_ext, content_id, dng_newer
  FROM s),
cur1 AS (SELECT path, origin, content_id FROM s),
waves AS (
  SELECT path, origin, CAST(row_number() OVER (PARTITION BY lower(regexp_extract(path, '^(.*)/', 1) || '/' || {_stem_sql(name_sql('path'))})
                                              ORDER BY path) - 1 AS BIGINT) AS wave
  FROM lst WHERE {supported('path')})
"""
    )


_MOVES = "('mime','case')"
_CONVERTS = "('remux','reencode','reencode_audio')"


def _decide_sql(k: int) -> str:
    """q{k}: the first rule that fits each file of st{k}, looking at the files of cur{k}."""
    exts = [e for e0 in N.LIVE_IMAGE_EXTENSIONS for e in (e0, e0.upper())]
    n = len(exts)
    cand_list = ",".join(f"{{'prio': {i}, 'e': '{e}', 'h': false}}" for i, e in enumerate(exts)) + "," + ",".join(
        f"{{'prio': {n + i}, 'e': '{e}', 'h': true}}" for i, e in enumerate(exts)
    )
    st = _stem_sql(name_sql("v.path"))
    e = ext("s.path")
    return f"""
, v{k} AS (SELECT path FROM st{k} WHERE lower({ext('path')}) IN {_lst(N.LIVE_VIDEO_EXTENSIONS)}),
cands{k} AS (
  SELECT v.path, x.prio,
   regexp_extract(v.path, '^(.*)/', 1) || '/' ||
   CASE WHEN x.h THEN (CASE WHEN regexp_matches({st}, '(?i)_hevc$') THEN regexp_replace({st}, '(?i)_hevc$', '') END)
        ELSE {st} END || x.e AS companion
  FROM v{k} v, (SELECT unnest([{cand_list}], recursive := true)) x),
comp{k} AS (SELECT path, arg_min(companion, prio) AS companion FROM cands{k} WHERE companion IN (SELECT path FROM cur{k}) GROUP BY path),
d{k} AS (
  SELECT s.*, c.companion, cm.content_id AS companion_content_id, {e} AS ext,
   {mime_target_sql('s.path', 's.meta_ext')} AS mime_target,
   substr(s.path, 1, length(s.path) - length({e})) || lower({e}) AS case_target,
   lower({e}) IN {_lst(N.LIVE_VIDEO_EXTENSIONS)} AS live,
   CASE WHEN lower({e}) IN {_lst(N.REMUX_EXTENSIONS)} THEN 'remux'
        WHEN lower({e}) IN {_lst(N.REENCODE_EXTENSIONS)} THEN 'reencode'
        WHEN lower({e}) IN {_lst(N.REENCODE_AUDIO_EXTENSIONS)} AND starts_with(lower(coalesce(s.audio_codec,'')), 'pcm') THEN 'reencode_audio' END AS conv
  FROM st{k} s LEFT JOIN comp{k} c ON c.path = s.path LEFT JOIN cur{k} cm ON cm.path = c.companion),
r{k} AS (
  SELECT *,
   CASE WHEN NOT (lower(ext) IN {SUPPORTED}) THEN 'ignored'
        WHEN in_trash THEN 'trashed'
        WHEN skip THEN 'skipped'
        WHEN NOT coalesce(meta_ok, false) THEN 'no_metadata'
        WHEN validate_errors > 0 THEN 'invalid'
        WHEN mime_target IS NOT NULL THEN 'mime'
        WHEN regexp_matches(ext, '\\p{{Ll}}') AND regexp_matches(ext, '\\p{{Lu}}') THEN 'case'
        WHEN live AND duration_s IS NULL THEN 'no_duration'
        WHEN live AND duration_s <= 1.0 THEN 'short_clip'
        WHEN live AND companion IS NOT NULL AND duration_s < 4.0 AND coalesce(content_id,'') <> ''
             AND coalesce(companion_content_id,'') <> '' AND content_id = companion_content_id THEN 'live_photo'
        WHEN conv IS NOT NULL THEN conv
        ELSE 'success' END AS rule
  FROM d{k}),
q{k} AS (
  SELECT *, CASE WHEN rule = 'mime' THEN mime_target WHEN rule = 'case' THEN case_target
                 WHEN rule IN {_CONVERTS} THEN substr(path, 1, length(path) - length(ext)) || '.mp4' END AS asked,
   CASE WHEN rule IN ('trashed','short_clip','live_photo') THEN 'delete' WHEN rule IN {_MOVES} THEN 'rename'
        WHEN rule IN {_CONVERTS} THEN 'convert' ELSE 'none' END AS action,
   CASE WHEN rule = 'ignored' THEN 'Ignored' WHEN rule IN ('trashed','short_clip','live_photo') THEN 'Deleted'
        WHEN rule = 'skipped' THEN 'Skipped' WHEN rule IN ('no_metadata','no_duration') THEN 'Failed'
        WHEN rule = 'invalid' THEN 'Invalid' WHEN rule IN {_MOVES} OR rule IN {_CONVERTS} THEN 'Reprocess'
        ELSE 'Success' END AS outcome,
   CASE WHEN rule <> 'success' THEN rule
        WHEN lower(ext) = '.dng' AND coalesce(dng_newer, false) THEN 'dng_newer'
        WHEN live AND companion IS NOT NULL AND duration_s >= 4.0 THEN 'long_live_video' END AS reason
  FROM r{k})
"""


add(
    "process_first_round",
    ["media_files", "media_meta", "ledger", "trash"],
    _process_head()
    + _decide_sql(1)
    + """
SELECT q.path, q.origin, action, asked AS target, outcome, reason, coalesce(w.wave, 0) AS wave
FROM q1 q LEFT JOIN waves w ON w.origin = q.origin
""",
)


def _round_sql(k: int) -> str:
    """Round k: who moves, who waits, who is in the way; then st{k+1} and cur{k+1}."""
    return (
        _decide_sql(k)
        + f"""
, rn{k} AS (
  SELECT path, asked, regexp_replace(asked, '\\.[^./]+$', '') AS base,
   path = min(path) OVER (PARTITION BY asked) AND asked NOT IN (SELECT path FROM q{k} WHERE action = 'rename') AS free
  FROM q{k} WHERE action = 'rename'),
go{k} AS (
  SELECT path, free OR (NOT bool_or(free) OVER (PARTITION BY base) AND path = min(path) OVER (PARTITION BY base)) AS go FROM rn{k}),
act{k} AS (SELECT q.* FROM q{k} q LEFT JOIN go{k} g ON g.path = q.path WHERE coalesce(g.go, true)),
dis{k} AS (
  SELECT * FROM cur{k} WHERE path IN (SELECT asked FROM act{k} WHERE action = 'rename')
   AND path NOT IN (SELECT path FROM act{k} WHERE action IN ('rename', 'convert', 'delete'))),
bq{k} AS (SELECT path FROM dis{k} UNION SELECT path FROM act{k} WHERE action = 'convert'),
bn{k} AS (
  SELECT path, arg_min(name, n) AS backup FROM (
   SELECT b.path, t.n, b.path || '.bak' || CASE WHEN t.n = 0 THEN '' ELSE CAST(t.n AS VARCHAR) END AS name FROM bq{k} b, range(0, 40) t(n)) x
  WHERE name NOT IN (SELECT path FROM cur{k}) GROUP BY path),
creq{k} AS (SELECT path, asked AS dest FROM act{k} WHERE action = 'convert'),
cex{k} AS (
  SELECT path FROM cur{k} WHERE path NOT IN (SELECT path FROM creq{k}) UNION ALL SELECT asked FROM act{k} WHERE action = 'rename')
"""
        + unique_names_sql(f"creq{k}", f"cex{k}", f"c{k}")
        + f"""
, done{k} AS (
  SELECT a.*, coalesce(u.final_dest, a.asked) AS target, CASE WHEN a.action = 'convert' THEN b.backup END AS backup
  FROM act{k} a LEFT JOIN c{k}un u ON u.path = a.path LEFT JOIN bn{k} b ON b.path = a.path),
st{k + 1} AS (
  SELECT target AS path, origin, duration_s, CASE WHEN rule IN ('reencode','reencode_audio') THEN 'aac' ELSE audio_codec END AS audio_codec,
   false AS in_trash, false AS skip, meta_ok, CASE WHEN action = 'convert' THEN 0 ELSE validate_errors END AS validate_errors,
   CASE WHEN action = 'convert' THEN 'mp4' ELSE meta_ext END AS meta_ext, content_id,
   CASE WHEN action = 'convert' THEN false ELSE dng_newer END AS dng_newer
  FROM done{k} WHERE outcome = 'Reprocess'
  UNION ALL
  SELECT path, origin, duration_s, audio_codec, in_trash, skip, meta_ok, validate_errors, meta_ext, content_id, dng_newer
  FROM st{k} WHERE path IN (SELECT path FROM go{k} WHERE NOT go) AND path NOT IN (SELECT path FROM dis{k})),
cur{k + 1} AS (
  SELECT path, origin, content_id FROM cur{k}
  WHERE path NOT IN (SELECT path FROM done{k} WHERE action IN ('rename', 'convert', 'delete')) AND path NOT IN (SELECT path FROM dis{k})
  UNION ALL SELECT target, origin, content_id FROM done{k} WHERE outcome = 'Reprocess'
  UNION ALL SELECT b.backup, d.origin, NULL FROM dis{k} d JOIN bn{k} b ON b.path = d.path
  UNION ALL SELECT backup, origin, NULL FROM done{k} WHERE backup IS NOT NULL
  UNION ALL SELECT backup || '.out', origin, NULL FROM done{k} WHERE backup IS NOT NULL),
rows{k} AS (
  SELECT {k} AS round, path, origin, action, target, backup, backup || '.out' AS tracker, outcome, reason FROM done{k}
  UNION ALL SELECT {k}, d.path, d.origin, 'backup', b.backup, NULL, NULL, 'Displaced', 'displaced' FROM dis{k} d JOIN bn{k} b ON b.path = d.path)
"""
    )


PROCESS_ROUNDS = 6  # rounds that the registered inputs need, at most


def _process_rounds_sql() -> str:
    """The rounds unrolled: the state that one leaves is what the next decides on."""
    rounds = " UNION ALL ".join(f"SELECT * FROM rows{k}" for k in range(1, PROCESS_ROUNDS + 1))
    return (
        _process_head()
        + "".join(_round_sql(k) for k in range(1, PROCESS_ROUNDS + 1))
        + f"""
, plan AS (
  SELECT a.round, a.path, a.origin, a.action, a.target, a.backup, a.tracker, a.outcome, a.reason, coalesce(w.wave, 0) AS wave
  FROM ({rounds}) a LEFT JOIN waves w ON w.origin = a.origin)
"""
    )


_PROC_VIEWS = ["media_files", "media_meta", "ledger", "trash"]
add("process_plan", _PROC_VIEWS, _process_rounds_sql() + "SELECT * FROM plan")
add("process_listing", _PROC_VIEWS, _process_rounds_sql() + f"SELECT path, origin FROM cur{PROCESS_ROUNDS + 1}")

_PROC_FINAL = """
, fin AS (SELECT * FROM plan WHERE outcome <> 'Reprocess'),
touched AS (SELECT DISTINCT origin FROM plan WHERE outcome = 'Reprocess'),
fin2 AS (
  SELECT f.*, CASE WHEN t.origin IS NOT NULL AND f.outcome = 'Success' THEN 'Modified' ELSE f.outcome END AS o2
  FROM fin f LEFT JOIN touched t ON t.origin = f.origin)
"""
add(
    "process_summary",
    _PROC_VIEWS,
    _process_rounds_sql()
    + """
SELECT CAST(count(DISTINCT origin) AS BIGINT) AS total, CAST(count_if(outcome = 'Success') AS BIGINT) AS n_success,
 CAST(count_if(outcome IN ('Reprocess', 'Modified')) AS BIGINT) AS n_modified,
 CAST(count_if(outcome = 'Deleted') AS BIGINT) AS n_deleted, CAST(count_if(outcome = 'Skipped') AS BIGINT) AS n_skipped,
 CAST(count_if(outcome = 'Invalid') AS BIGINT) AS n_invalid, CAST(count_if(outcome = 'Ignored') AS BIGINT) AS n_ignored,
 CAST(count_if(outcome = 'Failed') AS BIGINT) AS n_failed,
 CASE WHEN count_if(outcome = 'Invalid') > 0 OR count_if(outcome = 'Failed') > 0 THEN 2 ELSE 0 END AS run_status
FROM plan
""",
)
add(
    "process_ledger",
    _PROC_VIEWS,
    _process_rounds_sql()
    + _PROC_FINAL
    + f"""
, nl AS (
  SELECT x.path,
   CASE WHEN l.path IS NOT NULL AND x.file_size = l.file_size AND x.mtime_ticks = l.mtime_ticks THEN l.sha256 ELSE x.fsha256 END AS sha256,
   CASE WHEN l.path IS NOT NULL AND x.file_size = l.file_size AND x.mtime_ticks = l.mtime_ticks THEN l.sha1 ELSE x.fsha1 END AS sha1,
   x.file_size, x.mtime_ticks,
   CASE WHEN l.path IS NULL THEN false
        WHEN (CASE WHEN x.file_size = l.file_size AND x.mtime_ticks = l.mtime_ticks THEN l.sha256 ELSE x.fsha256 END) <> l.sha256 THEN false
        ELSE l.is_processed END AS is_processed
  FROM lst x LEFT JOIN ledger l ON l.path = x.path WHERE {supported('x.path')}
  UNION ALL SELECT * FROM ledger WHERE path NOT IN (SELECT path FROM lst WHERE {supported('path')}))
SELECT path, sha256, sha1, file_size, mtime_ticks,
 is_processed OR path IN (SELECT path FROM fin WHERE outcome = 'Success') AS is_processed
FROM nl WHERE path NOT IN (SELECT path FROM fin WHERE outcome = 'Deleted' AND reason = 'trashed')
""",
)
add("trash_rebuilt", ["trash_pages", "trash"], _TRASH_CTES + "SELECT sha1, original_file_name FROM firsts")
