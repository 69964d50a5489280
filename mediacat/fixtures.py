"""Stand-in inputs built from the driver tables.

The views below only reshape the driver's ``documents`` table into rows of
the schemas the operators consume (listing, ledger, metadata documents,
feed pages, verdict lines, backup listing ...). They do none of the
operators' work. The same SQL text serves Spark and DuckDB; the dialect
differences are confined to :func:`_dialect`.

Root for path tags and path mapping is ``/lib`` (mapped to ``/media``);
the ``as_of`` year for date validity is 2024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LIB_ROOT = "/lib"
MEDIA_ROOT = "/media"
AS_OF_YEAR = 2024
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# (name, sql) in creation order. Spark dialect; see _dialect for DuckDB.
VIEWS: list[tuple[str, str]] = [
    (
        "media_names",
        """
SELECT *,
 CASE g % 6 WHEN 0 THEN concat('/lib/',src,'/g',gs,'/',ys,'/',ms,'/',ds)
            WHEN 1 THEN concat('/lib/',src,'/g',gs,'/',ys,'-',ms,'-',ds)
            WHEN 2 THEN concat('/lib/',src,'/g',gs,'/',ys,'_',ms,'_',ds)
            WHEN 3 THEN concat('/lib/',src,'/g',gs,'/',ys,ms,ds)
            WHEN 4 THEN concat('/lib/',src,'/g',gs,'/',ys,'/misc')
            ELSE concat('/lib/',src,'/g',gs) END AS dir,
 CASE g % 9 WHEN 0 THEN concat('IMG_',ys,ms,ds,'_123456')
            WHEN 1 THEN concat('PHOTO-',ys,'-',ms,'-',ds,'-07-56-41')
            WHEN 2 THEN concat('Foo_',ys,'_',ms,'_',ds,'_200152957_iOS')
            WHEN 3 THEN concat('EV ',ys,' ',ms,' ',ds,'_0003')
            WHEN 4 THEN concat('WhatsApp Image ',ys,'-',ms,'-',ds,' at 7.48.17 PM')
            WHEN 5 THEN concat('IMG_',CAST(g % 3 AS STRING))
            WHEN 6 THEN concat('bad_',ys,'-13-',ds)
            WHEN 7 THEN 'scan.heic'
            ELSE concat('IMG_',gs, CASE WHEN doc_id % 3 = 1 THEN '_HEVC' ELSE '' END) END AS stem,
 CASE doc_id % 16 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mov' WHEN 3 THEN '.heic' WHEN 4 THEN '.mp4'
   WHEN 5 THEN '.Jpg' WHEN 6 THEN '.jpeg' WHEN 7 THEN '.mov' WHEN 8 THEN '.mkv' WHEN 9 THEN '.avi' WHEN 10 THEN '.gif'
   WHEN 11 THEN '.dng' WHEN 12 THEN '.txt' WHEN 13 THEN '.m2ts' WHEN 14 THEN '.PNG' ELSE '' END AS ext
FROM (SELECT *, CAST(g AS STRING) AS gs, concat('src',CAST(g % 5 AS STRING)) AS src,
        CAST(2015 + g % 10 AS STRING) AS ys, lpad(CAST(1 + g % 12 AS STRING),2,'0') AS ms,
        lpad(CAST(1 + g % 28 AS STRING),2,'0') AS ds
      FROM (SELECT doc_id, text, n_chars, CAST(floor(doc_id/3) AS BIGINT) AS g FROM documents) a) b
""",
    ),
    (
        "media_files",
        """
SELECT doc_id, g, concat(dir,'/',stem,ext) AS path, sha2(text,256) AS sha256, sha1(text) AS sha1,
 n_chars AS file_size, 638396640000000000 + doc_id*10000000 AS mtime_ticks,
 CAST(doc_id % 80 AS DOUBLE)/10 AS duration_s,
 CASE doc_id % 4 WHEN 0 THEN 'aac' WHEN 1 THEN 'pcm_s16le' ELSE '' END AS audio_codec
FROM media_names
""",
    ),
    (
        "ledger",
        """
SELECT concat(dir,'/',stem,ext) AS path,
 CASE WHEN doc_id % 10 = 3 THEN sha2(concat(text,'x'),256) ELSE sha2(text,256) END AS sha256,
 CASE WHEN doc_id % 10 = 3 THEN sha1(concat(text,'x')) ELSE sha1(text) END AS sha1,
 CASE WHEN doc_id % 10 = 3 THEN n_chars + 1 ELSE n_chars END AS file_size,
 638396640000000000 + doc_id*10000000 - CASE WHEN doc_id % 10 IN (3,6) THEN 20000000 ELSE 0 END AS mtime_ticks,
 doc_id % 4 = 0 AS is_processed
FROM media_names WHERE doc_id % 5 <> 4
""",
    ),
    (
        "import_ledger",
        """
SELECT concat('/old',path) AS path, sha256, sha1, file_size, mtime_ticks, false AS is_processed
FROM media_files WHERE doc_id % 6 = 1
""",
    ),
    (
        "skip_ledger",
        """
SELECT concat('/other/',CAST(doc_id AS STRING),'.jpg') AS path, sha2(text,256) AS sha256, sha1(text) AS sha1
FROM documents WHERE doc_id % 7 = 2
""",
    ),
    (
        "trash",
        """
SELECT sha1, min(concat('old_',CAST(doc_id AS STRING),'.jpg')) AS original_file_name
FROM media_files WHERE doc_id % 12 = 5 GROUP BY sha1
""",
    ),
    (
        "trash_pages",
        """
SELECT page, CASE WHEN page >= 8 THEN 'not-a-page' ELSE CAST(page + 1 AS STRING) END AS next_page,
 concat('asset-',CAST(doc_id AS STRING)) AS id,
 CASE WHEN doc_id % 13 = 0 THEN 'not-valid-base64!!!' WHEN doc_id % 13 = 1 THEN '' ELSE base64(unhex(sha1(text))) END AS checksum,
 concat('photo_',CAST(doc_id AS STRING),'.jpg') AS original_file_name, doc_id % 11 <> 0 AS is_trashed
FROM (SELECT doc_id, text, CAST(floor(doc_id/100) AS BIGINT) + 1 AS page FROM documents) p WHERE doc_id % 3 = 0
""",
    ),
    (
        "media_meta",
        """
SELECT path, concat('{"SourceFile":"',path,'"',
 CASE WHEN doc_id % 16 IN (12,15) THEN '' WHEN doc_id % 16 IN (0,1,3,5,6) THEN ',"File:FileTypeExtension":"jpg"'
      WHEN doc_id % 16 = 2 THEN ',"File:FileTypeExtension":"MOV"' WHEN doc_id % 16 = 13 THEN ',"File:FileTypeExtension":"m2t"'
      WHEN doc_id % 16 = 14 THEN ',"File:FileTypeExtension":"png"' WHEN doc_id % 16 = 11 THEN ',"File:FileTypeExtension":"dng"'
      ELSE ',"File:FileTypeExtension":"mp4"' END,
 CASE doc_id % 7 WHEN 0 THEN ',"EXIF:DateTimeOriginal":"2019:03:04 05:06:07"'
      WHEN 1 THEN ',"QuickTime:CreateDate":"0000:00:00 00:00:00"' WHEN 2 THEN ',"XMP:CreateDate":"2018:02:03 04:05:06.789"'
      WHEN 3 THEN ',"ASF:CreationDate":"0000:01:01 00:00:00","RIFF:DateTimeOriginal":"2001:01:01 01:01:01"'
      WHEN 4 THEN ',"EXIF:CreateDate":"","QuickTime:CreateDate":"2020:12:31 23:59:59"' ELSE '' END,
 CASE doc_id % 8 WHEN 0 THEN ',"XMP:Subject":["a",2009,"b"]' WHEN 1 THEN ',"XMP:Subject":"solo"'
      WHEN 2 THEN ',"XMP:Subject":2009' WHEN 3 THEN ',"XMP:Subject":null' ELSE '' END,
 CASE doc_id % 9 WHEN 0 THEN ',"ExifTool:Validate":"OK"' WHEN 1 THEN ',"ExifTool:Validate":"4 Warnings (all minor)"'
      WHEN 2 THEN ',"ExifTool:Validate":"2 Errors, 3 Warnings"' ELSE '' END,
 CASE WHEN doc_id % 16 = 11 THEN concat(',"EXIF:DNGVersion":"1.',CAST(3 + g % 3 AS STRING),'.0.0"') ELSE '' END,
 CASE WHEN g % 4 = 3 THEN '' WHEN g % 4 = 2 THEN concat(',"MakerNotes:ContentIdentifier":"c',CAST(doc_id AS STRING),'"')
      ELSE concat(',"QuickTime:ContentIdentifier":"c',CAST(g AS STRING),'"') END, '}') AS meta_json
FROM media_files
""",
    ),
    (
        "verdict_lines",
        """
SELECT doc_id AS line_no,
 CASE WHEN doc_id % 23 = 0 THEN '(node:1) Warning: deprecated' WHEN doc_id % 19 = 0 THEN '{"path":"/photoc'
      WHEN doc_id % 6 = 0 THEN concat('{"path":"/media',substr(path,5),'","ok":false,"via":"","error":"bad seek"}')
      ELSE concat('{"path":"/media',substr(path,5),'","ok":true,"via":"decode"}') END AS line
FROM media_files WHERE doc_id % 17 <> 0
""",
    ),
    (
        "backup_listing",
        # The reference fixture crosses media_names with five suffixes; the
        # same rows come from five filtered selects, one per suffix.
        """
SELECT path, min(file_size) AS file_size FROM (
 SELECT concat(dir,'/',stem,ext,'.bak') AS path,
  CASE WHEN g % 5 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END AS file_size
 FROM media_names WHERE g % 3 = 0 AND (doc_id % 3 = 0 OR g % 2 = 0)
 UNION ALL SELECT concat(dir,'/',stem,ext,'.bak1'), n_chars FROM media_names
 WHERE g % 3 = 0 AND (doc_id % 3 = 0 OR g % 2 = 0) AND doc_id % 2 = 0
 UNION ALL SELECT concat(dir,'/',stem,ext,'.bak2'), n_chars FROM media_names
 WHERE g % 3 = 0 AND (doc_id % 3 = 0 OR g % 2 = 0) AND doc_id % 4 = 0
 UNION ALL SELECT concat(dir,'/',stem,ext), n_chars FROM media_names
 WHERE g % 3 = 0 AND (doc_id % 3 = 0 OR g % 2 = 0) AND doc_id % 3 <> 1
 UNION ALL SELECT concat(dir,'/',stem,ext,'.bak.out'), n_chars FROM media_names
 WHERE g % 3 = 0 AND (doc_id % 3 = 0 OR g % 2 = 0) AND doc_id % 5 = 1
 UNION ALL SELECT concat(dir,'/',stem,'_1.mp4'), n_chars FROM media_names WHERE g % 3 = 0 AND doc_id % 10 = 1
 UNION ALL SELECT concat(dir,'/',stem,'.mp4'), n_chars FROM media_names WHERE g % 3 = 0 AND g % 2 = 1) u
GROUP BY path
""",
    ),
    (
        "trackers",
        """
SELECT concat(dir,'/',stem,ext,'.bak') AS backup_path, concat(dir,'/',stem,'_1.mp4') AS output_path
FROM media_names WHERE g % 3 = 0 AND (doc_id % 3 = 0 OR g % 2 = 0) AND doc_id % 5 = 1
""",
    ),
    (
        "existing_dest",
        """
SELECT concat('2019/03/04/',stem,ext) AS path FROM media_names WHERE doc_id % 21 = 0 GROUP BY concat('2019/03/04/',stem,ext)
""",
    ),
    (
        "media_dirs",
        """
SELECT dir FROM media_names GROUP BY dir
UNION ALL SELECT concat('/lib/empty',CAST(doc_id AS STRING)) FROM documents WHERE doc_id % 50 = 0
UNION ALL SELECT concat('/lib/empty',CAST(doc_id AS STRING),'/a') FROM documents WHERE doc_id % 100 = 0
""",
    ),
]

_VIEW_SQL = dict(VIEWS)
ADDED_COLUMNS = {"media_names"}
_DEPS = {
    name: [other for other, _ in VIEWS if other != name and f" {other}" in sql.replace("\n", " ")]
    for name, sql in VIEWS
}


def _dialect(sql: str, dialect: str) -> str:
    if dialect == "duckdb":
        sql = sql.replace("sha2(", "sha256(").replace(",256)", ")").replace("base64(", "to_base64(")
    return sql


def _closure(names) -> list[str]:
    wanted: set[str] = set()

    def visit(n):
        if n in wanted or n not in _VIEW_SQL:
            return
        for d in _DEPS[n]:
            visit(d)
        wanted.add(n)

    for n in names:
        visit(n)
    return [n for n, _ in VIEWS if n in wanted]


def duckdb_with(names, body: str) -> str:
    """Prefix an oracle query with the fixture views it needs as CTEs."""
    ctes = [f"{n} AS ({_dialect(_VIEW_SQL[n], 'duckdb').strip()})" for n in _closure(names)]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Fixtures:
    """DataFrames of the stand-in inputs for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        key = f"table:{name}"
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _VIEW_SQL:
            if name == "_tree":
                return None
            raise AttributeError(name)
        if name not in self._frames:
            for dep in _closure([name]):
                if dep not in self._frames:
                    self._frames[dep] = self._stage(dep)
        return self._frames[name]

    def _stage(self, name: str) -> DataFrame:
        """Build one view from the driver table and the views it uses, and
        land it once as a parquet table in the session's checkpoint folder:
        the operators then read it like any other input table. A view that only
        adds columns to the driver's rows is not landed: that would be a second
        copy of all texts, and the views made from it need few of its columns."""
        import uuid

        from .session import ensure_checkpoint_dir

        self.table("documents").createOrReplaceTempView("documents")
        for dep in _closure([name]):
            if dep != name:
                self._frames[dep].createOrReplaceTempView(dep)
        df = self.spark.sql(_VIEW_SQL[name])
        if name in ADDED_COLUMNS:
            return df
        base = ensure_checkpoint_dir(self.spark).rstrip("/")
        path = f"{base}/mediacat-fixtures/{uuid.uuid4().hex}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


_CACHE: dict[tuple[str, str], Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    # keyed by the running application: a stopped session's staged tables
    # are never handed to a new one
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = Fixtures(spark, sf_dir)
    return _CACHE[key]


def stage_media_tree(spark: SparkSession, fx: Fixtures) -> str:
    """Land every fixture file as a real file (its bytes are the document
    text) plus the conversion trackers, below a scratch root; returns the
    root URI prefix under which '/lib/...' paths live. Input staging only."""
    import uuid

    from .session import ensure_checkpoint_dir

    if getattr(fx, "_tree", None):
        return fx._tree
    base = ensure_checkpoint_dir(spark).rstrip("/")
    root = f"{base}/mediacat-tree/{uuid.uuid4().hex}"

    fx.table("documents").createOrReplaceTempView("documents")
    fx.media_names.createOrReplaceTempView("media_names")
    files = spark.sql("SELECT concat(dir,'/',stem,ext) AS path, text AS body FROM media_names")
    trackers = fx.trackers.selectExpr("concat(backup_path, '.out') AS path", "concat(output_path, '\\n') AS body")
    payload = files.unionByName(trackers)

    def write(it):
        import pandas as pd

        from .sources.files import fs_and_path

        filesystem, base_path = fs_and_path(root)
        n = 0
        for pdf in it:
            for p, body in zip(pdf["path"], pdf["body"]):
                target = base_path.rstrip("/") + p
                filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with filesystem.open_output_stream(target) as out:
                    out.write((body or "").encode("utf-8"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    payload.mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    fx._tree = root
    return root
