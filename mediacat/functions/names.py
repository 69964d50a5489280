"""Name, extension and media-class columns (FLT-1..3, COL-1..3, COL-17, COL-18).

Every function returns a native Column expression; nothing here runs
Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: extension sets that must equal the reference's --------
SUPPORTED_EXTENSIONS = (
    ".3gp .arw .asf .avi .cr2 .dng .gif .heic .heif .jpeg .jpg .m2t .m2ts .mkv .mov .mp4 .mts "
    ".nef .orf .png .psd .rw2 .tif .tiff .wmv"
).split()
RAW_EXTENSIONS = ".arw .cr2 .dng .nef .orf .rw2".split()
VIDEO_EXTENSIONS = ".3gp .asf .avi .m2t .m2ts .mkv .mov .mp4 .mts .wmv".split()
LIVE_VIDEO_EXTENSIONS = ".mp4 .mov".split()
LIVE_IMAGE_EXTENSIONS = ".heic .jpg .jpeg".split()
TAG_WRITABLE_EXTENSIONS = (
    ".3gp .arw .cr2 .dng .gif .heic .heif .jpeg .jpg .mov .mp4 .nef .orf .png .psd .rw2 .tif .tiff"
).split()
REMUX_EXTENSIONS = ".m2t .mkv".split()
REENCODE_EXTENSIONS = ".asf .wmv .avi .3gp .gif".split()
REENCODE_AUDIO_EXTENSIONS = ".mov .mp4".split()
VIDEO_OUTPUT_EXTENSION = ".mp4"
# --------------------------------------------------------------------------

_EXT_ALTERNATION = "|".join(e[1:] for e in SUPPORTED_EXTENSIONS)
# name = base + one or more trailing supported extensions (never the part
# before the first dot); lazy base so the extension run is the longest.
COMPOUND_EXT_REGEX = r"(?s)^(.*?)((?:\.(?i:" + _EXT_ALTERNATION + r"))+)\z"
COMPOUND_EXT_REGEX_DUCKDB = r"(?s)^(.*?)((?:\.(?:" + _EXT_ALTERNATION + r"))+)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dir_of(path) -> Column:
    """Directory part: everything before the last '/' ('' when there is none)."""
    return F.regexp_extract(_c(path), r"(?s)^(.*)/", 1)


def name_of(path) -> Column:
    """File name: everything after the last '/'."""
    return F.substring_index(_c(path), "/", -1)


def ext_of(name) -> Column:
    """Extension of a file name: last dot to the end; '' when there is no dot
    or the name ends with a dot; '.hidden' keeps '.hidden'."""
    return F.regexp_extract(_c(name), r"(\.[^./]+)\z", 1)


def stem_of(name) -> Column:
    """File name without its extension (text before the last dot)."""
    n = _c(name)
    return F.when(n.contains("."), F.regexp_extract(n, r"(?s)^(.*)\.[^.]*\z", 1)).otherwise(n)


def with_names(df, path: str = "path"):
    """Add dir, name, ext, ext_lower and stem columns for ``path``."""
    return (
        df.withColumn("dir", dir_of(path))
        .withColumn("name", name_of(path))
        .withColumn("ext", ext_of("name"))
        .withColumn("ext_lower", F.lower(F.col("ext")))
        .withColumn("stem", stem_of("name"))
    )


def is_supported(ext) -> Column:
    """FLT-2: case-insensitive membership in the supported extension set."""
    return F.lower(_c(ext)).isin(SUPPORTED_EXTENSIONS)


def media_class(ext) -> Column:
    """FLT-3: 'raw', 'video' or 'image' for a supported extension, else null."""
    e = F.lower(_c(ext))
    return (
        F.when(~e.isin(SUPPORTED_EXTENSIONS), F.lit(None).cast("string"))
        .when(e.isin(RAW_EXTENSIONS), F.lit("raw"))
        .when(e.isin(VIDEO_EXTENSIONS), F.lit("video"))
        .otherwise(F.lit("image"))
    )


def is_live_video(ext) -> Column:
    return F.lower(_c(ext)).isin(LIVE_VIDEO_EXTENSIONS)


def is_live_image(ext) -> Column:
    return F.lower(_c(ext)).isin(LIVE_IMAGE_EXTENSIONS)


def is_tag_writable(ext) -> Column:
    return F.lower(_c(ext)).isin(TAG_WRITABLE_EXTENSIONS)


def compound_base(path) -> Column:
    """COL-1 base: the path with its run of trailing supported extensions removed."""
    p = _c(path)
    name = name_of(p)
    base_name = F.regexp_extract(name, COMPOUND_EXT_REGEX, 1)
    has = name.rlike(COMPOUND_EXT_REGEX)
    d = dir_of(p)
    return F.when(has, F.when(p.contains("/"), F.concat(d, F.lit("/"), base_name)).otherwise(base_name)).otherwise(p)


def compound_ext(path) -> Column:
    """COL-1 extension: consecutive trailing supported extensions ('.heic.jpg')."""
    return F.regexp_extract(name_of(_c(path)), COMPOUND_EXT_REGEX, 2)


def is_mixed_case(ext) -> Column:
    """COL-2: at least one lower-case and one upper-case letter."""
    e = _c(ext)
    return e.rlike(r"\p{Ll}") & e.rlike(r"\p{Lu}")


def mime_target(path, meta_ext) -> Column:
    """COL-3: rename target when the metadata file type disagrees with the
    compound extension, else null."""
    m = _c(meta_ext)
    m_dot = F.concat(F.lit("."), m)
    return F.when(
        m.isNotNull()
        & (m != "")
        & is_supported(m_dot)
        & (F.lower(m_dot) != F.lower(compound_ext(path))),
        F.concat(compound_base(path), F.lit("."), F.lower(m)),
    )


def conversion_class(ext, audio_codec) -> Column:
    """COL-17: 'remux', 'reencode', 'reencode_audio' or null."""
    e = F.lower(_c(ext))
    a = F.coalesce(_c(audio_codec), F.lit(""))
    return (
        F.when(e.isin(REMUX_EXTENSIONS), F.lit("remux"))
        .when(e.isin(REENCODE_EXTENSIONS), F.lit("reencode"))
        .when(e.isin(REENCODE_AUDIO_EXTENSIONS) & F.lower(a).startswith("pcm"), F.lit("reencode_audio"))
    )


# COL-18: backup names are 'X.bak' or 'X.bakN'
BACKUP_REGEX = r"\.bak(\d*)\z"


def backup_parts(path) -> dict[str, Column]:
    p = _c(path)
    digits = F.regexp_extract(p, BACKUP_REGEX, 1)
    is_backup = p.rlike(BACKUP_REGEX)
    return {
        "is_backup": is_backup,
        "is_numbered": p.rlike(r"\.bak\d+\z"),
        "base": F.when(is_backup, F.regexp_replace(p, BACKUP_REGEX, "")),
        # '.bak' sorts as 0, '.bakN' as N (digits beyond bigint range stay null)
        "backup_key": F.when(is_backup, F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))),
    }
