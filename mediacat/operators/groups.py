"""Groups of related files: case conflicts (WIN-1), stem waves (WIN-2) and
live-photo companions (JN-5).

Group positions come from the skew-safe running sums of
:mod:`mediacat.operators.ranking`; the companion lookup is an equi-join on
a bounded set of candidate names per video (at most 12), never a pairing
of all files of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import LIVE_IMAGE_EXTENSIONS, dir_of, is_live_video, is_supported, name_of, stem_of
from .naming import SUFFIXED_STEM, unique_names
from .ranking import group_ordinal

# --- fixed values ---------------------------------------------------------
HEVC_SUFFIX = "_hevc"
# --------------------------------------------------------------------------


def case_conflicts(files: DataFrame) -> DataFrame:
    """WIN-1: paths equal ignoring case (group size > 1). Every member is
    renamed to ``<stem>_<K><ext>`` with K = 1, 2, ... in path order, skipping
    names already present. Names are compared ignoring case so the new
    names cannot form a new conflict. Returns path, new_path."""
    paths = files.select("path").withColumn("_lp", F.lower(F.col("path")))
    sizes = paths.groupBy("_lp").agg(F.count(F.lit(1)).alias("_n"))
    members = paths.join(sizes.filter(F.col("_n") > 1), "_lp", "left_semi")
    # every member asks for the shared case-folded name, which is taken by
    # the members themselves, so each one gets the next free suffix
    existing = paths.select(F.col("_lp").alias("path"))
    named = unique_names(members.select("path", F.col("_lp").alias("dest")), existing, "dest", "path")
    k = F.regexp_extract(stem_of(name_of(F.col("final_dest"))), SUFFIXED_STEM, 2)
    d = dir_of(F.col("path"))
    nm = name_of(F.col("path"))
    ext = F.regexp_extract(nm, r"(\.[^.]+)\z", 1)
    new_name = F.concat(stem_of(nm), F.lit("_"), k, ext)
    new_path = F.when(F.col("path").contains("/"), F.concat(d, F.lit("/"), new_name)).otherwise(new_name)
    return named.select("path", new_path.alias("new_path"))


def stem_waves(files: DataFrame) -> DataFrame:
    """WIN-2: media files sharing dir+stem (ignoring case) are handled in
    successive waves: wave = position in the group - 1; others wave 0."""
    f = files.select("path").withColumn("_nm", name_of(F.col("path")))
    media = f.filter(is_supported(F.regexp_extract(F.col("_nm"), r"(\.[^./]+)\z", 1)))
    other = f.filter(~is_supported(F.regexp_extract(F.col("_nm"), r"(\.[^./]+)\z", 1)))
    media = media.withColumn("_key", F.lower(F.concat(dir_of(F.col("path")), F.lit("/"), stem_of(F.col("_nm")))))
    ranked = group_ordinal(media, ["_key"], [F.col("path")], name="_pos")
    return ranked.select("path", (F.col("_pos") - 1).alias("wave")).unionByName(
        other.select("path", F.lit(0).cast("long").alias("wave"))
    )


def companion_candidates(videos: DataFrame) -> DataFrame:
    """For each live video (path) the ordered companion names: same dir and
    stem with heic/jpg/jpeg in lower then upper case; then the same with a
    trailing '_hevc' (any case) removed from the stem."""
    d = dir_of(F.col("path"))
    stem = stem_of(name_of(F.col("path")))
    prefix = F.when(F.col("path").contains("/"), F.concat(d, F.lit("/"))).otherwise(F.lit(""))
    hevc = "(?i)" + HEVC_SUFFIX + r"\z"
    stripped = F.when(stem.rlike(hevc), F.regexp_replace(stem, hevc, ""))
    cands = []
    prio = 0
    for base, present in ((stem, F.lit(True)), (stripped, stripped.isNotNull())):
        for e in LIVE_IMAGE_EXTENSIONS:
            for spelled in (e, e.upper()):
                cands.append(F.struct(F.lit(prio).alias("prio"), F.when(present, F.concat(prefix, base, F.lit(spelled))).alias("cand")))
                prio += 1
    return videos.select("path", F.explode(F.array(*cands)).alias("c")).select(
        "path", F.col("c.prio").alias("prio"), F.col("c.cand").alias("companion")
    ).filter(F.col("companion").isNotNull())


def live_videos(files: DataFrame) -> DataFrame:
    return files.select("path").filter(is_live_video(F.regexp_extract(name_of(F.col("path")), r"(\.[^./]+)\z", 1)))


def live_photo_pairs(files: DataFrame, listing: DataFrame) -> DataFrame:
    """JN-5: live videos (mp4/mov) with the first existing companion image.
    Returns path, companion."""
    existing = listing.select(F.col("path").alias("companion"))
    hits = companion_candidates(live_videos(files)).join(existing, "companion", "left_semi")
    best = hits.groupBy("path").agg(F.min(F.struct("prio", "companion")).alias("b"))
    return best.select("path", F.col("b.companion").alias("companion"))
