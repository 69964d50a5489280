"""PLN-3 / PLN-4 process: the clean-up plan for a library.

For every file the first matching rule decides (rule order of the
reference):

1. unsupported extension -> Ignored
2. (with a ledger) sha1 in the trash set -> delete, Deleted; the ledger row goes
3. (with a ledger) unchanged and already processed, no ``reprocess`` -> Skipped
4. no metadata -> Failed; validation errors -> Invalid
5. metadata file type differs from the compound extension -> rename, Reprocess
6. mixed-case extension -> rename to lower case, Reprocess
7. live video (mp4/mov): no duration -> Failed; duration <= short limit ->
   delete, Deleted; a companion image with equal non-empty content ids and
   duration < live limit -> delete, Deleted
8. conversion class (remux / reencode / reencode_audio) -> convert to
   ``<stem>.mp4`` (free name), Reprocess
9. otherwise Success (warnings: newer DNG, long video with a companion)

Renamed and converted files re-enter (PLN-4) until nothing does; there is no
cap on the rounds, and a state that comes back raises an error. Rounds share
a *current listing*: the starting one and a small table of the names that moves
have taken out of it and put in, so no two files ever get one name. After the
first round only files that changed are looked at; the listing is never
written anew.

* Of several files that ask for one name, the first by path goes and the
  others wait for the next round. A file that asks for the name of another file
  about to move goes behind it in the same round (``step``), a whole chain at
  once. Where all wait for each other, the first by path goes.
* A move onto a name that another file still holds displaces that file: it
  gets a ``backup`` row (``X.bak``, ``X.bak1``, ...; with ``skip_backup`` a
  ``delete`` row), so undo knows of it.
* A convert target is made unique against the current listing; the source
  becomes a backup, and ``tracker`` names the file that ties the two together.

Every round's decisions are written as a table under the checkpoint
directory; the driver only reads emptiness flags and a fingerprint of the
files that re-enter. Same-stem files get a ``wave`` (WIN-2): the order in
which the plan must be executed.

What a converted file will look like is modelled, not probed: same
duration and content id, container mp4, audio aac after a re-encode and
unchanged after a remux, clean validation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import names as N
from ..operators.groups import case_conflicts, companion_candidates, live_videos, stem_waves
from ..operators.materialize import materialize
from ..operators.membership import flag_member
from ..operators.naming import unique_names
from ..schemas import LEDGER_COLUMNS
from .index import index_run

# --- fixed values ---------------------------------------------------------
SHORT_VIDEO_SECONDS = 1.0
LIVE_VIDEO_SECONDS = 4.0
BACKUP_SUFFIX = ".bak"
TRACKER_SUFFIX = ".out"
# --------------------------------------------------------------------------

STATE_COLUMNS = [
    "path",
    "origin",
    "in_trash",
    "skip",
    "meta_ok",
    "validate_errors",
    "meta_ext",
    "content_id",
    "dng_newer",
    "duration_s",
    "audio_codec",
]


@dataclass
class ProcessOptions:
    reprocess: bool = False
    short_video_seconds: float = SHORT_VIDEO_SECONDS
    skip_backup: bool = False


@dataclass
class ProcessResult:
    plan: DataFrame  # round, path, origin, action, target, backup, tracker, outcome, reason, wave, step
    listing: DataFrame  # path, origin of every file once the plan is carried out
    renames: DataFrame  # case-conflict renames (path, new_path)
    ledger: DataFrame | None


def next_backup_names(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """WIN-6: for each path X the backup name ``X.bak`` when free, else the
    smallest free ``X.bakN`` (N >= 1), for any number of existing backups.

    The smallest free number is the least k + 1 that is not taken, over k = 0
    and the taken numbers: an anti join on (path, number) and a minimum, so a
    file of very many backups is spread by number. (A number too large for a
    bigint cannot be next to the run.)"""
    parts = N.backup_parts(F.col("path"))
    backups = listing.select("path").filter(parts["is_backup"]).select(parts["base"].alias("path"), parts["backup_key"].alias("k"))
    return _next_backups(paths, backups.filter(F.col("k").isNotNull()))


def _next_backups(paths: DataFrame, backups: DataFrame) -> DataFrame:
    """``backups``: the existing ones as path (of the original) and k, 0 for a plain ``.bak``."""
    want = paths.select("path").distinct()
    taken = backups.join(want, "path", "left_semi").distinct()
    tried = want.select("path", F.lit(-1).cast("long").alias("_k")).unionByName(taken.select("path", F.col("k").alias("_k")))
    # -1: the plain name; it is followed by number 1 where it is taken
    tried = tried.select("path", F.try_add("_k", F.lit(1).cast("long")).alias("k")).unionByName(want.select("path", F.lit(1).cast("long").alias("k")))
    least = tried.join(taken, ["path", "k"], "left_anti").groupBy("path").agg(F.min("k").alias("k"))
    number = F.when(F.col("k") == 0, F.lit("")).otherwise(F.col("k").cast("string"))
    return least.select("path", F.concat("path", F.lit(BACKUP_SUFFIX), number).alias("backup_path"))


@dataclass
class _Names:
    """The current listing: the landed one the run starts from and, of the names
    that rounds have taken out or put in, the last state (``delta``, one row
    for a path). A round asks for the names it needs and writes no listing."""

    base: DataFrame  # path, origin, content_id
    backups: DataFrame  # path, k of the base's backups
    delta: DataFrame | None = None  # path, origin, content_id, present

    def all(self) -> DataFrame:
        if self.delta is None:
            return self.base
        return self.base.join(self.delta.select("path"), "path", "left_anti").unionByName(self.delta.where("present").drop("present"))

    def among(self, paths: DataFrame) -> DataFrame:
        """The current rows of the given paths (``path``, distinct)."""
        found = self.base.join(paths, "path", "left_semi")
        if self.delta is None:
            return found
        return found.join(self.delta.select("path"), "path", "left_anti").unionByName(
            self.delta.where("present").drop("present").join(paths, "path", "left_semi")
        )

    def matching(self, asked: DataFrame, column: str) -> DataFrame:
        """The rows of ``asked`` whose ``column`` is a current name, with its ``content_id``."""
        named = self.base.select(F.col("path").alias(column), "content_id")
        found = asked.join(named, column)
        if self.delta is None:
            return found
        put = self.delta.where("present").select(F.col("path").alias(column), "content_id")
        return found.join(self.delta.select(F.col("path").alias(column)), column, "left_anti").unionByName(asked.join(put, column))

    def next_backups(self, paths: DataFrame) -> DataFrame:
        if self.delta is None:
            return _next_backups(paths, self.backups)
        parts = N.backup_parts(F.col("path"))
        moved = self.delta.filter(parts["is_backup"]).select(parts["base"].alias("path"), parts["backup_key"].alias("k"), "present").where("k IS NOT NULL")
        kept = self.backups.join(moved.select("path", "k"), ["path", "k"], "left_anti")
        return _next_backups(paths, kept.unionByName(moved.where("present").drop("present")))

    def after(self, gone: DataFrame, put: DataFrame) -> _Names:
        """With the paths ``gone`` taken out and then the rows ``put`` put in."""
        none = F.lit(None).cast("string")
        put = put.withColumn("present", F.lit(True))
        out = gone.select("path").distinct().join(put.select("path"), "path", "left_anti")
        rows = put.unionByName(out.select("path", none.alias("origin"), none.alias("content_id"), F.lit(False).alias("present")))
        if self.delta is not None:
            rows = rows.unionByName(self.delta.join(rows.select("path"), "path", "left_anti"))
        return _Names(self.base, self.backups, materialize(rows))


def _decide(state: DataFrame, names: _Names, opts: ProcessOptions, with_ledger: bool) -> DataFrame:
    s = state.withColumn("ext", N.ext_of(N.name_of(F.col("path"))))
    images = names.matching(companion_candidates(live_videos(s)), "companion")
    first = images.groupBy("path").agg(F.min(F.struct("prio", "companion", "content_id")).alias("_image"))
    s = s.join(first, "path", "left").withColumns({"companion": F.col("_image.companion"), "companion_content_id": F.col("_image.content_id")})
    # stage the inputs of the rule list as plain columns (keeps generated
    # code small; each regex runs once per row)
    s = s.withColumns(
        {
            "mime_target": N.mime_target(F.col("path"), F.col("meta_ext")),
            "case_target": F.concat(F.expr("substring(path, 1, length(path) - length(ext))"), F.lower(F.col("ext"))),
            "_supported": N.is_supported(F.col("ext")),
            "_mixed": N.is_mixed_case(F.col("ext")),
            "_live": N.is_live_video(F.col("ext")),
            "_conv": N.conversion_class(F.col("ext"), F.col("audio_codec")),
        }
    )
    mime = F.col("mime_target")
    live = F.col("_live")
    dur = F.col("duration_s")
    ids_equal = (
        F.coalesce(F.col("content_id"), F.lit("")) != ""
    ) & (F.coalesce(F.col("companion_content_id"), F.lit("")) != "") & (F.col("content_id") == F.col("companion_content_id"))
    confirmed = F.col("companion").isNotNull() & (dur < LIVE_VIDEO_SECONDS) & ids_equal
    conv = F.col("_conv")
    ledger_on = F.lit(with_ledger)

    rule = (
        F.when(~F.col("_supported"), F.lit("ignored"))
        .when(ledger_on & F.coalesce(F.col("in_trash"), F.lit(False)), F.lit("trashed"))
        .when(ledger_on & F.coalesce(F.col("skip"), F.lit(False)), F.lit("skipped"))
        .when(~F.coalesce(F.col("meta_ok"), F.lit(False)), F.lit("no_metadata"))
        .when(F.col("validate_errors") > 0, F.lit("invalid"))
        .when(mime.isNotNull(), F.lit("mime"))
        .when(F.col("_mixed"), F.lit("case"))
        .when(live & dur.isNull(), F.lit("no_duration"))
        .when(live & (dur <= opts.short_video_seconds), F.lit("short_clip"))
        .when(live & confirmed, F.lit("live_photo"))
        .when(conv.isNotNull(), conv)
        .otherwise(F.lit("success"))
    )
    s = s.withColumn("rule", rule)
    action = (
        F.when(F.col("rule").isin("trashed", "short_clip", "live_photo"), F.lit("delete"))
        .when(F.col("rule").isin("mime", "case"), F.lit("rename"))
        .when(F.col("rule").isin("remux", "reencode", "reencode_audio"), F.lit("convert"))
        .otherwise(F.lit("none"))
    )
    outcome = (
        F.when(F.col("rule") == "ignored", F.lit("Ignored"))
        .when(F.col("rule").isin("trashed", "short_clip", "live_photo"), F.lit("Deleted"))
        .when(F.col("rule") == "skipped", F.lit("Skipped"))
        .when(F.col("rule").isin("no_metadata", "no_duration"), F.lit("Failed"))
        .when(F.col("rule") == "invalid", F.lit("Invalid"))
        .when(F.col("rule").isin("mime", "case", "remux", "reencode", "reencode_audio"), F.lit("Reprocess"))
        .otherwise(F.lit("Success"))
    )
    reason = (
        F.when(F.col("rule") != "success", F.col("rule"))
        .when((F.lower(F.col("ext")) == ".dng") & F.coalesce(F.col("dng_newer"), F.lit(False)), F.lit("dng_newer"))
        .when(live & F.col("companion").isNotNull() & (dur >= LIVE_VIDEO_SECONDS), F.lit("long_live_video"))
    )
    return s.withColumn("action", action).withColumn("outcome", outcome).withColumn("reason", reason)


@dataclass
class _Start:
    renames: DataFrame
    listing: DataFrame  # path, origin, file_size, mtime_ticks, after the case renames
    state: DataFrame
    waves: DataFrame
    ledger: DataFrame | None  # the index run's


def _start(files, metadata_docs, probe, opts, ledger, trash, hasher) -> _Start:
    # WIN-1: case conflicts are renamed before anything else
    renames = materialize(case_conflicts(files))
    listing = files.join(renames, "path", "left").select(
        F.coalesce(F.col("new_path"), F.col("path")).alias("path"),
        F.col("path").alias("origin"),
        "file_size",
        "mtime_ticks",
    )
    meta = M.with_metadata(metadata_docs).select(
        "path", "meta_ok", "validate_errors", "meta_ext", "content_id", "dng_newer"
    )
    state = listing.join(meta.withColumnRenamed("path", "origin"), "origin", "left").join(
        probe.select(F.col("path").alias("origin"), "duration_s", "audio_codec"), "origin", "left"
    )

    indexed = None
    if ledger is not None:
        # a renamed file's bytes are still at its origin path when the plan is made
        origin_of = listing.select(F.col("path").alias("_np"), F.col("origin").alias("_op"))

        def hash_by_origin(df: DataFrame, need) -> DataFrame:
            t = df.withColumn("_hneed", need).join(origin_of, df["path"] == origin_of["_np"], "left")
            t = t.withColumn("_keep", F.col("path")).withColumn("path", F.coalesce(F.col("_op"), F.col("path")))
            h = hasher(t.drop("_np", "_op"), F.col("_hneed"))
            return h.withColumn("path", F.col("_keep")).drop("_keep", "_hneed")

        idx = index_run(listing.select("path", "file_size", "mtime_ticks"), ledger, hash_by_origin)
        status = idx.outcomes.select("path", "status", "was_processed")
        indexed = idx.ledger
        known = indexed.select("path", "sha1")
        if trash is not None:
            # flagged before the joins: the trash set's hot keys are measured on these two columns
            known = flag_member(known, trash, "sha1", "sha1", "in_trash")
        else:
            known = known.withColumn("in_trash", F.lit(False))
        state = state.join(status, "path", "left").join(known.select("path", "in_trash"), "path", "left")
        skip = (F.col("status") == "Unchanged") & F.coalesce(F.col("was_processed"), F.lit(False)) & F.lit(not opts.reprocess)
        state = state.withColumns({"skip": skip, "in_trash": F.coalesce("in_trash", F.lit(False))})
    else:
        state = state.withColumn("skip", F.lit(False)).withColumn("in_trash", F.lit(False))
    state = materialize(state.select(*STATE_COLUMNS))

    # stem conflicts are split after the case renames (on the renamed listing)
    waves = stem_waves(listing.select("path")).join(listing.select("path", "origin"), "path").select("origin", "wave")
    return _Start(renames, listing, state, waves, indexed)


DECIDED = [*STATE_COLUMNS, "ext", "rule", "action", "outcome", "reason", "target"]


def _with_requests(decided: DataFrame) -> DataFrame:
    """``target``: the name a rename or convert asks for."""
    stem = F.expr("substring(path, 1, length(path) - length(ext))")
    target = (
        F.when(F.col("rule") == "mime", F.col("mime_target"))
        .when(F.col("rule") == "case", F.col("case_target"))
        .when(F.col("action") == "convert", F.concat(stem, F.lit(N.VIDEO_OUTPUT_EXTENSION)))
    )
    return decided.withColumn("target", target).select(*DECIDED)


def process_decisions(
    files: DataFrame, metadata_docs: DataFrame, probe: DataFrame, opts: ProcessOptions | None = None,
    ledger: DataFrame | None = None, trash: DataFrame | None = None, hasher=None,
) -> DataFrame:
    """PLN-3, the rule list alone: for every file the first rule that fits,
    with the name it asks for. Arguments as for :func:`process_run`."""
    opts = opts or ProcessOptions()
    start = _start(files, metadata_docs, probe, opts, ledger, trash, hasher)
    decided = _with_requests(_decide(start.state, _names(start.state), opts, ledger is not None)).join(start.waves, "origin", "left")
    return decided.select("path", "origin", "action", "target", "outcome", "reason", F.coalesce("wave", F.lit(0)).alias("wave"))


def _names(state: DataFrame) -> _Names:
    base = state.select("path", "origin", "content_id")
    parts = N.backup_parts(F.col("path"))
    backups = base.filter(parts["is_backup"]).select(parts["base"].alias("path"), parts["backup_key"].alias("k"))
    return _Names(base, backups.where("k IS NOT NULL"))


def settle_renames(renames: DataFrame) -> DataFrame:
    """Which of ``renames`` (path, target) move in this round: a written table
    path, go, step. See the module's notes on who waits.

    A file whose target is held by another file that moves may move behind
    it, and so on along the chain path -> target; the chains are followed by
    pointer jumping, each round twice as far, so one of n files takes log2(n)
    rounds. ``step`` is the file's place behind the end of its chain: a round's
    moves are carried out by step. Files that lead into a circle wait."""
    firsts = renames.groupBy("target").agg(F.min("path").alias("path")).withColumn("_first", F.lit(True))
    movers = renames.select(F.col("path").alias("target"), F.lit(True).alias("_held"))
    r = renames.join(firsts, ["target", "path"], "left").join(movers, "target", "left")
    held = F.col("_held").isNotNull()
    r = materialize(
        r.select(
            "path", F.col("_first").isNotNull().alias("ok"), F.when(held, F.col("target")).alias("behind"), held.cast("int").alias("step"),
            F.regexp_replace("target", r"\.[^./]+\z", "").alias("_base"),
        )
    )
    waiting, before = r.where("behind IS NOT NULL").count(), None
    while waiting and waiting != before:
        ahead = r.select(F.col("path").alias("behind"), F.col("ok").alias("_ok"), F.col("behind").alias("_behind"), F.col("step").alias("_step"))
        j = r.join(ahead, "behind", "left")
        ok, step = F.col("ok") & F.coalesce("_ok", F.lit(True)), F.col("step") + F.coalesce("_step", F.lit(0))
        r = materialize(j.select("path", ok.alias("ok"), F.col("_behind").alias("behind"), step.alias("step"), "_base"))
        waiting, before = r.where("behind IS NOT NULL").count(), waiting
    r = r.withColumn("_free", F.col("ok") & F.col("behind").isNull())
    groups = r.groupBy("_base").agg(F.max("_free").alias("_any"), F.min("path").alias("_least"))
    # where all wait for each other, the first by path goes
    alone = ~F.col("_any") & (F.col("path") == F.col("_least"))
    return materialize(r.join(groups, "_base").select("path", (F.col("_free") | alone).alias("go"), F.when(F.col("_free"), F.col("step")).otherwise(F.lit(0)).alias("step")))


def _named_converts(converts: DataFrame, names: _Names, present: DataFrame, moved: DataFrame, opts: ProcessOptions) -> DataFrame:
    """``path`` and ``final``: the free name each convert gets (WIN-3). Only
    requests for a name that is taken, or asked for twice, are ranked.
    ``present``: the current names that are asked for, and maybe others."""
    req = converts.select("path", F.col("target").alias("dest"))
    own = converts.select("path")

    def taken(present: DataFrame) -> DataFrame:
        # with backups on, a source frees its own name first
        return present if opts.skip_backup else present.join(own, "path", "left_anti")

    targets = moved.select(F.col("target").alias("path"))
    held = taken(present.select("path")).unionByName(targets).distinct()
    counts = req.groupBy("dest").agg((F.count(F.lit(1)) > 1).alias("_several"))
    marked = req.join(counts, "dest").join(held.select(F.col("path").alias("dest"), F.lit(True).alias("_held")), "dest", "left")
    marked = materialize(marked.select("path", "dest", (F.col("_several") | F.col("_held").isNotNull()).alias("contested")))
    plain = marked.where("NOT contested").select("path", F.col("dest").alias("final"))
    contested = marked.where("contested").select("path", "dest")
    if contested.isEmpty():
        return plain
    existing = taken(names.all().select("path")).unionByName(targets).unionByName(plain.select(F.col("final").alias("path")))
    named = unique_names(contested, existing, "dest", "path", cut_input=False)
    return plain.unionByName(named.select("path", F.col("final_dest").alias("final")))


def _mark(state: DataFrame) -> tuple[int, int]:
    """How many files are to be processed, and a fingerprint of them."""
    low = F.xxhash64("path", "origin").bitwiseAND(F.lit((1 << 40) - 1))
    return tuple(state.agg(F.count(F.lit(1)), F.coalesce(F.sum(low), F.lit(0))).first())


def process_run(
    files: DataFrame,
    metadata_docs: DataFrame,
    probe: DataFrame,
    opts: ProcessOptions | None = None,
    ledger: DataFrame | None = None,
    trash: DataFrame | None = None,
    hasher=None,
) -> ProcessResult:
    """``files``: path, file_size, mtime_ticks; ``metadata_docs``: path,
    meta_json; ``probe``: path, duration_s, audio_codec."""
    opts = opts or ProcessOptions()
    start = _start(files, metadata_docs, probe, opts, ledger, trash, hasher)
    state = start.state
    names = _names(state)
    none = F.lit(None).cast("string")
    no_names = state.select("path", "origin", "content_id").limit(0)

    rounds: list[DataFrame] = []
    seen: set[tuple] = set()
    mark = None
    while not rounds or mark[0]:
        if mark in seen:
            raise RuntimeError(f"the files to process come back unchanged after {len(rounds)} rounds")
        seen.add(mark)
        decided = materialize(_with_requests(_decide(state, names, opts, ledger is not None)))
        kinds = {r["action"] for r in decided.select("action").distinct().collect()}  # four at most
        if "rename" in kinds:
            settled = settle_renames(decided.filter(F.col("action") == "rename").select("path", "target"))
            decided = decided.join(settled, "path", "left")
        else:
            decided = decided.withColumns({"go": F.lit(None).cast("boolean"), "step": F.lit(0)})
        go = F.coalesce(F.col("go"), F.lit(True))
        waiting, acting = decided.filter(~go), decided.filter(go)
        moved = acting.filter(F.col("action") == "rename")
        converts = acting.filter(F.col("action") == "convert")

        # names that become free, files that are in the way, backup names
        freed = acting.filter(F.col("action").isin("rename", "convert", "delete")).select("path")
        # (the listing is asked once in a round for the names of moves and converts)
        displaced = present = no_names
        if kinds & {"rename", "convert"}:
            asked = moved.unionByName(converts).select(F.col("target").alias("path")).distinct()
            present = materialize(names.among(asked))
        if "rename" in kinds:
            held = present.join(moved.select(F.col("target").alias("path")), "path", "left_semi")
            displaced = materialize(held.join(freed, "path", "left_anti"))
        backups = None
        if not opts.skip_backup and kinds & {"rename", "convert"}:
            backups = materialize(names.next_backups(displaced.select("path").unionByName(converts.select("path"))))

        if "convert" in kinds:
            acting = acting.join(_named_converts(converts, names, present, moved, opts), "path", "left")
            acting = acting.withColumn("target", F.coalesce("final", "target"))
        if backups is None or "convert" not in kinds:
            acting = acting.withColumn("backup", none)
        else:
            source = backups.select("path", F.col("backup_path").alias("backup"), F.lit("convert").alias("action"))
            acting = acting.join(source, ["path", "action"], "left")
        acting = acting.withColumn("tracker", F.concat("backup", F.lit(TRACKER_SUFFIX)))
        number = len(rounds) + 1
        step = F.coalesce("step", F.lit(0)).alias("step")
        rows = acting.select(F.lit(number).alias("round"), *STATE_COLUMNS, "rule", "action", "target", "backup", "tracker", "outcome", "reason", step)
        acting = materialize(rows)
        plan_rows = acting.select("round", "path", "origin", "action", "target", "backup", "tracker", "outcome", "reason", "step")
        put = acting.filter(F.col("outcome") == "Reprocess").select(F.col("target").alias("path"), "origin", "content_id")
        if "rename" in kinds:
            aside = displaced.withColumn("backup_path", none) if opts.skip_backup else displaced.join(backups, "path")
            plan_rows = plan_rows.unionByName(
                aside.select(
                    F.lit(number).alias("round"), "path", "origin", F.lit("delete" if opts.skip_backup else "backup").alias("action"),
                    F.col("backup_path").alias("target"), none.alias("backup"), none.alias("tracker"),
                    F.lit("Displaced").alias("outcome"), F.lit("displaced").alias("reason"), F.lit(0).alias("step"),
                )
            )
            if not opts.skip_backup:
                put = put.unionByName(aside.select(F.col("backup_path").alias("path"), "origin", none.alias("content_id")))
        rounds.append(plan_rows)

        again = acting.filter(F.col("outcome") == "Reprocess")
        if backups is not None and "convert" in kinds:
            sources = again.filter(F.col("backup").isNotNull())
            for name in ("backup", "tracker"):
                put = put.unionByName(sources.select(F.col(name).alias("path"), "origin", none.alias("content_id")))
        if kinds & {"rename", "convert", "delete"}:
            freed = acting.filter(F.col("action").isin("rename", "convert", "delete")).select("path")
            names = names.after(freed.unionByName(displaced.select("path")), put)

        converted = F.col("action") == "convert"
        renewed = again.select(
            F.col("target").alias("path"),
            "origin",
            F.lit(False).alias("in_trash"),
            F.lit(False).alias("skip"),
            "meta_ok",
            F.when(converted, F.lit(0)).otherwise(F.col("validate_errors")).alias("validate_errors"),
            F.when(converted, F.lit("mp4")).otherwise(F.col("meta_ext")).alias("meta_ext"),
            "content_id",
            F.when(converted, F.lit(False)).otherwise(F.col("dng_newer")).alias("dng_newer"),
            "duration_s",
            F.when(converted & (F.col("rule") != "remux"), F.lit("aac")).otherwise(F.col("audio_codec")).alias("audio_codec"),
        )
        if "rename" in kinds:
            renewed = renewed.unionByName(waiting.join(displaced.select("path"), "path", "left_anti").select(*STATE_COLUMNS))
        state = materialize(renewed)
        mark = _mark(state)

    plan = rounds[0]
    for r in rounds[1:]:
        plan = plan.unionByName(r)
    plan = plan.join(start.waves, "origin", "left").withColumn("wave", F.coalesce("wave", F.lit(0)))
    plan = plan.select("round", "path", "origin", "action", "target", "backup", "tracker", "outcome", "reason", "wave", "step")

    next_ledger = None
    if start.ledger is not None:
        final = plan.filter(F.col("outcome") != "Reprocess")
        deleted = final.filter((F.col("outcome") == "Deleted") & (F.col("reason") == "trashed")).select("path")
        done = final.filter(F.col("outcome") == "Success").select("path").distinct().withColumn("_done", F.lit(True))
        next_ledger = start.ledger.join(deleted, "path", "left_anti").join(done, "path", "left").select(
            *[c for c in LEDGER_COLUMNS if c != "is_processed"],
            (F.col("is_processed") | F.coalesce(F.col("_done"), F.lit(False))).alias("is_processed"),
        )
    return ProcessResult(plan=plan, renames=start.renames, ledger=next_ledger, listing=names.all().select("path", "origin"))


def process_summary(plan: DataFrame) -> DataFrame:
    """AGG-1 for process, counted like the command does: per plan row (a
    file renamed and then converted is modified twice), Reprocess and
    Modified together as ``n_modified``; ``total`` is the number of listed
    files. Status 2 when anything is invalid or failed."""
    from ..operators.summary import RUN_PARTIAL, RUN_SUCCESS

    o = F.col("outcome")
    s = plan.agg(
        F.count_distinct("origin").alias("total"),
        F.count_if(o == "Success").alias("n_success"),
        F.count_if(o.isin("Reprocess", "Modified")).alias("n_modified"),
        F.count_if(o == "Deleted").alias("n_deleted"),
        F.count_if(o == "Skipped").alias("n_skipped"),
        F.count_if(o == "Invalid").alias("n_invalid"),
        F.count_if(o == "Ignored").alias("n_ignored"),
        F.count_if(o == "Failed").alias("n_failed"),
    )
    bad = (F.col("n_invalid") > 0) | (F.col("n_failed") > 0)
    return s.withColumn("run_status", F.when(bad, F.lit(RUN_PARTIAL)).otherwise(F.lit(RUN_SUCCESS)))
