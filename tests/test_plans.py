"""Pipeline tests on small hand-made inputs (reference scenarios)."""

from pyspark.sql import functions as F

from mediacat.operators.ledger import table_hasher
from mediacat.plans.index import index_run
from mediacat.plans.trash_sync import trash_sync, visited_pages
from mediacat.plans.undo import undo_run
from mediacat.plans.verify import container_path
from mediacat.sources.verdicts import parse_verdict_lines

LEDGER_SCHEMA = "path string, sha256 string, sha1 string, file_size bigint, mtime_ticks bigint, is_processed boolean"


def test_index_statuses_and_mark_processed(spark):
    files = spark.createDataFrame(
        [("/n.jpg", 1, 1), ("/c.jpg", 2, 2), ("/t.jpg", 3, 9), ("/u.jpg", 4, 4), ("/tp.jpg", 5, 9), ("/x.txt", 1, 1)],
        "path string, file_size long, mtime_ticks long",
    )
    hashes = spark.createDataFrame(
        [("/n.jpg", "h1", "s1"), ("/c.jpg", "new", "s2"), ("/t.jpg", "h3", "s3b"), ("/u.jpg", "zz", "zz"), ("/tp.jpg", "h5", "s5")],
        "path string, sha256 string, sha1 string",
    )
    ledger = spark.createDataFrame(
        [("/c.jpg", "old", "s2", 2, 1, True), ("/t.jpg", "h3", "s3", 3, 3, False), ("/u.jpg", "h4", "s4", 4, 4, True),
         ("/tp.jpg", "h5", "s5", 5, 5, True), ("/gone.jpg", "h9", "s9", 9, 9, True)],
        LEDGER_SCHEMA,
    )
    res = index_run(files, ledger, table_hasher(hashes), mark_processed=True)
    got = {r.path: (r.status, r.was_processed) for r in res.outcomes.collect()}
    assert got == {
        "/n.jpg": ("Inserted", True),
        "/c.jpg": ("Updated", False),
        "/t.jpg": ("Updated", False),
        "/u.jpg": ("Unchanged", True),  # size and mtime equal: stored hash reused, not recomputed
        "/tp.jpg": ("Unchanged", True),
        "/x.txt": ("Ignored", None),
    }
    led = {r.path: r for r in res.ledger.collect()}
    assert led["/u.jpg"].sha256 == "h4" and led["/gone.jpg"].sha256 == "h9"
    assert led["/t.jpg"].sha1 == "s3b" and led["/t.jpg"].mtime_ticks == 9
    # replaying against the new ledger changes nothing
    again = index_run(files, res.ledger, table_hasher(hashes))
    assert {r.status for r in again.outcomes.filter(F.col("status") != "Ignored").collect()} == {"Unchanged"}


def _items(spark, rows):
    return spark.createDataFrame(
        rows, "page long, next_page string, id string, checksum string, original_file_name string, is_trashed boolean"
    )


def test_trash_pagination_follows_pointers(spark):
    import base64

    c = lambda b: base64.b64encode(bytes([b] * 20)).decode()
    rows = [
        (1, "3", "a1", c(1), "one.jpg", True),
        (2, "3", "a2", c(2), "never.jpg", True),  # not on the chain
        (3, "5", "a3", c(3), "three.jpg", True),
        (3, "5", "a3b", c(3), "dup.jpg", True),  # same sha1 later: ignored
        (5, "5", "a5", c(5), "five.jpg", True),  # next page not greater: partial
        (6, None, "a6", c(6), "six.jpg", True),
    ]
    items = _items(spark, rows)
    assert sorted(r.page for r in visited_pages(items).collect()) == [1, 3, 5]
    trash = spark.createDataFrame([("01" * 20, "old.jpg")], "sha1 string, original_file_name string")
    res = trash_sync(items, trash)
    t = res.totals.first()
    assert (t.fetched, t.inserted, t.total, t.partial, t.run_status) == (4, 2, 3, True, 2)
    names = {r.sha1: r.original_file_name for r in res.trash.collect()}
    assert names["03" * 20] == "three.jpg" and names["01" * 20] == "old.jpg"


def test_trash_pagination_stops_at_empty_page(spark):
    items = _items(spark, [(1, "2", "a", None, "x", True), (3, None, "b", None, "y", True)])
    assert [r.page for r in visited_pages(items).collect()] == [1]
    assert trash_sync(items, spark.createDataFrame([], "sha1 string, original_file_name string")).totals.first().partial is False


def test_verdicts_and_mapping(spark):
    lines = spark.createDataFrame(
        [
            (1, '  {"path":"/media/a.jpg","ok":false,"error":"x"}'),
            (2, "(node:1) Warning: deprecated"),
            (3, '{"path":"/media/a.jpg","ok":true,"via":"decode","extra":1}'),
            (4, '{"path":"/photoc'),
            (5, '{"ok":true}'),
        ],
        "line_no long, line string",
    )
    got = {r.path: r.ok for r in parse_verdict_lines(lines).collect()}
    assert got == {"/media/a.jpg": True}
    paths = ["/lib/a.jpg", "/lib-other/a.jpg", "/lib/../etc/a.jpg", "/lib/..name/a.jpg", "/lib/x\ny.jpg", "/other/a.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.c for r in df.select("path", container_path("path", "/lib", "/media").alias("c")).collect()}
    assert got == {
        "/lib/a.jpg": "/media/a.jpg",
        "/lib-other/a.jpg": None,
        "/lib/../etc/a.jpg": None,
        "/lib/..name/a.jpg": "/media/..name/a.jpg",
        "/lib/x\ny.jpg": None,
        "/other/a.jpg": None,
    }


def test_undo_scenarios(spark):
    listing = spark.createDataFrame(
        [
            ("/d/a.jpg", 5), ("/d/a.jpg.bak", 0), ("/d/a.jpg.bak1", 7), ("/d/a.jpg.bak2", 8),  # restore .bak1
            ("/d/v.avi.bak", 9), ("/d/v.avi.bak.out", 1), ("/d/v_1.mp4", 9),  # tracker names the output
            ("/d/w.mkv.bak", 9), ("/d/w.mp4", 9),  # no tracker: same-stem mp4
            ("/d/e.jpg.bak", 0),  # only empty backups: failed
            ("/d/p.jpg", 1), ("/d/p.jpg.bak", 1), ("/d/p.png.bak", 1),  # stem peer + base exists: derived
        ],
        "path string, file_size long",
    )
    trackers = spark.createDataFrame([("/d/v.avi.bak", " /d/v_1.mp4\n")], "backup_path string, output_path string")
    res = undo_run(listing, trackers)
    plan = {(r.action, r.path) for r in res.plan.collect()}
    assert ("restore", "/d/a.jpg.bak1") in plan and ("delete_current", "/d/a.jpg") in plan
    assert ("delete", "/d/a.jpg.bak") in plan and ("delete", "/d/a.jpg.bak2") in plan
    assert ("delete", "/d/v.avi.bak.out") in plan and ("delete", "/d/v_1.mp4") in plan
    assert ("delete", "/d/w.mp4") in plan
    assert ("delete", "/d/p.jpg") in plan and ("delete", "/d/p.jpg.bak") in plan
    assert ("restore", "/d/p.png.bak") in plan  # p.png does not exist: not derived
    s = res.summary.first()
    assert (s.restored, s.failed, s.run_status) == (4, 1, 2)


def test_import_scenarios(spark):
    from mediacat.operators.ledger import table_hasher
    from mediacat.plans.import_plan import ImportOptions, import_run

    files = spark.createDataFrame(
        [("/s/a/IMG_20200101_101010.jpg", 1, 1), ("/s/b/IMG_20200101_101010.jpg", 2, 2), ("/s/c/copy.jpg", 3, 3),
         ("/s/d/undated.png", 4, 4), ("/s/e/bad.jpg", 5, 5), ("/s/notes.txt", 6, 6), ("/s/f/seen.jpg", 7, 7)],
        "path string, file_size long, mtime_ticks long",
    )
    hashes = spark.createDataFrame(
        [("/s/a/IMG_20200101_101010.jpg", "h1", "s1"), ("/s/b/IMG_20200101_101010.jpg", "h2", "s2"),
         ("/s/c/copy.jpg", "h1", "s1"), ("/s/d/undated.png", "h4", "s4"), ("/s/e/bad.jpg", "h5", "s5"),
         ("/s/f/seen.jpg", "h7", "s7")],
        "path string, sha256 string, sha1 string",
    )
    docs = spark.createDataFrame(
        [("/s/a/IMG_20200101_101010.jpg", '{"File:FileTypeExtension":"jpg"}'),
         ("/s/b/IMG_20200101_101010.jpg", '{"File:FileTypeExtension":"jpg"}'),
         ("/s/c/copy.jpg", '{"File:FileTypeExtension":"jpg"}'),
         ("/s/d/undated.png", '{"File:FileTypeExtension":"png"}'),
         ("/s/e/bad.jpg", '{"ExifTool:Validate":"1 Error"}'),
         ("/s/f/seen.jpg", '{}')],
        "path string, meta_json string",
    )
    ledger = spark.createDataFrame([("/old/x.jpg", "h7", "s7", 1, 1, False)], LEDGER_SCHEMA)
    empty = spark.createDataFrame([], "sha1 string, original_file_name string")
    res = import_run(files, docs, table_hasher(hashes), ImportOptions(as_of_year=2024, tag_root="/s", tags="t1"),
                     import_ledger=ledger, trash=empty, existing=spark.createDataFrame([], "path string"))
    got = {r.path: (r.outcome, r.dest) for r in res.plan.collect()}
    assert got["/s/a/IMG_20200101_101010.jpg"] == ("Imported", "2020/01/01/IMG_20200101_101010.jpg")
    assert got["/s/b/IMG_20200101_101010.jpg"] == ("Imported", "2020/01/01/IMG_20200101_101010_1.jpg")
    assert got["/s/c/copy.jpg"][0] == "Skipped"  # same content as an earlier file of this run
    assert got["/s/d/undated.png"] == ("Imported", "0001/01/01/undated.png")
    assert got["/s/e/bad.jpg"][0] == "Invalid"
    assert got["/s/notes.txt"][0] == "Ignored"
    assert got["/s/f/seen.jpg"][0] == "Skipped"  # content already in the import ledger
    led = {r.path for r in res.ledger.collect()}
    assert "/s/a/IMG_20200101_101010.jpg" in led and "/old/x.jpg" in led and "/s/c/copy.jpg" not in led


def _process(spark, files, **options):
    """files: path -> (file type, duration, audio codec)."""
    from mediacat.plans.process import ProcessOptions, process_run

    listing = spark.createDataFrame([(p, 1, 1) for p in files], "path string, file_size long, mtime_ticks long")
    docs = [(p, '{"File:FileTypeExtension":"%s"}' % x[0] if x[0] else "{}") for p, x in files.items()]
    meta = spark.createDataFrame(docs, "path string, meta_json string")
    probe = spark.createDataFrame([(p, x[1], x[2]) for p, x in files.items()], "path string, duration_s double, audio_codec string")
    result = process_run(listing, meta, probe, ProcessOptions(**options))
    return result.plan.collect(), {r.path: r.origin for r in result.listing.collect()}, result.listing.count()


def test_process_gives_no_two_files_one_name(spark):
    files = {
        "/l/a.avi": ("AVI", 9.0, "mp3"), "/l/a.Mkv": ("MKV", 9.0, "aac"),  # both become a.mp4
        "/l/c.jpg": ("png", None, None), "/l/c.png": ("png", None, None),  # c.jpg asks for a held name
        "/l/d.gif": ("png", None, None), "/l/d.jpg": ("png", None, None), "/l/d.tif": ("png", None, None),  # three ask for d.png
        "/l/s.jpg": ("png", None, None), "/l/s.png": ("jpg", None, None),  # each asks for the other's name
        "/l/v.mp4": ("mp4", 60.0, "pcm_s16le"), "/l/v.mp4.bak": (None, None, None), "/l/v.mp4.bak1": (None, None, None),
        "/l/ok.jpg": ("jpg", None, None), "/l/notes.txt": (None, None, None),
    }
    plan, final, rows = _process(spark, files)
    assert rows == len(final)  # every name once
    assert set(files) <= set(final.values())  # every file is somewhere
    displaced = {r.path: r.target for r in plan if r.action == "backup"}
    held, taken = set(files), []
    for rnd in sorted({r.round for r in plan}):
        now = [r for r in plan if r.round == rnd]
        moves = [r for r in now if r.action in ("rename", "convert")]
        leaving = {r.path for r in moves} | {r.path for r in now if r.action in ("delete", "backup")}
        for r in moves:
            assert r.target not in held or r.target in leaving, r
            taken.append(r.target)
        held = (held - leaving) | {r.target for r in now if r.target} | {r.backup for r in now if r.backup} | {r.tracker for r in now if r.tracker}
        assert len([r.target for r in moves]) == len({r.target for r in moves})
    assert held == set(final)
    assert displaced["/l/c.png"] == "/l/c.png.bak" and "/l/s.png" in displaced
    assert final["/l/c.png"] == "/l/c.jpg" and final["/l/c.png.bak"] == "/l/c.png"
    assert sorted(final[p] for p in final if p.startswith("/l/d.png")) == ["/l/d.gif", "/l/d.jpg", "/l/d.tif"]
    converted = {r.origin: (r.target, r.backup, r.tracker) for r in plan if r.action == "convert"}
    assert converted["/l/v.mp4"] == ("/l/v.mp4", "/l/v.mp4.bak2", "/l/v.mp4.bak2.out")
    assert {t for o, (t, _, _) in converted.items() if o.startswith("/l/a.")} == {"/l/a.mp4", "/l/a_1.mp4"}


def test_chains_of_waiting_moves_settle_in_few_rounds(spark, monkeypatch):
    """a -> b -> c ...: 1,000 moves in one round, found by pointer jumping."""
    from mediacat.plans import process as P

    landed = []
    plain = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df: landed.append(1) or plain(df))
    n = 1000
    rows = [(f"/d/x.{i:04d}", f"/d/x.{i + 1:04d}") for i in range(n)]
    got = {r.path: (r.go, r.step) for r in P.settle_renames(spark.createDataFrame(rows, "path string, target string")).collect()}
    assert got == {f"/d/x.{i:04d}": (True, n - 1 - i) for i in range(n)}
    assert len(landed) <= 12 + 1  # eleven jumps, the start and the result


def test_who_waits(spark):
    from mediacat.plans.process import settle_renames

    rows = [
        ("/a.1", "/a.2"), ("/a.2", "/a.3"), ("/b.1", "/b.9"), ("/b.2", "/b.9"), ("/b.3", "/b.1"), ("/b.4", "/b.2"),
        ("/c.1", "/c.2"), ("/c.2", "/c.1"), ("/e.1", "/e.2"), ("/e.2", "/e.3"), ("/e.3", "/e.2"), ("/f.1", "/f.9"),
    ]
    got = {r.path: (r.go, r.step) for r in settle_renames(spark.createDataFrame(rows, "path string, target string")).collect()}
    assert got == {
        "/a.1": (True, 1), "/a.2": (True, 0),  # a chain
        "/b.1": (True, 0), "/b.2": (False, 0), "/b.3": (True, 1), "/b.4": (False, 0),  # rivals, and those behind them
        "/c.1": (True, 0), "/c.2": (False, 0),  # a circle: the first goes
        "/e.1": (True, 0), "/e.2": (False, 0), "/e.3": (False, 0),  # into a circle
        "/f.1": (True, 0),
    }


def test_backup_numbers_against_brute_force(spark):
    import random

    from mediacat.plans.process import next_backup_names

    rnd = random.Random(5)
    taken = {f"/p{i}": {k for k in range(30) if rnd.random() < rnd.choice([0, 0.5, 0.95])} for i in range(60)} | {"/big": {0, 1, 2**63 - 1}}
    listing = [(p + ".bak" + (str(k) if k else ""),) for p, ks in taken.items() for k in ks] + [("/p1.bak99999999999999999999",), ("/x.jpg",)]
    got = {r.path: r.backup_path for r in next_backup_names(spark.createDataFrame([(p,) for p in taken] * 2, "path string"), spark.createDataFrame(listing, "path string")).collect()}
    for p, ks in taken.items():
        k = next(k for k in range(99) if k not in ks)
        assert got[p] == p + ".bak" + (str(k) if k else "")
    assert len(got) == len(taken)


def test_process_writes_no_listing_after_the_first_round(spark, monkeypatch):
    """A round lands what it changes: rows do not grow with the library."""
    import json

    from mediacat.plans import process as P

    def run(extra):
        names = ["/l/a.JpG", "/l/b.mkv", "/l/b.mp4", "/l/c.Mov"] + [f"/l/f{i}.jpg" for i in range(extra)]
        types = {".JpG": "jpg", ".mkv": "mkv", ".mp4": "mp4", ".Mov": "mov", ".jpg": "jpg"}
        files = spark.createDataFrame([(p, 1, 1) for p in names], "path string, file_size long, mtime_ticks long")
        docs = [(p, json.dumps({"SourceFile": p, "File:FileTypeExtension": types["." + p.rsplit(".", 1)[1]]})) for p in names]
        meta = spark.createDataFrame(docs, "path string, meta_json string")
        probe = spark.createDataFrame([(p, 9.0, "aac") for p in names], "path string, duration_s double, audio_codec string")
        sizes, plain = [], P.materialize

        def landing(df):
            out = plain(df)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(P, "materialize", landing)
        plan = P.process_run(files, meta, probe).plan.collect()
        monkeypatch.setattr(P, "materialize", plain)
        return sizes, sorted((r.path, r.action, r.target or "") for r in plan if r.action != "none")

    few, want = run(2)
    many, got = run(300)
    assert got == want and len(few) == len(many)
    # what grows with the library: the state, its decisions and the first round's plan
    assert sum(a != b for a, b in zip(few, many, strict=True)) <= 3


def test_process_without_backups_deletes_what_is_in_the_way(spark):
    files = {"/l/c.jpg": ("png", None, None), "/l/c.png": ("png", None, None), "/l/b.avi": ("AVI", 9.0, "mp3")}
    plan, final, rows = _process(spark, files, skip_backup=True)
    assert final == {"/l/c.png": "/l/c.jpg", "/l/b.mp4": "/l/b.avi"} and rows == 2
    assert [(r.path, r.action, r.reason) for r in plan if r.outcome == "Displaced"] == [("/l/c.png", "delete", "displaced")]
    assert all(r.backup is None and r.tracker is None for r in plan)


def test_feed_ends_at_an_empty_page(spark):
    from mediacat.plans.trash_sync import trash_sync

    items = [(1, "2", "a", "c", "x"), (2, "3", None, None, None), (3, None, "b", "d", "y")]
    feed = spark.createDataFrame([(*r, True) for r in items], "page long, next_page string, id string, checksum string, original_file_name string, is_trashed boolean")
    result = trash_sync(feed, spark.createDataFrame([], "sha1 string, original_file_name string"))
    totals = result.totals.first()
    assert totals.fetched == 1 and not totals.partial and {r.page for r in result.pages.collect()} == {1, 2}


def test_verify_reports_errors_and_files_that_are_gone(spark):
    from mediacat.plans.verify import verify_run

    files = spark.createDataFrame([(f"/l/{n}.jpg", 1, 1) for n in "abcd"], "path string, file_size long, mtime_ticks long")
    lines = [(i, '{"path":"/m/%s.jpg","ok":%s,"error":"e%s"}' % (n, str(n == "a").lower(), n)) for i, n in enumerate("abc")]
    verdicts = spark.createDataFrame(lines, "line_no long, line string")
    there = spark.createDataFrame([("/l/a.jpg",), ("/l/b.jpg",), ("/l/d.jpg",)], "path string")
    got = {r.path: (r.outcome, r.error) for r in verify_run(files, verdicts, "/l", "/m", still_there=there).outcomes.collect()}
    assert got == {"/l/a.jpg": ("Verified", None), "/l/b.jpg": ("Invalid", "eb"), "/l/c.jpg": ("Failed", None), "/l/d.jpg": ("Failed", None)}


def test_names_keep_line_breaks(spark):
    from mediacat.operators.groups import case_conflicts

    files = spark.createDataFrame([("/l/a\nb/C.jpg",), ("/l/a\nb/c.JPG",)], "path string")
    assert {r.new_path for r in case_conflicts(files).collect()} == {"/l/a\nb/C_1.jpg", "/l/a\nb/c_2.JPG"}
