"""Sources, snapshot sinks and the streaming index on temporary folders."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mediacat.operators.ledger import table_hasher
from mediacat.sinks import snapshots as SN
from mediacat.sources.files import file_hasher, hash_files, list_files, read_trackers
from mediacat.sources.trash_feed import parse_feed_pages
from mediacat.streaming.stream_index import start_ledger, stream_index

LEDGER_SCHEMA = "path string, sha256 string, sha1 string, file_size bigint, mtime_ticks bigint, is_processed boolean"


def _tree():
    root = tempfile.mkdtemp(prefix="mediacat-test-", dir="/tmp")
    files = {"a/one.jpg": b"hello", "a/b/two words.mov": b"x" * 200000, "c/+plus.jpg": b"", "v.avi.bak.out": b" /o/v_1.mp4\n"}
    for rel, data in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as fh:
            fh.write(data)
    return root, files


def test_listing_and_hashing(spark):
    root, files = _tree()
    listing = list_files(spark, "file:" + root, strip_prefix=root)
    got = {r.path: r.file_size for r in listing.collect()}
    assert got == {"/" + k: len(v) for k, v in files.items()}
    assert all(r.mtime_ticks > 621355968000000000 for r in listing.collect())
    hashed = {r.path: (r.sha256, r.sha1) for r in hash_files(listing.select("path"), root).collect()}
    for k, v in files.items():
        assert hashed["/" + k] == (hashlib.sha256(v).hexdigest(), hashlib.sha1(v).hexdigest())
    # rows that do not need hashing are not opened; missing files give nulls
    df = spark.createDataFrame([("/a/one.jpg", False), ("/missing.jpg", True)], "path string, need boolean")
    out = {r.path: r.c_sha256 for r in file_hasher(root)(df, F.col("need")).collect()}
    assert out == {"/a/one.jpg": None, "/missing.jpg": None}


def test_deep_and_lopsided_trees_are_listed_whole(spark, monkeypatch):
    from mediacat.sources import files as FI

    monkeypatch.setattr(FI, "LISTING_FRAME", 3)
    root = tempfile.mkdtemp(prefix="mediacat-deep-", dir="/tmp")
    want = set()
    for depth in range(6):
        folder = "/".join(["d"] * depth)
        os.makedirs(f"{root}/{folder}", exist_ok=True)
        for i in range(10):
            open(f"{root}/{folder}/.f {i}.out" if i % 2 else f"{root}/{folder}/f{i}", "w").close()
            want.add("/" + f"{folder}/.f {i}.out".lstrip("/") if i % 2 else "/" + f"{folder}/f{i}".lstrip("/"))
    os.makedirs(f"{root}/empty/er")
    got = [r.path for r in list_files(spark, "file:" + root, strip_prefix=root).collect()]
    assert sorted(got) == sorted(want)
    assert list_files(spark, root + "/missing").count() == 0


def test_hasher_keeps_ticks_exact_and_opens_each_file_once(spark):
    from mediacat.plans.index import index_run

    root, files = _tree()
    media = [f"/{k}" for k in files if not k.endswith(".out")] + ["/gone.jpg"]
    ticks = {p: 638396640000000000 + 2 + i for i, p in enumerate(media)}
    listing = spark.createDataFrame([(p, 5, t) for p, t in ticks.items()], "path string, file_size long, mtime_ticks long")
    known = spark.createDataFrame([("/a/one.jpg", "h", "s", 5, ticks["/a/one.jpg"], True)], LEDGER_SCHEMA)
    opened = spark.sparkContext.accumulator(0)
    plain = file_hasher(root)

    def counting(df, need):
        def count(batches):
            for b in batches:
                opened.add(b.num_rows)
                yield b

        out = plain(df, need)
        todo = out.filter("c_sha256 IS NOT NULL")
        return todo.mapInArrow(count, todo.schema).unionByName(out.filter("c_sha256 IS NULL"))

    result = index_run(listing, known, counting)
    led = {r.path: r for r in result.ledger.collect()}
    status = {r.path: r.status for r in result.outcomes.collect()}
    assert {p: r.mtime_ticks for p, r in led.items()} == {p: t for p, t in ticks.items() if p != "/gone.jpg"}
    assert led["/a/one.jpg"].sha256 == "h" and led["/a/b/two words.mov"].sha256 == hashlib.sha256(files["a/b/two words.mov"]).hexdigest()
    assert status == {"/a/one.jpg": "Unchanged", "/a/b/two words.mov": "Inserted", "/c/+plus.jpg": "Inserted", "/gone.jpg": "Failed"}
    assert opened.value == 2


def test_later_verdict_files_win(spark):
    from mediacat.sources.verdicts import read_verdict_lines

    base = tempfile.mkdtemp(prefix="mediacat-verdicts-", dir="/tmp")
    noise = "noise\n" * 3000
    for name, lines in {
        "run-1.log": noise + '{"path":"/p","ok":false,"error":"old"}\n{"path":"/q","ok":true}\n',
        "run-2.log": '{"path":"/q","ok":false,"error":"first"}\n{"path":"/q","ok":false,"error":"new"}\n{"path":"/p","ok":true}\n' + noise * 30,
    }.items():
        with open(f"{base}/{name}", "w") as fh:
            fh.write(lines)
    got = {r.path: (r.ok, r.error) for r in read_verdict_lines(spark, base).collect()}
    assert got == {"/p": (True, None), "/q": (False, "new")}


def test_archive_keeps_rows_in_few_files(spark):
    root = tempfile.mkdtemp(prefix="mediacat-archive-", dir="/tmp") + "/archive"
    rows = [(f"/s/{i}", f"2020/01/{i % 3 + 1:02d}/f{i}.jpg", 638396640000000001 + i, "[]") for i in range(300)]
    SN.write_archive(spark.createDataFrame(rows, "path string, dest string, mtime_ticks long, tags string").repartition(7), root)
    back = SN.read_snapshot(spark, root)
    assert sorted((r.path, r.dest, r.mtime_ticks, r.tags) for r in back.collect()) == sorted(rows)
    assert len(back.inputFiles()) == 3


def test_read_trackers(spark):
    root, _ = _tree()
    got = [(r.backup_path, r.output_path) for r in read_trackers(spark, root, strip_prefix=root).collect()]
    assert got == [("/v.avi.bak", "/o/v_1.mp4")]


def test_hidden_trackers_are_read(spark):
    root = tempfile.mkdtemp(prefix="mediacat-trackers-", dir="/tmp")
    files = {"_MG_0001.mov.bak": "/o/_MG_0001.mp4", ".hid/a b+c%20.avi.bak": "/o/a b.mp4", "_d/.x.avi.bak": "/o/ü.mp4", "v.avi.bak": ""}
    for rel, output in files.items():
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}.out", "w", encoding="utf-8") as fh:
            fh.write(f" {output}\n")
    for at in (root, "file:" + root):
        got = {r.backup_path: r.output_path for r in read_trackers(spark, at, strip_prefix=root).collect()}
        assert got == {f"/{rel}": output for rel, output in files.items()}


def test_snapshots_are_versioned(spark):
    root = tempfile.mkdtemp(prefix="mediacat-snap-", dir="/tmp") + "/ledger"
    with pytest.raises(FileNotFoundError):
        SN.read_ledger(spark, root)
    v0 = spark.createDataFrame([("/a", "h", "s", 1, 1, False)], LEDGER_SCHEMA)
    assert SN.write_ledger(v0, root) == 0
    # a new version is written from the current one (never overwriting what is read)
    cur = SN.read_ledger(spark, root)
    assert SN.write_ledger(cur.withColumn("is_processed", F.lit(True)), root) == 1
    assert SN.read_ledger(spark, root).first().is_processed is True
    assert SN.read_snapshot(spark, root, 0).first().is_processed is False
    with pytest.raises(ValueError):
        SN.write_snapshot(spark.createDataFrame([("/a",)], "path string"), root + "-bad")
        SN.read_ledger(spark, root + "-bad")


def test_feed_page_documents(spark):
    pages = spark.createDataFrame(
        [
            (1, '{"assets":{"items":[{"id":"a","checksum":"q6s=","originalFileName":"x.jpg","isTrashed":true}],"nextPage":"2"}}'),
            (2, '{"assets":{"items":[],"nextPage":null}}'),
        ],
        "page long, body string",
    )
    rows = parse_feed_pages(pages).orderBy("page").collect()
    assert [(r.page, r.id, r.next_page) for r in rows] == [(1, "a", "2"), (2, None, None)]


def test_stream_index_batches_and_replay(spark):
    base = tempfile.mkdtemp(prefix="mediacat-stream-", dir="/tmp")
    listing = spark.createDataFrame(
        [("/n.jpg", 1, 1), ("/u.jpg", 2, 2), ("/c.jpg", 3, 3)], "path string, file_size long, mtime_ticks long"
    )
    hashes = spark.createDataFrame([("/n.jpg", "h1", "s1"), ("/u.jpg", "h2", "s2"), ("/c.jpg", "h3", "s3")], "path string, sha256 string, sha1 string")
    listing.filter("path = '/n.jpg'").coalesce(1).write.parquet(base + "/in/b0")
    listing.filter("path <> '/n.jpg'").coalesce(1).write.parquet(base + "/in/b1")
    root = base + "/ledger"
    start_ledger(spark.createDataFrame([("/u.jpg", "h2", "s2", 2, 2, True), ("/c.jpg", "old", "s", 3, 0, True)], LEDGER_SCHEMA), root)
    outcomes = base + "/outcomes"
    ckpt = base + "/ckpt"
    stream_index(spark, base + "/in/*", root, table_hasher(hashes), checkpoint_location=ckpt, outcomes_root=outcomes)
    assert SN.current_version(spark, root) == 2
    got = {r.path: r.sha256 for r in SN.read_ledger(spark, root).collect()}
    assert got == {"/n.jpg": "h1", "/u.jpg": "h2", "/c.jpg": "h3"}
    # running again with the same checkpoint finds nothing new
    stream_index(spark, base + "/in/*", root, table_hasher(hashes), checkpoint_location=ckpt)
    assert SN.current_version(spark, root) == 2


def test_streams_in_turn_lose_nothing(spark):
    """Each stream has a checkpoint of its own and the ledger already has versions."""
    base = tempfile.mkdtemp(prefix="mediacat-runs-", dir="/tmp")
    root = base + "/ledger"
    start_ledger(spark.createDataFrame([], LEDGER_SCHEMA), root)
    for run in range(3):
        paths = [(f"/{run}{i}.jpg", i, i) for i in range(4)]
        hashes = spark.createDataFrame([(p, "h" + p, "s" + p) for p, _, _ in paths], "path string, sha256 string, sha1 string")
        for i, row in enumerate(paths):
            spark.createDataFrame([row], "path string, file_size long, mtime_ticks long").coalesce(1).write.parquet(f"{base}/{run}/b{i}")
        stream_index(spark, f"{base}/{run}/*", root, table_hasher(hashes), files_per_batch=3)
    assert SN.read_ledger(spark, root).count() == 12


def test_replayed_batch_is_known_by_its_tag(spark):
    root = tempfile.mkdtemp(prefix="mediacat-tag-", dir="/tmp") + "/ledger"
    df = spark.createDataFrame([("/a", "h", "s", 1, 1, False)], LEDGER_SCHEMA)
    assert SN.write_snapshot(df, root, tag="stream-x 0") == 0 and SN.current_tag(spark, root) == "stream-x 0"
    assert SN.write_snapshot(df, root) == 1 and SN.current_tag(spark, root) is None
    assert not os.path.exists(root + "/_CURRENT.1.tmp")


def test_landed_tables_go_with_their_scope(spark):
    from mediacat.operators.materialize import landing, materialize

    before = materialize(spark.range(3))
    with landing(spark):
        inside = materialize(spark.range(5))
        path = inside.inputFiles()[0]
        with landing(spark):
            pass
        assert inside.count() == 5
    assert before.count() == 3 and not os.path.exists(path.removeprefix("file://"))
