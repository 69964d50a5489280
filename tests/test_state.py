"""State by key, partial ledger merges, the listing source, hashing by bytes and observed summaries."""

import glob
import hashlib
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from mediacat import catalog
from mediacat.operators import ledger as led
from mediacat.operators.summary import observed_summary, run_summary
from mediacat.plans.index import index_run
from mediacat.schemas import FILES, LEDGER
from mediacat.sinks.partitioned_ledger import bucket_of, merge_ledger, read_partitioned_ledger, touched_rows, write_partitioned_ledger
from mediacat.sources import files as FI
from mediacat.sources import listing_source as LS
from mediacat.sources.files import dealt_by_bytes, file_hasher, list_files
from mediacat.sources.listing_source import Part, read_listing
from mediacat.streaming.keyed_index import apply_changes, changes_of, keyed_index, ledger_after, read_log


def folder(name):
    return tempfile.mkdtemp(prefix=f"mediacat-{name}-", dir="/tmp")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- keyed stream


def content(path, size):
    h = hashlib.sha256(f"{path} {size}".encode()).hexdigest()
    return h, h[:40]


def known(n, start=0):
    return [(f"/l/{i}.jpg", *content(f"/l/{i}.jpg", 10), 10, 1000 + i, i % 3 == 0) for i in range(start, start + n)]


def test_keyed_stream_equals_batch_runs_in_turn(spark):
    base = folder("keyed")
    ledger = spark.createDataFrame(known(40), LEDGER)
    batches = [
        # unchanged, touched only, new content, new, unsupported, unreadable, listed twice
        [("/l/0.jpg", 10, 1000), ("/l/1.jpg", 10, 1), ("/l/3.jpg", 10, 2), ("/l/2.jpg", 11, 3), ("/new.jpg", 10, 5), ("/x.txt", 1, 1), ("/bad.jpg", 1, 1), ("/twice.mov", 10, 1), ("/twice.mov", 12, 2)],
        [("/l/2.jpg", 11, 3), ("/l/2.jpg", 10, 9), ("/new.jpg", 10, 6), ("/twice.mov", 12, 2), ("/bad.jpg", 2, 2)],
        [(None, 1, 1), ("/l/39.jpg", None, None), ("/new.jpg", 10, 6)],
    ]
    paths = sorted({p for b in batches for p, _, _ in b if p})
    # a file's content never changes here but for the paths with several sizes
    table = [(p, *content(p, 11 if p == "/l/2.jpg" else 10)) for p in paths if p != "/bad.jpg"]
    hashes = spark.createDataFrame(table, "path string, sha256 string, sha1 string")
    for i, rows in enumerate(batches):
        listed = FILES if i < 2 else "path string, file_size long, mtime_ticks long"
        spark.createDataFrame(rows, listed).coalesce(1).write.parquet(f"{base}/in/b{i}")
        keyed_index(spark, base + "/in/*", ledger, base + "/log", base + "/ckpt", hashes=hashes)
    got = rows_of(ledger_after(ledger, read_log(spark, base + "/log")))
    log = read_log(spark, base + "/log")
    want, outcomes = ledger, []
    for rows in batches:
        # the batch rules for rows one after the other
        for p, size, ticks in sorted(rows, key=lambda r: (r[2] or 0, r[1] or 0)):
            if p is not None:
                one = index_run(spark.createDataFrame([(p, size, ticks)], FILES), want, led.table_hasher(hashes))
                outcomes += rows_of(one.outcomes)
                want = spark.createDataFrame(one.ledger.collect(), one.ledger.schema)
    assert got == rows_of(want)
    assert rows_of(log.select("path", "status", "was_processed")) == sorted(outcomes, key=str)
    # nothing new: nothing logged
    before = log.count()
    keyed_index(spark, base + "/in/*", ledger, base + "/log", base + "/ckpt", hashes=hashes)
    assert read_log(spark, base + "/log").count() == before


def test_keyed_stream_writes_what_a_batch_changes(spark):
    """The rows written depend on the batch, not on the ledger."""
    sizes = {}
    for n in (20, 2000):
        base = folder("keyed-size")
        spark.createDataFrame([("/l/1.jpg", 10, 1001), ("/l/2.jpg", 12, 7), ("/n.jpg", 10, 7)], FILES).coalesce(1).write.parquet(base + "/in/a")
        hashes = spark.createDataFrame([(p, *content(p, 12)) for p in ("/l/1.jpg", "/l/2.jpg", "/n.jpg")], "path string, sha256 string, sha1 string")
        keyed_index(spark, base + "/in/*", spark.createDataFrame(known(n), LEDGER), base + "/log", base + "/ckpt", hashes=hashes)
        log = read_log(spark, base + "/log")
        sizes[n] = (log.count(), rows_of(changes_of(log)))
    assert sizes[20] == sizes[2000] and sizes[20][0] == 3 and len(sizes[20][1]) == 2


def test_keyed_stream_hashes_files_that_changed(spark):
    base = folder("keyed-files")
    for name, data in (("a.jpg", b"one"), ("b.jpg", b"two"), ("c.jpg", b"three")):
        with open(f"{base}/{name}", "wb") as f:
            f.write(data)
    ledger = spark.createDataFrame([("/a.jpg", "kept", "kept", 3, 1, True), ("/b.jpg", "old", "old", 3, 1, True)], LEDGER)
    spark.createDataFrame([("/a.jpg", 3, 1), ("/b.jpg", 3, 2), ("/c.jpg", 5, 2), ("/gone.jpg", 5, 2)], FILES).write.parquet(base + "/in/a")
    keyed_index(spark, base + "/in/*", ledger, base + "/log", base + "/ckpt", prefix=base, mark_processed=True)
    log = {r.path: (r.status, r.sha256, r.is_processed) for r in read_log(spark, base + "/log").collect()}
    assert log == {
        "/a.jpg": ("Unchanged", "kept", True), "/b.jpg": ("Updated", hashlib.sha256(b"two").hexdigest(), False),
        "/c.jpg": ("Inserted", hashlib.sha256(b"three").hexdigest(), True), "/gone.jpg": ("Failed", None, None),
    }
    with pytest.raises(ValueError):
        keyed_index(spark, base, ledger, base, base)


def documents_in_files(spark, n):
    """A table folder whose documents lie in ``n`` files."""
    base = folder("documents")
    rows = [(i, f"text {i}", 5 + len(str(i))) for i in range(n * 8)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(n).write.parquet(base + "/documents.parquet")
    return base


def test_a_listing_of_many_files_is_one_keyed_batch(spark, monkeypatch):
    base = folder("keyed-many")
    spark.createDataFrame([(f"/l/{i}.jpg", 10, 1000 + i) for i in range(40)], FILES).repartition(8).write.parquet(base + "/in/a")
    hashes = spark.createDataFrame([(f"/l/{i}.jpg", *content(f"/l/{i}.jpg", 10)) for i in range(40)], "path string, sha256 string, sha1 string")
    keyed_index(spark, base + "/in/*", spark.createDataFrame(known(30), LEDGER), base + "/log", base + "/ckpt", hashes=hashes)
    assert len(glob.glob(base + "/ckpt/commits/[0-9]*")) == 1 and read_log(spark, base + "/log").count() == 40
    # the query: as many batches as parts arrive, whatever the number of their files
    made = []
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name, plain=catalog.scratch_path: made.append(plain(s, name)) or made[-1])
    rows = catalog.QUERIES["stream_index_keyed"](spark, documents_in_files(spark, 6))
    (checkpoint,) = (p for p in made if "keyed-ckpt" in p)
    assert len(glob.glob(checkpoint.removeprefix("file:") + "/commits/[0-9]*")) == 4 and rows.count() > 0


@pytest.mark.parametrize(("query", "versions"), [("stream_index_ledger", 4), ("stream_index_two_runs", 2)])
def test_a_landed_listing_is_one_ledger_version(spark, query, versions):
    """However many files it has: each version reads and writes the whole ledger."""
    base = documents_in_files(spark, 6)
    ledger = catalog.QUERIES[query](spark, base)
    (version,) = {re.search(r"/v=(\d+)/", f)[1] for f in ledger.inputFiles()}
    assert int(version) == versions and rows_of(ledger) == rows_of(catalog.QUERIES["index_ledger"](spark, base))


def test_trash_stream_adds_each_hash_once(spark):
    import base64
    import json

    from mediacat.streaming.trash_stream import read_added, trash_after, trash_stream

    root = folder("feed")
    sha = {k: base64.b64encode(hashlib.sha1(k.encode()).digest()).decode() for k in "abcdef"}

    def page(number, *items):
        body = {"assets": {"items": [{"id": n, "checksum": c, "originalFileName": n, "isTrashed": t} for n, c, t in items], "nextPage": str(number + 1)}}
        return number, json.dumps(body)

    def land(name, *pages):
        spark.createDataFrame(pages, "page long, body string").coalesce(1).write.parquet(f"{root}/in/{name}")
        trash_stream(spark, root + "/in/*", trash, root + "/added", root + "/ckpt")
        return {r.original_file_name for r in read_added(spark, root + "/added").collect()}

    trash = spark.createDataFrame([(hashlib.sha1(b"a").hexdigest(), "old")], "sha1 string, original_file_name string")
    first = page(1, ("a1", sha["a"], True), ("b1", sha["b"], True), ("b0", sha["b"], True), ("c1", sha["c"], False), ("bad", "??", True), ("none", None, True))
    assert land("1", first) == {"b1"}
    assert land("2", page(3, ("b3", sha["b"], True), ("d3", sha["d"], True)), page(2, ("d2", sha["d"], True))) == {"b1", "d2"}
    # a page landed again, an empty one, and one that is no document
    assert land("3", first, page(4), (5, "{"), page(6, ("c6", sha["c"], True))) == {"b1", "d2", "c6"}
    after = trash_after(trash, read_added(spark, root + "/added"))
    assert sorted(r.original_file_name for r in after.collect()) == ["b1", "c6", "d2", "old"]


# ---- partial merges


def snapshot_files(root):
    return {f: os.stat(f).st_ino for f in glob.glob(root + "/buckets=*/bucket=*/*.parquet")}


@pytest.mark.parametrize("merge", [led.insert_or_ignore, led.update_hashes, led.update_metadata, led.set_processed, led.delete_by_path, apply_changes])
def test_partial_merge_equals_the_whole_one(spark, merge):
    root = folder("parts") + "/ledger"
    ledger = spark.createDataFrame(known(300), LEDGER)
    changes = spark.createDataFrame(known(2, 50) + [("/l/7.jpg", "h", "s", 1, 2, True), ("/other.jpg", "h", "s", 1, 2, False)], LEDGER)
    write_partitioned_ledger(ledger, root, 16)
    before = snapshot_files(root)
    touched = merge_ledger(spark, root, changes, merge)
    assert rows_of(read_partitioned_ledger(spark, root)) == rows_of(merge(ledger, changes))
    after = snapshot_files(root)
    kept = {f: i for f, i in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert 0 < len(touched) <= 4 and len(kept) >= 10 and all(after.get(f) == i for f, i in kept.items())


def test_partial_merge_scans_touched_partitions_alone(spark):
    root = folder("scan") + "/ledger"
    write_partitioned_ledger(spark.createDataFrame(known(300), LEDGER), root, 16)
    changes = spark.createDataFrame(known(2), LEDGER)
    old, touched, buckets = touched_rows(spark, root, changes)
    text = old._sc._jvm.PythonSQLUtils.explainString(old._jdf.queryExecution(), "formatted")
    (filters,) = re.findall(r"PartitionFilters: \[(.*)\]", text)
    assert buckets == 16 and re.findall(r"\d+", filters.partition(" IN ")[2] or filters.rpartition("=")[2])[-len(touched) :] == [str(t) for t in touched]
    assert old.count() < 300 * len(touched) / 8


def test_partitions_may_become_empty_and_come_back(spark):
    root = folder("empty") + "/ledger"
    ledger = spark.createDataFrame(known(5), LEDGER)
    write_partitioned_ledger(ledger, root, 64)
    merge_ledger(spark, root, ledger.select("path"), led.delete_by_path)
    assert read_partitioned_ledger(spark, root).count() == 0 and not snapshot_files(root)
    merge_ledger(spark, root, ledger, led.insert_or_ignore)
    assert rows_of(read_partitioned_ledger(spark, root)) == rows_of(ledger)
    assert merge_ledger(spark, root, ledger.limit(0), led.insert_or_ignore) == []
    nulls = spark.createDataFrame([(None,)], "path string")
    assert merge_ledger(spark, root, nulls, led.delete_by_path) == []
    again = ledger.select("path", bucket_of(F.col("path"), 64).alias("b"))
    assert all(0 <= r.b < 64 for r in again.collect())
    with pytest.raises(FileNotFoundError):
        read_partitioned_ledger(spark, root + "-missing")
    # an empty ledger can be merged into
    none = folder("none") + "/ledger"
    write_partitioned_ledger(ledger.limit(0), none, 4)
    with pytest.raises(FileNotFoundError):
        merge_ledger(spark, none, ledger, led.insert_or_ignore)


# ---- listing source


def tree():
    root = folder("tree")
    for i in range(40):
        os.makedirs(f"{root}/wide", exist_ok=True)
        open(f"{root}/wide/.f{i}.jpg", "w").write("x" * i)
    for depth in range(5):
        at = f"{root}/deep/" + "/".join(["d"] * depth)
        os.makedirs(at, exist_ok=True)
        open(f"{at}/_n.mov", "w").close()
    os.makedirs(f"{root}/empty/er")
    open(f"{root}/top [1] ü.jpg", "w").close()
    return root


@pytest.mark.parametrize(("tasks", "slice_entries"), [(1, 10**6), (3, 7), (50, 1)])
def test_listing_source_equals_the_listing(spark, tasks, slice_entries):
    root = tree()
    want = rows_of(list_files(spark, "file:" + root, strip_prefix=root))
    got = read_listing(spark, "file:" + root, strip_prefix=root, tasks=tasks, slice_entries=slice_entries)
    assert rows_of(got) == want and len(want) == 46
    some = got.where(F.col("path").startswith("/wide/") & F.col("path").endswith("9.jpg") & (F.col("file_size") > 10))
    assert rows_of(some) == [r for r in want if r[0].startswith("/wide/") and r[0].endswith("9.jpg") and r[1] > 10]
    assert read_listing(spark, root + "/missing").count() == 0


def test_listing_source_pushes_filters_and_opens_only_what_can_match(spark, monkeypatch):
    root = tree()
    df = read_listing(spark, root, strip_prefix=root).where("path LIKE '/deep/d/%' AND path LIKE '%.mov'")
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "Filter" not in text.split("== Physical Plan ==")[1].split("(1)")[0]
    reader = LS.ListingReader({"root": root, "strip_prefix": root, "tasks": "1"})
    assert list(reader.pushFilters([LS.StringStartsWith(("path",), "/deep/d/"), LS.StringEndsWith(("path",), ".mov"), LS.StringStartsWith(("other",), "x")])) == [
        LS.StringStartsWith(("other",), "x")
    ]
    opened, plain = [], LS.entries
    monkeypatch.setattr(LS, "entries", lambda d: opened.append(d) or plain(d))
    found = [p for part in reader.partitions() for b in reader.read(part) for p in b.column(0).to_pylist()]
    assert sorted(found) == ["/deep/" + "d/" * i + "_n.mov" for i in range(1, 5)]
    assert not any("wide" in d or "empty" in d for d in opened)


def test_a_wide_directory_is_read_frame_by_frame(monkeypatch):
    """A million entries: planning cuts them into slices, a task holds one frame."""
    seen = 0

    def wide(directory):
        nonlocal seen
        for i in range(1_000_000):
            seen += 1
            yield LS.Entry(f"{directory}/{i}.jpg", False, lambda: (1, 2))

    monkeypatch.setattr(LS, "entries", wide)
    reader = LS.ListingReader({"root": "/r", "tasks": "8"})
    parts = reader.partitions()
    assert [p.slices for p in parts] == [10] * 10
    seen = 0
    first = next(reader.read(Part("/r")))
    assert first.num_rows == FI.LISTING_FRAME and seen == FI.LISTING_FRAME
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts[:3]]
    assert all(95_000 < s < 105_000 for s in sizes)


def test_planning_looks_at_a_bounded_number_of_entries(monkeypatch):
    def chain(directory):
        depth = directory.count("/")
        yield from (LS.Entry(f"{directory}/d{i}", True, None) for i in range(3 if depth < 6 else 0))
        yield LS.Entry(f"{directory}/f", False, lambda: (1, 2))

    monkeypatch.setattr(LS, "entries", chain)
    few = LS.ListingReader({"root": "/r", "tasks": "5"}).partitions()
    all_of = LS.ListingReader({"root": "/r", "tasks": "100000"})
    assert 5 <= len(few) <= 9
    for reader, parts in ((LS.ListingReader({"root": "/r"}), few), (all_of, all_of.partitions())):
        files = [p for part in parts for b in reader.read(part) for p in b.column(0).to_pylist()]
        assert len(files) == len(set(files)) == sum(3**i for i in range(6))


@pytest.mark.parametrize("planned", [10**6, 50])
def test_many_directories_do_not_make_many_tasks(monkeypatch, planned):
    """Two levels of 4 x 300 directories: about the wanted number of tasks, even ones."""

    def wide(directory):
        depth = directory.count("/")
        yield from (LS.Entry(f"{directory}/d{i}", True, None) for i in range({1: 4, 2: 300, 3: 0}[depth]))
        yield LS.Entry(f"{directory}/f", False, lambda: (1, 2))

    monkeypatch.setattr(LS, "entries", wide)
    monkeypatch.setattr(LS, "PLANNED", planned)  # 50: most of a level is not looked at
    reader = LS.ListingReader({"root": "/r", "tasks": "20"})
    parts = reader.partitions()
    files = [[p for b in reader.read(part) for p in b.column(0).to_pylist()] for part in parts]
    found = [p for f in files for p in f]
    assert 20 <= len(parts) <= 28 and max(map(len, files)) < 120
    assert len(found) == len(set(found)) == 1 + 4 + 4 * 300
    some = LS.ListingReader({"root": "/r", "tasks": "20"})
    list(some.pushFilters([LS.StringStartsWith(("path",), "/r/d1/d29")]))
    assert sum(b.num_rows for part in some.partitions() for b in some.read(part)) == 11


# ---- process at size


def test_trash_is_looked_up_before_the_state_is_joined(spark, monkeypatch):
    """The look-up reads its rows twice, so they are two columns of the index run and not
    the joined state; and the stand-in names are no second copy of the texts."""
    from mediacat.fixtures import fixtures
    from mediacat.plans import process

    given, plain = [], process.flag_member
    monkeypatch.setattr(process, "flag_member", lambda df, *a, **k: given.append(set(df.columns)) or plain(df, *a, **k))
    base = documents_in_files(spark, 3)
    out = catalog.QUERIES["process_first_round"](spark, base)
    assert given == [{"path", "sha1"}]
    fx = fixtures(spark, base)
    trash = {r.sha1 for r in fx.trash.collect()}
    gone = {r.path for r in fx.media_files.collect() if r.sha1 in trash} - {r.path for r in out.where("reason = 'ignored'").collect()}
    assert gone and {r.origin for r in out.where("reason = 'trashed'").collect()} == gone
    assert all(f.startswith("file://" + base) for f in fx.media_names.inputFiles())


# ---- hashing by bytes


def test_files_are_dealt_by_bytes(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 10, 10**3, 10**6, 2 * 10**7]) for _ in range(3000)]
    files = spark.createDataFrame([(f"/{i:05d}.jpg", s if s else None, i) for i, s in enumerate(sizes)], FILES)
    dealt = dealt_by_bytes(files.repartition(3), 16)
    per_task = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.coalesce("file_size", F.lit(0))).alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in per_task) == 3000 and len(per_task) == 16
    assert max(r.b for r in per_task) <= 2 * sum(sizes) / 16
    assert rows_of(dealt) == rows_of(files)
    assert dealt_by_bytes(files.limit(0), 4).count() == 0


# ---- observed summaries


def test_summary_is_counted_while_the_plan_is_written(spark):
    base = folder("observed")
    for i in range(20):
        open(f"{base}/{i}.jpg", "w").write(str(i))
    listing = spark.createDataFrame([(f"/{i}.jpg", 1, 5) for i in range(22)], FILES)
    opened = spark.sparkContext.accumulator(0)
    plain = file_hasher(base)

    def counting(df, need):
        def count(batches):
            for b in batches:
                opened.add(b.num_rows)
                yield b

        out = plain(df, need)
        return out.mapInArrow(count, out.schema)

    # rows that nothing has landed yet: a second evaluation would hash again
    hashed = counting(listing, F.lit(True)).withColumn("status", F.when(F.col("c_sha256").isNull(), "Failed").otherwise("Inserted"))
    got = observed_summary(hashed, "index", lambda df: df.write.parquet(base + "/out"), "status")
    assert opened.value == 22
    assert rows_of(got) == rows_of(run_summary(spark.read.parquet(base + "/out"), "index", "status")) == [(22, 20, 0, 0, 0, 2, 2)]
    assert got.dtypes == run_summary(hashed, "index", "status").dtypes
