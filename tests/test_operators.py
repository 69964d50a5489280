"""Operator tests against brute force on small inputs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediacat.operators.directories import empty_directories
from mediacat.operators.groups import case_conflicts, live_photo_pairs, stem_waves
from mediacat.operators.naming import unique_names
from mediacat.operators.ranking import first_in_group, group_ordinal, group_running_sums


def test_group_ordinal_matches_window_with_hot_key(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}", f"p{i:05d}", rnd.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, p string, v int")
    got = group_running_sums(df, ["k"], [F.col("p")], {"ord": F.lit(1), "run": F.col("v")}, num_partitions=16)
    w = Window.partitionBy("k").orderBy("p")
    ref = df.select("k", "p", F.row_number().over(w).alias("ord2"), F.sum("v").over(w).alias("run2"))
    bad = got.join(ref, ["k", "p"]).filter((F.col("ord") != F.col("ord2")) | (F.col("run") != F.col("run2")))
    assert got.count() == 3000 and bad.count() == 0
    # the hot key really is spread over several partitions
    ranged = df.repartitionByRange(16, "k", "p").filter(F.col("k") == "hot")
    assert ranged.select(F.spark_partition_id().alias("pid")).distinct().count() > 1


def test_first_in_group(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "z")], "h string, path string")
    got = {r.path: r.f for r in first_in_group(df, ["h"], "path", "f").collect()}
    assert got == {"x": False, "w": True, "z": True}


def _brute_unique(requests, existing):
    taken = set(existing) | {d for _, d in requests}
    out = {}
    groups = {}
    for pid, d in sorted(requests):
        groups.setdefault(d, []).append(pid)
    for d, pids in groups.items():
        import os

        directory, name = os.path.split(d)
        dot = name.rfind(".")
        ext = name[dot:] if dot >= 0 and dot < len(name) - 1 else ""
        stem = name[:dot] if dot >= 0 else name
        free = (f"{directory}/{stem}_{k}{ext}" for k in range(1, 10**6) if f"{directory}/{stem}_{k}{ext}" not in taken)
        for i, pid in enumerate(pids):
            out[pid] = d if (i == 0 and d not in existing) else next(free)
    return out


def test_unique_names_brute_force(spark):
    rnd = random.Random(3)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "b.mov", "c", "c_1", "d.tar.gz", "e."]
    requests = [(f"src{i:03d}", "/o/" + rnd.choice(names)) for i in range(60)]
    existing = ["/o/a.jpg", "/o/a_3.jpg", "/o/c_2", "/o/b_1.mov", "/o/d.tar_1.gz", "/o/zz.jpg"]
    req = spark.createDataFrame(requests, "path string, dest string")
    ex = spark.createDataFrame([(e,) for e in existing], "path string")
    got = {r.path: r.final_dest for r in unique_names(req, ex).collect()}
    assert got == _brute_unique(requests, existing)
    assert len(set(got.values())) == len(got)


def test_case_conflicts_and_waves(spark):
    files = spark.createDataFrame(
        [("/d/IMG.JPG",), ("/d/img.jpg",), ("/d/img_1.jpg",), ("/d/IMG.mov",), ("/d/notes.txt",), ("/d/x.heic",)], "path string"
    )
    got = {r.path: r.new_path for r in case_conflicts(files).collect()}
    assert got == {"/d/IMG.JPG": "/d/IMG_2.JPG", "/d/img.jpg": "/d/img_3.jpg"}
    waves = {r.path: r.wave for r in stem_waves(files).collect()}
    assert waves["/d/IMG.JPG"] == 0 and waves["/d/IMG.mov"] == 1 and waves["/d/img.jpg"] == 2
    assert waves["/d/notes.txt"] == 0 and waves["/d/x.heic"] == 0


def test_live_photo_pairs(spark):
    listing = spark.createDataFrame(
        [("/d/A.mov",), ("/d/A.JPG",), ("/d/A.jpeg",), ("/d/B_HEVC.mp4",), ("/d/B.heic",), ("/d/C.mov",)], "path string"
    )
    got = {r.path: r.companion for r in live_photo_pairs(listing, listing).collect()}
    assert got == {"/d/A.mov": "/d/A.JPG", "/d/B_HEVC.mp4": "/d/B.heic"}


def test_empty_directories(spark):
    dirs = spark.createDataFrame([(d,) for d in ["/r/a", "/r/a/b", "/r/a/b/c", "/r/k", "/r/k/l", "/r/m"]], "dir string")
    files = spark.createDataFrame([("/r/k/f.jpg",), ("/r/top.jpg",)], "path string")
    got = [(r.dir, r.depth) for r in empty_directories(dirs, files, "/r").collect()]
    assert got == [("/r/a/b/c", 4), ("/r/a/b", 3), ("/r/k/l", 3), ("/r/a", 2), ("/r/m", 2)]


def test_skew_safe_join_matches_plain_join(spark):
    from mediacat.operators.skew import skew_safe_join

    rows = [(f"p{i}", "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"k{i % 50}")) for i in range(2000)]
    big = spark.createDataFrame(rows, "path string, k string")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), ("zz", 4)], "k string, v int")
    unmatched_hot = spark.createDataFrame([("k1", 2)], "k string, v int")
    for how in ("left", "inner"):
        got = skew_safe_join(big, small, "k", how, unique="path", max_hot=4, fraction=None)
        ref = big.join(small, "k", how).select("path", "k", "v")
        assert sorted(map(tuple, got.select("path", "k", "v").collect()), key=str) == sorted(
            map(tuple, ref.collect()), key=str
        )
    # a hot key without a partner keeps its rows (left) and is spread, not lost
    got = skew_safe_join(big, unmatched_hot, "k", "left", unique="path", max_hot=4, fraction=0.2)
    assert got.count() == 2000 and got.filter("k = 'hot' AND v IS NULL").count() == 667


def test_hot_key_found_from_sample(spark):
    from mediacat.operators.skew import hot_keys

    rows = [("hot" if i % 3 == 0 else f"k{i}",) for i in range(30000)]
    df = spark.createDataFrame(rows, "k string")
    assert [r.k for r in hot_keys(df, "k", max_hot=1).collect()] == ["hot"]


def test_ranking_broadcast_is_bounded_by_partitions(spark):
    from mediacat.operators.ranking import boundary_offsets

    rows = [("hot" if i % 2 == 0 else f"k{i % 300}", f"p{i:06d}") for i in range(20000)]
    df = spark.createDataFrame(rows, "k string, p string").withColumn("_rs_v0", F.lit(1).cast("long"))
    n = 12
    ranged = df.repartitionByRange(n, "k", "p").withColumn("_rs_pid", F.spark_partition_id())
    offsets = boundary_offsets(ranged, ["k"], 1)
    got = offsets.collect()
    assert 0 < len(got) <= n
    assert sum(1 for r in got if r.k == "hot") >= 2  # the hot key continues over several partitions


def test_ordinals_of_many_rows_with_extra_columns(spark):
    """Large enough that the range sampler really samples, with columns the
    ranking does not use, and the result written out before it is compared."""
    from mediacat.operators.materialize import materialize

    n = 240_000
    df = spark.range(n, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(40)))).alias("k"),
        F.sha1(F.col("id").cast("string")).alias("p"),
        F.md5(F.col("id").cast("string")).alias("extra"),
        (F.col("id") % 11).alias("v"),
    )
    got = materialize(group_running_sums(df, ["k"], [F.col("p")], {"ord": F.lit(1), "run": F.col("v")}, num_partitions=16))
    w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = df.select("p", F.row_number().over(w).alias("ord2"), F.sum("v").over(w).alias("run2"))
    assert got.count() == n and set(got.columns) == {"k", "p", "extra", "v", "ord", "run"}
    assert got.join(ref, "p").where("ord = ord2 AND run = run2").count() == n
    whole = materialize(group_ordinal(df, [], [F.col("p")], num_partitions=16))
    ref = df.select("p", F.row_number().over(Window.orderBy("p")).alias("ord2"))
    assert whole.join(ref, "p").where("ordinal = ord2").count() == n


def test_unique_names_stay_distinct_at_size(spark):
    from mediacat.operators.materialize import materialize

    n = 200_000
    req = spark.range(n, numPartitions=5).select(
        F.format_string("s%07d", F.col("id")).alias("path"),
        F.concat(F.lit("/o/"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.pmod(F.xxhash64("id"), F.lit(60000)).cast("string")), F.lit(".jpg")).alias("dest"),
        F.md5(F.col("id").cast("string")).alias("extra"),
    )
    ex = spark.range(20_000).select(F.concat(F.lit("/o/"), F.pmod(F.xxhash64("id"), F.lit(60000)).cast("string"), F.lit("_1.jpg")).alias("path"))
    got = materialize(unique_names(req, ex))
    assert got.count() == n and got.select("final_dest").distinct().count() == n
    assert got.join(ex.withColumnRenamed("path", "final_dest"), "final_dest", "left_semi").count() == 0
