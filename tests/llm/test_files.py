"""WARC files, sharding and mixing."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.invented import prose
from mediacat.llm import warc
from mediacat.llm.catalog import MIX_WEIGHTS
from mediacat.llm.mixing import REST, mixed, mixing_order, period_schedule, source_weights
from mediacat.llm.sharding import jump_shards, shard_documents
from mediacat.llm.warc import WarcError, encode_record, read_records, warc_round_trip
from mediacat.session import scratch_path


def page_rows(rnd):
    bodies = ["", None, "é" * 499, "é" * 500, "x" * 999, "x" * 1000, "<p>\r\n\r\n</p>" * 200, "big " * 100_000]
    rows = [(i, rnd.choice(["http://a/b", "http://ü/ \r\nX: y", None, ""]), rnd.choice(bodies)) for i in range(200)]
    return rows + [(199, "http://again", "x" * 1000), (None, "http://none", "x" * 1000), (None, None, "y" * 2000), (None, None, "y" * 2000), (500, "u", "z" * 3000), (500, "u", "z" * 3000), (-4, "u", "z" * 3000)]


def test_round_trip_matches_brute_force(spark, rnd, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = page_rows(rnd)
    pages = spark.createDataFrame([(i, u, b, "c", 1) for i, u, b in rows], "page_id long, url string, html string, record_type string, _id int").repartition(5)
    folder = scratch_path(spark, "warc-test")
    got = warc_round_trip(pages, folder).collect()
    last = {}
    for i, _, b in rows:
        b = (b or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    want = []
    for i, _, b in rows:
        b = (b or "").encode()
        to = last.get(b)
        to = None if to is None or to == i else to
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc_round_trip(pages.limit(0), scratch_path(spark, "warc-test")).count() == 0


def archive():
    return [encode_record("response", str(i), "http://a/", ("payload %d " % i * 2000).encode()) for i in range(3)]


def test_records_read_back_in_small_pieces():
    class Drip(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    records = list(read_records(Drip(b"".join(archive()))))
    assert [r.http[1] for r in records] == [("payload %d " % i * 2000).encode() for i in range(3)]
    assert gzip.decompress(archive()[0]).startswith(b"WARC/1.1\r\n")
    assert list(read_records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("spoil", ["cut", "digest", "length", "two", "member"])
def test_broken_archives_are_refused(spoil):
    good = archive()
    plain = gzip.decompress(good[1])
    if spoil == "cut":
        data = b"".join(good)[:-30]
    elif spoil == "digest":
        data = good[0] + gzip.compress(plain.replace(b"payload 1", b"payload 9", 1))
    elif spoil == "length":
        data = good[0] + gzip.compress(plain.replace(b"Content-Length: ", b"Content-Length: 1", 1))
    elif spoil == "two":
        data = gzip.compress(plain + plain)
    else:
        data = good[0] + b"no gzip member"
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(data)))


def brute_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_shards_match_the_published_loop(rnd):
    keys = [rnd.getrandbits(64) for _ in range(3000)]
    array = np.array(keys, np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert list(jump_shards(array, n)) == [brute_jump(k, n) for k in keys]
    for n in range(1, 30):
        a, b = jump_shards(array, n), jump_shards(array, n + 1)
        assert set(b[a != b]) <= {n} and abs((a != b).mean() - 1 / (n + 1)) < 0.03


def test_shards_have_gapless_slots(docs, spark, rnd):
    rows = [(i, " ".join(prose(rnd, rnd.randrange(0, 30))), None, None) for i in range(2000)]
    rows += [(5, None, None, None), (5, "", None, None), (None, "é", None, None), (None, None, None, None), (9000, "long " * 50000, None, None)]
    got = shard_documents(docs(rows)).collect()
    assert len(got) == len(rows)
    want = sorted([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows], key=str)
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=str) == want
    slots = {}
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert set(slots) == set(range(8))
    for s in slots.values():
        s.sort(key=lambda x: x[0])
        assert [x for x, _ in s] == list(range(len(s)))
        ids = [i for _, i in s if i is not None]
        assert ids == sorted(ids)
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    hashes = spark.createDataFrame([(i,) for i, *_ in rows[:2000]], "i long").select("i", F.xxhash64("i").alias("h")).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[r.i] == brute_jump(r.h % 2**64, 8) for r in hashes)
    assert shard_documents(docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("weights", [MIX_WEIGHTS, {"a": 1, REST: 1}, {"a": 333, "b": 1, "c": 5, REST: 661}, {REST: 1}, {f"s{i}": 1 + i % 3 for i in range(19)} | {REST: 30}])
def test_schedule_deviates_by_less_than_a_block(weights):
    period = sum(weights.values())
    got = dict.fromkeys(weights, 0)
    for t, (stream, k, release, deadline, slot) in enumerate(period_schedule(weights)):
        assert slot == t and release <= t < deadline and k == got[stream]
        got[stream] += 1
        assert all(abs(got[s] * period - n * (t + 1)) < period for s, n in weights.items())
    assert got == weights


def mix_rows(rnd):
    sources = ["src0", "src1", "src2", "src3", "other", "else", None]
    rows = [(i, "w" * rnd.choice([0, 10, 100, 400]), None, "other" if i % 3 == 0 else rnd.choice(sources)) for i in range(3000)]
    return rows + [(1, None, None, None), (1, None, None, None), (2, "", None, "src0"), (None, "x", None, "src1"), (None, None, None, None), (7000, "long" * 30000, None, "src2")]


def test_mixing_keeps_to_the_weights(docs, rnd):
    rows = mix_rows(rnd)
    size = 1000
    got = sorted(mixing_order(docs(rows), MIX_WEIGHTS, size).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted([str(r.doc_id) for r in got]) == sorted(str(i) for i, *_ in rows)
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    text = {i: t or "" for i, t, _, _ in rows}
    blocks = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert blocks.setdefault((r.stream, r.block), r.slot) == r.slot
    assert len(set(blocks.values())) == len(blocks)  # one block a slot
    # no two blocks of a stream are nearer to the weights' pace than a block allows
    period = sum(MIX_WEIGHTS.values())
    for (stream, block), slot in blocks.items():
        assert abs(block + 1 - MIX_WEIGHTS[stream] * (slot + 1) / period) < 1
    mass = {}
    for r in got:
        mass.setdefault(r.stream, 0)
        if r.doc_id is not None and r.doc_id > 2:
            assert r.block <= mass[r.stream] // size + 1
        mass[r.stream] += len(text[r.doc_id].encode()) + 1
    assert mixing_order(docs(rows).limit(0), MIX_WEIGHTS).count() == 0


def test_every_source_has_its_pace(docs, rnd):
    """Slots are those of a plain earliest-deadline simulation, and each of
    many sources is less than a block from its weight at every slot."""
    rows = [(i, "w " * rnd.randrange(1, 90), "en", rnd.choice(["src0", "src1"] * 5 + [f"src{k}" for k in range(2, 20)] + [None])) for i in range(1500)]
    weights = source_weights(docs(rows), MIX_WEIGHTS)
    assert set(weights) == {*(f"src{k}" for k in range(20)), REST} and sum(weights.values()) == 17 * 100
    got = mixing_order(docs(rows), weights, 200).collect()
    slots = {(r.stream, r.block): r.slot for r in got}
    total, got_so_far, want = sum(weights.values()), dict.fromkeys(weights, 0), {}
    for slot in range(max(slots.values()) + 1):
        due = []
        for rank, (s, w) in enumerate(weights.items()):
            k = got_so_far[s]
            if k * total // w <= slot:
                due.append((-(-(k + 1) * total // w), rank, s))
        if due:
            s = min(due)[2]
            want[s, got_so_far[s]] = slot
            got_so_far[s] += 1
    assert slots.items() <= want.items()
    for (s, block), slot in slots.items():
        assert abs(block + 1 - weights[s] * (slot + 1) / total) < 1
    few = source_weights(docs(rows), MIX_WEIGHTS, most=3)
    assert set(few) == {"src0", "src1", "src2", "src3", "*", "*0", "*1", "*2"}
    shared = mixing_order(docs(rows), few, 200).collect()
    assert len(shared) == len(rows) and {r.stream for r in shared} == set(few)


def test_mixed_texts_are_shuffled_once(docs, rnd):
    rows = [(i, "word " * rnd.randrange(50), "en", rnd.choice(["src0", "src9", None])) for i in range(200)]
    plan = mixed(docs(rows), MIX_WEIGHTS, 500)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    # the range exchange carries the texts; no other one, and no join of two large sides
    assert text.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_mixed_rows_come_in_that_order(docs, rnd, spark):
    rows = mix_rows(rnd)
    frame = docs(rows)
    out = mixed(frame, MIX_WEIGHTS, 1000)
    assert out.columns == frame.columns
    path = scratch_path(spark, "mixed")
    out.write.parquet(path)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    listed = back.orderBy("_metadata.file_name", "_metadata.row_index").collect()
    streams = [r.source if r.source in MIX_WEIGHTS else REST for r in listed]
    early = streams[:600]
    for s, parts in MIX_WEIGHTS.items():
        assert abs(early.count(s) / 600 - parts / 100) < 0.1
    assert mixed(frame.limit(0), MIX_WEIGHTS).count() == 0


def test_weights_are_checked(docs):
    with pytest.raises(ValueError):
        mixing_order(docs([(1, "x", None, None)]), {"a": 1})
    with pytest.raises(ValueError):
        period_schedule({REST: 0})
