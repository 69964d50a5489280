"""The registered queries over the smallest driver tables, and the pipeline,
against brute force."""

import hashlib
import zlib

import corpus_pipeline
import pytest

import __spark_entry__
from llm.invented import prose
from mediacat.llm.catalog import MIX_WEIGHTS, QUERIES
from mediacat.llm.mixing import mixing_order
from mediacat.session import scratch_path
from llm.test_files import brute_jump
from llm.test_pairs import brute_components, brute_distance, edited, norm
from llm.test_rows import brute_measures, brute_secrets, brute_verdict

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "decontamination", "mixing", "sharding"]


def test_op1(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = run(spark, "op1_url_filter").collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute_verdict(u) for i, u in pages.items()}


def test_op2_finds_what_documents_share(spark, documents):
    got = run(spark, "op2_substring_dedup").collect()
    where = {}
    for i, d in documents.items():
        words = (d.text or "").lower().split()
        for k in range(len(words) - 49):
            where.setdefault(tuple(words[k : k + 50]), set()).add(i)
    shared = {i for ids in where.values() if len(ids) > 1 for i in ids}
    assert shared <= {r.doc_id for r in got}
    for r in got:
        text = documents[r.doc_id].text[r.start : r.end]
        assert len(text.split()) == r.end_word - r.first_word >= 24


def test_op3(spark, documents):
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in run(spark, "op3_decontaminate").collect()}
    held = {(i, k) for i, d in documents.items() for k, w in items.items() if " ".join(w) in " ".join(norm(d.text))}
    assert held and {p for p, d in got.items() if d == 0} == held
    for (i, k), d in got.items():
        assert d == brute_distance(items[k], norm(documents[i].text))


def test_op4(spark, documents):
    got = run(spark, "op4_secret_scan").collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {
        i: hashlib.sha256(",".join(brute_secrets(d.text)).encode()).hexdigest() for i, d in documents.items()
    }
    assert any(r.spans for r in got)


def test_op5(spark, documents):
    got = run(spark, "op5_minhash_dedup").collect()
    want = brute_components([(i, d.text) for i, d in documents.items()], 3, 85)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op7_and_op8(spark, documents):
    got = run(spark, "op7_sharding").collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {
        i: (len(d.text.encode()) + 1, zlib.crc32(d.text.encode())) for i, d in documents.items()
    }
    assert sorted(r.position for r in run(spark, "op8_mixing").collect()) == list(range(len(documents)))


def test_op9(spark, documents):
    got = run(spark, "op9_language_id").collect()
    held = [r for r in got if r.held_out and documents[r.doc_id].lang is not None]
    assert len(got) == len(documents) and sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.9 * len(held)


def test_op10(spark, documents):
    got = run(spark, "op10_quality_rules").collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {
        i: brute_measures(d.text) for i, d in documents.items()
    }


def test_pipeline_matches_brute_force(spark, rnd):
    """Clean documents of good hosts, so that the base rules alone decide at first."""
    items = [(i, " ".join(prose(rnd, 30))) for i in range(5)]
    rows = []
    for i in range(160):
        words = prose(rnd, rnd.choice([20, 60, 120]))
        if i % 8 == 3:
            words = edited(rnd, rows[-1][1].split(), rnd.choice([0, 0.002]))
        if i % 16 == 5:
            words[10:10] = items[i % 5][1].split()
        rows.append((i, " ".join(words), "en", rnd.choice(["src0", "src1", "other", None]), 1))
    rows += [(200, None, "en", None, None), (None, " ".join(prose(rnd, 70)), "en", "src0", 1), (7, rows[7][1], "en", rows[7][3], 1)]
    folder = scratch_path(spark, "pipeline")
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(folder + "/benchmark.parquet")

    left = [r for r in rows if not brute_measures(r[1])[-1]]
    roots = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in left], 5, 80)}
    left = list(dict.fromkeys(r for r in left if r[0] is None or roots[r[0]] == r[0]))
    left = [r for r in left if not any(" ".join(norm(t)) in " ".join(norm(r[1])) for _, t in items)]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted([(r.doc_id, r.size) for r in got], key=str) == sorted([(r[0], len(r[1].encode()) + 1) for r in left], key=str)
    order = {r.doc_id: r.position for r in mixing_order(spark.createDataFrame(left, documents.schema), MIX_WEIGHTS).collect()}
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append((r.slot, r.doc_id))
    for rows_of in shards.values():
        rows_of.sort()
        assert [s for s, _ in rows_of] == list(range(len(rows_of)))
    hashes = {r.i: r.h for r in spark.createDataFrame([(r[0],) for r in left], "i long").selectExpr("i", "xxhash64(i) AS h").collect()}
    assert all(r.shard == brute_jump(hashes[r.doc_id] % 2**64, 8) for r in got)
    # blocks of the mixture come in the same order within a shard
    assert set(order) == {r.doc_id for r in got}
    for stage, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, spark.read.parquet(folder + "/documents.parquet").limit(0), folder)
        assert out.count() == 0 and out.columns == documents.columns, stage


def test_queries_take_no_other_rows(spark):
    assert all(q in __spark_entry__.queries() for q in QUERIES)
