"""Operators that compare documents: near-dedup, substring dedup, decontamination."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.invented import prose
from mediacat.llm.components import components
from mediacat.llm.decontaminate import alignments, build_index, candidates, contaminations, without_contaminated
from mediacat.llm.minhash_dedup import near_duplicates, without_near_duplicates
from mediacat.llm.substring_dedup import repeated_passages


def shingle_set(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is None or j is None or not a or not b:
                continue
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted([(i, len(s), root(i) if i is not None else None) for i, s in sets], key=str)


def edited(rnd, words, share):
    return [w if rnd.random() > share else rnd.choice(["new", "other"]) + str(rnd.randrange(10**6)) for w in words]


def near_rows(rnd):
    rows = []
    for group in range(12):
        base = prose(rnd, rnd.choice([3, 12, 60, 250]))
        for _ in range(rnd.choice([1, 2, 8])):
            rows.append((len(rows) * 7 % 1009, " ".join(edited(rnd, base, rnd.choice([0, 0.01, 0.02, 0.04])))))
    # a chain: each like the next, the ends unlike
    chain = prose(rnd, 300)
    for step in range(12):
        rows.append((2000 - step, " ".join(prose(rnd, step * 6) + chain[step * 6 :])))
    # a large group around one text, most members too far from each other
    hub = prose(rnd, 200)
    for m in range(60):
        rows.append((3000 + m, " ".join(edited(rnd, hub, 0.01 + 0.03 * rnd.random()))))
    rows += [(4000 + i, t) for i, t in enumerate([None, "", " \n\t", "one", "ONE", "one two", "One  two", "a b c", "A\nb\tc", "x" * 90000, "x" * 90000, "é É", "é é"])]
    rows += [(4000, "one two"), (4003, "one two"), (4003, "one two"), (None, "one"), (None, "one")]
    return rows


def test_near_duplicates_match_brute_force(docs, rnd):
    rows = near_rows(rnd)
    frame = docs([(i, t, None, None) for i, t in rows])
    for k, percent in ((3, 85), (5, 80)):
        got = near_duplicates(frame, k, percent).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_components(rows, k, percent)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(docs, rnd):
    rows = near_rows(rnd)
    frame = docs([(i, t, None, None) for i, t in rows])
    left = without_near_duplicates(frame)
    assert left.columns == frame.columns
    got = [r.doc_id for r in left.collect()]
    want = {c for _, _, c in brute_components(rows, 5, 80) if c is not None}
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_many_dropped_ids_give_the_same_rows(docs, rnd, monkeypatch, bits):
    """Above the broadcast bound a bitmap lets rows pass; a full one lets none pass without the join."""
    from mediacat.llm import tables

    base = [" ".join(prose(rnd, 60)) for _ in range(30)]
    frame = docs([(i, base[i % 30], "en", "s") for i in range(120)] + [(None, "no id", "en", "s"), (500, None, "en", "s")])
    want = sorted(map(str, without_near_duplicates(frame).collect()))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tables, "MAX_BITS", bits)
    monkeypatch.setattr(tables, "MIN_BITS", min(bits, tables.MIN_BITS))
    assert sorted(map(str, without_near_duplicates(frame).collect())) == want and len(want) == 32


def test_near_duplicates_of_empty_and_unlike_tables(docs):
    assert near_duplicates(docs([(1, "x", None, None)]).limit(0)).count() == 0
    got = near_duplicates(docs([(1, "a b c d e f", None, None), (2, "g h i j k l", None, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (2, 2, 2, True)]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(600, 900)] + [(7, 7), (8, 9), (9, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{x: 500 for x in range(600, 900)}, 9: 8}


def test_repeated_passages_are_found_wherever_they_lie(docs, rnd):
    passages = [prose(rnd, rnd.randrange(51, 90)) for _ in range(20)]
    rows, holders = [], {}
    for i in range(80):
        before, after = prose(rnd, rnd.randrange(0, 60)), prose(rnd, rnd.randrange(0, 60))
        p = i % 20
        body = passages[p] if i < 60 else []
        sep = rnd.choice([" ", "\n"])
        rows.append((i, sep.join(before + [w.upper() if w.isascii() and i % 3 == 1 else w for w in body] + after), None, None))
        if body:
            holders.setdefault(p, set()).add(i)
    rows += [(900, None, None, None), (901, "", None, None), (902, "short text", None, None), (903, "short text", None, None), (None, " ".join(passages[0]), None, None)]
    twice = prose(rnd, 60)
    rows += [(950, " ".join(twice + prose(rnd, 20) + twice), None, None), (951, " ".join(prose(rnd, 300)), None, None), (951, " ".join(rows[0][1].split()[:0]), None, None)]
    got = repeated_passages(docs(rows)).collect()
    assert {r.doc_id for r in got} == set(range(60))
    text = {i: t for i, t, _, _ in rows}
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        assert re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id][r.start : r.end]) == words[r.first_word : r.end_word]
        assert r.cluster_id in holders[r.doc_id % 20] and r.copies >= 2
        assert r.removed or r.doc_id == r.cluster_id
    assert {r.doc_id for r in got if r.removed} == {i for ids in holders.values() for i in ids if i != min(ids)}
    assert repeated_passages(docs(rows).limit(0)).count() == 0


def test_short_paragraphs_of_a_text_are_found(docs, rnd):
    """Lines and hard-wrapped blocks of 24 words and more, in otherwise different texts."""
    wrap = lambda words, n, feed: feed.join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    rows, want = [], {}
    for n in range(24, 50):
        body = prose(rnd, n)
        line, feed = wrap(body, n, ""), rnd.choice(["\n", "\r\n", "\r"])
        block = wrap(body, 9, feed)
        forms = [feed.join([" ".join(prose(rnd, 30)), line, " ".join(prose(rnd, 7))]) for _ in range(2)]
        forms += [(feed + " " + feed).join([" ".join(prose(rnd, 30)), block, " ".join(prose(rnd, 7))]), block]
        for text in forms:
            rows.append((len(rows), text, None, None))
            want[len(rows) - 1] = (body, n)
    got = repeated_passages(docs(rows)).collect()
    for i, (body, n) in want.items():
        found = [r for r in got if r.doc_id == i and r.end_word - r.first_word == n]
        assert [rows[i][1][r.start : r.end].split() for r in found] == [body]
        assert [(r.cluster_id, r.removed) for r in found] == [(i // 4 * 4, i % 4 > 0)]
        assert found[0].copies >= 4  # cut paragraphs much like it count too


def test_paragraphs_alike_but_not_equal_are_linked(docs, rnd):
    base = prose(rnd, 2000)
    rows = [(1, " ".join(base), None, None), (2, " ".join(w if i % 40 else "changed" for i, w in enumerate(base)), None, None)]
    got = repeated_passages(docs(rows)).collect()
    clusters = {r.cluster_id for r in got}
    assert clusters == {1} and any(r.removed for r in got)


def test_short_edited_paragraphs_reach_recall(docs, rnd):
    """Every pair of lines that brute force finds 0.8 alike, edits at either end or in the middle."""
    rows, pairs = [], []
    while len(pairs) < 300:
        base = prose(rnd, rnd.randrange(26, 80))
        like = list(base)
        for _ in range(rnd.choice([1, 1, 2])):
            like[rnd.choice([0, 1, len(base) // 2, -1, rnd.randrange(len(base))])] = f"changed{rnd.randrange(10**6)}"
        a, b = shingle_set(" ".join(base), 5), shingle_set(" ".join(like), 5)
        alike = 100 * len(a & b) >= 80 * len(a | b)
        if alike or rnd.random() < 0.1:
            for words in (base, like):
                rows.append((len(rows), "\n".join([" ".join(prose(rnd, 30)), " ".join(words), " ".join(prose(rnd, 9))]), None, None))
            pairs += [(len(rows) - 2, len(base))] if alike else []
    whole = {(r.doc_id, r.end_word - r.first_word): (r.cluster_id, r.removed) for r in repeated_passages(docs(rows)).collect() if r.first_word == 30}
    found = [i for i, n in pairs if whole.get((i, n)) == (i, False) and whole.get((i + 1, n)) == (i, True)]
    assert len(found) >= 0.99 * len(pairs)


def brute_distance(item, text):
    """Least edits of the item to a piece of the text, over words."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(text):
            new.append(min(row[j] + (w != v), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def norm(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_alignments_match_brute_force(rnd):
    item = np.array([rnd.randrange(4) for _ in range(9)], np.uint64)
    regions = np.array([[rnd.randrange(4) for _ in range(15)] for _ in range(50)], np.uint64)
    distance, end = alignments(item, regions)
    assert list(distance) == [brute_distance(list(item), list(r)) for r in regions]


def test_contaminations_reach_recall(docs, spark, rnd):
    items = [(i, " ".join(prose(rnd, rnd.choice([13, 15, 20, 38, 70]))).capitalize() + ".") for i in range(30)] + [(98, ""), (99, None), (97, "--")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items] + [items[0] + ("again",)], "item_id long, text string, doc_id string")
    rows, want, exact = [], set(), set()
    for n in range(400):
        i, t = items[n % 30]
        words, share = t.split(), [0, 0, 0.05, 0.1, 0.15][n % 5]
        body = edited(rnd, words, share) if n < 300 else []
        if share and body and rnd.random() < 0.5:
            del body[rnd.randrange(len(body))]
        text = " ".join(prose(rnd, rnd.randrange(0, 120)) + body + prose(rnd, rnd.randrange(0, 120)))
        rows.append((n, text.upper() if n % 7 == 0 else text.replace(" ", ", "), None, None))
    rows += [(900, None, None, None), (901, "", None, None), (902, items[0][1], None, None), (902, items[0][1], None, None), (None, items[1][1], None, None)]
    for n, t, _, _ in rows[:400]:
        for i, item in items[:30]:
            a = norm(item)
            d = brute_distance(a, norm(t))
            if d <= len(a) * 20 // 100:
                want.add((n, i))
                if d == 0:
                    exact.add((n, i))
    got = contaminations(docs(rows), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got if r.doc_id is not None and r.doc_id < 400}
    assert pairs <= want and exact <= pairs
    assert len(want) > 250 and len(pairs) >= 0.98 * len(want)
    text = {i: norm(t) for i, t, _, _ in rows}
    for r in got:
        if r.doc_id is not None:
            item = norm(dict(items)[r.item_id])
            assert r.distance == brute_distance(item, text[r.doc_id]) and r.item_words == len(item)
            assert brute_distance(item, text[r.doc_id][r.first_word : r.end_word]) == r.distance
    assert [r.doc_id for r in got].count(902) == 2 and [r.item_id for r in got if r.doc_id is None] == [1]
    left = without_contaminated(docs(rows), bench)
    assert left.columns == docs(rows).columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(x for x in ids if x < 900) == sorted(set(range(400)) - {n for n, _ in pairs}) and {900, 901} <= set(ids) and 902 not in ids and None not in ids


def test_short_items_and_empty_tables(docs, spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, "zeta"), (3, "a b c d e")], "item_id long, text string")
    rows = [(1, "x one two three y", None, None), (2, "one two", None, None), (3, "zeta", None, None), (4, "a b X c d e", None, None), (5, "a b c e", None, None)]
    got = sorted((r.doc_id, r.item_id, r.distance) for r in contaminations(docs(rows), bench).collect())
    assert {(1, 1, 0), (3, 2, 0)} <= set(got) <= {(1, 1, 0), (3, 2, 0), (4, 3, 1), (5, 3, 1)}
    assert contaminations(docs(rows).limit(0), bench).count() == 0
    assert contaminations(docs(rows), bench.limit(0)).count() == 0
    assert without_contaminated(docs(rows), bench.limit(0)).count() == 5


def test_keys_that_no_other_paragraph_has_are_not_shuffled(docs, rnd):
    """a class takes the keys along that may be repeated, and few others."""
    from mediacat.llm import substring_dedup as s
    from mediacat.llm.tables import TWO_PLACES, bitmap_of

    line = " ".join(prose(rnd, 30))
    frame = docs([(i, "\n".join([" ".join(prose(rnd, 40)), line, " ".join(prose(rnd, 40))]), None, None) for i in range(2)])
    source = frame.selectExpr("doc_id AS _id", "text AS _text")
    repeated = {r[0] for r in s._repeated_keys(source).collect()}
    got = s._classes(source, bitmap_of(s._repeated_keys(source), "_key", TWO_PLACES)).collect()
    keys = [r[f"_k{b}"] for r in got for b in range(s.BANDS + s.OWN_BANDS) if r[f"_k{b}"] is not None]
    assert repeated and set(keys) == repeated


def test_two_places_tell_more_keys_and_miss_none(spark):
    from mediacat.llm.tables import TWO_PLACES, bitmap_of, in_bitmap
    from mediacat.llm.textblocks import mix

    keys = mix(np.arange(200_000, dtype=np.uint64)).view(np.int64)
    frame = spark.createDataFrame([(int(k),) for k in keys[:60_000]], "k long")
    two, one = bitmap_of(frame, "k", TWO_PLACES), bitmap_of(frame, "k")
    assert in_bitmap(two, keys[:60_000], TWO_PLACES).all() and in_bitmap(one, keys[:60_000]).all()
    assert in_bitmap(two, keys[60_000:], TWO_PLACES).mean() < 0.02 < in_bitmap(one, keys[60_000:]).mean()


def test_shingle_sets_hold_each_shingle_once(docs, rnd):
    from mediacat.llm import substring_dedup as s
    from mediacat.llm.tables import TWO_PLACES, bitmap_of
    from mediacat.llm.textblocks import blocks

    base = prose(rnd, 12)
    texts = [" ".join(base * 4 + prose(rnd, 60) + base * 3), None, "", " ".join(prose(rnd, 200)), "\n".join([" ".join(prose(rnd, 30))] * 2)]
    p = [s.Paragraphs(b) for b in blocks(pa.array(texts))][0]
    want = {int(d): sorted(set(p.shingles[a : e - s.SHINGLE + 1].view(np.int64).tolist())) for d, a, e in zip(p.digest.view(np.int64), p.first, p.end)}
    frame = docs([(i, t, None, None) for i, t in enumerate(texts)])
    source = frame.selectExpr("doc_id AS _id", "text AS _text")
    wanted = frame.sparkSession.createDataFrame([(d,) for d in want], "_id long")
    got = s._shingle_sets(source, bitmap_of(wanted, "_id", TWO_PLACES)).collect()
    assert {r["_id"]: sorted(r["_set"]) for r in got} == want


@pytest.mark.parametrize("places, run", [(1 << 16, 1 << 17), (8, 50)])
def test_prefix_join_on_rough_ranks_leaves_no_pair_out(spark, rnd, monkeypatch, places, run):
    """the order of the shingles may be rough (few counters), their sets are dealt in runs."""
    from mediacat.llm import minhash_dedup as m

    monkeypatch.setattr(m, "MIN_PLACES", places)
    monkeypatch.setattr(m, "MAX_PLACES", places)
    monkeypatch.setattr(m, "RUN_TOKENS", run)
    common, sets = [rnd.randrange(-(2**63), 2**63) for _ in range(4)], []
    for _ in range(40):
        base = common + [rnd.randrange(-(2**63), 2**63) for _ in range(rnd.choice([1, 6, 20, 80]))]
        for _ in range(rnd.choice([1, 2, 4])):
            sets.append([t for t in base if rnd.random() > 0.08] or base)
    comps = [rnd.randrange(len(sets) // 2) for _ in sets]
    frame = spark.createDataFrame(list(enumerate(sets)), "_id long, _set array<long>")
    wanted = spark.createDataFrame(list(enumerate(comps)), "_id long, _comp long")
    got = {(r.a, r.b) for r in m.rare_token_pairs(frame, wanted, 80).collect()}
    want = set()
    for j, b in enumerate(map(set, sets)):
        want |= {(i, j) for i, a in enumerate(map(set, sets[:j])) if comps[i] != comps[j] and 100 * len(a & b) >= 80 * len(a | b)}
    assert want and want <= got and all(comps[i] != comps[j] for i, j in got)
    assert m.rare_token_pairs(frame.limit(0), wanted, 80).count() == 0
