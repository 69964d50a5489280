"""Operators over a whole corpus, fingerprints, phrases and divergence, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

import __spark_entry__
from llm.invented import prose
from mediacat.llm import phrases, spotsigs
from mediacat.llm.divergence import source_divergence
from mediacat.llm.phrases import collocations, count_transducers
from mediacat.llm.spotsigs import COMMON_WORDS, length_class, likeness, spot_fingerprints, with_signatures

COMMON = {w for ws in COMMON_WORDS.values() for w in ws}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- fingerprints


def brute_signatures(text, chain=2):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [w for w in words if w not in COMMON]
    spots, k = [("^", 0)] if words else [], 0
    for w in words:
        if w in COMMON:
            spots.append((w, k))
        else:
            k += 1
            if hashlib.md5(w.encode()).hexdigest()[0] == "0":
                spots.append((w, k))
    out = set()
    for anchor, at in spots:
        # the place after the last content word counts as an empty word
        following = " ".join([*content, ""][at : at + chain])
        out.add(int(hashlib.md5(f"{anchor}:{following}".encode()).hexdigest()[:15], 16))
    return out


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    if not a or not b or min(len(a), len(b)) < 0.1 * max(len(a), len(b)):
        return 0.0
    return len(a & b) / len(a | b)


def brute_fingerprints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = (brute_signatures(x) for x in (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    return out


@pytest.fixture
def texts(rnd):
    out = [(10 * i, " ".join(prose(rnd, rnd.choice([1, 3, 30, 200])))) for i in range(150)]
    out += [(1, None), (2, ""), (3, " .,; "), (4, "the"), (5, "The of the AND"), (6, "of a B"), (7, "über\tÉté 12\nthe x_y"), (None, "the lost one"), (None, None)]
    out += [(20, out[2][1]), (20, out[2][1]), (20, "another text of the same id"), (9999, "word " * 30000 + "the end of it"), (-5, "x" * 50000)]
    return out


def test_fingerprints_match_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 8)
    table = docs([(i, t, "en", "s") for i, t in texts]).repartition(5)
    got = spotsigs.spot_fingerprints(table).collect()
    rows = [(r.doc_id, r.n_chars, r.edited_sha256, len(r.signatures), round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(rows, key=str) == sorted(brute_fingerprints(texts), key=str)
    by_text = defaultdict(set)
    text_of = {i: t for i, t in texts}
    for r in got:
        assert set(r.signatures) == brute_signatures(text_of[r.doc_id]) or r.doc_id in (None, 20)
        assert (r.fingerprint == "") == (not r.signatures) and r.signatures == sorted(r.signatures)
        if r.doc_id not in (None, 20):
            by_text[text_of[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_blocks_do_not_depend_on_them(spark, docs, texts):
    table = docs([(i, t, "en", "s") for i, t in texts])
    one = [sorted(map(str, spotsigs.beside_next(table, lambda d: with_signatures(d, "_text", "_set"), block_rows=n).collect())) for n in (1, 7, 10**6)]
    assert one[0] == one[1] == one[2]


def test_fingerprints_of_few_documents(spark, docs):
    assert spot_fingerprints(docs([(1, "a b", "en", "s")]).limit(0)).count() == 0
    (only,) = spot_fingerprints(docs([(1, "the stone in the river", "en", "s")])).collect()
    assert only.near_next == 1.0 and only.n_chars == 22
    none = spot_fingerprints(docs([(1, None, None, None), (2, "", "en", "s")])).collect()
    assert [(r.fingerprint, r.near_edited, r.near_next) for r in none] == [("", 1.0, 1.0)] * 2


def test_other_scripts_have_a_word_for_each_character(spark, docs):
    rows = docs([(1, "漢字仮名漢字", "ja", "s"), (2, "“quoted” don’t—stop", "en", "s")])
    got = {r.doc_id: len(r.s) for r in with_signatures(rows, "text", "s", common=["漢", "t"]).collect()}
    drawn = {w: hashlib.md5(w.encode()).hexdigest()[0] == "0" for w in ("字", "仮", "名", "quoted", "don", "stop")}
    # the start, the common words and the drawn ones
    assert got == {1: 1 + 2 + sum(drawn[w] * n for w, n in (("字", 2), ("仮", 1), ("名", 1))), 2: 1 + 1 + sum(drawn[w] for w in ("quoted", "don", "stop"))}


def test_near_copies_are_alike_and_others_are_not(spark, docs, rnd):
    base = [prose(rnd, 300) for _ in range(40)]
    rows = []
    for i, words in enumerate(base):
        near = list(words)
        near[rnd.randrange(300)] = "changed"
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join(near), "en", "s")]
    got = {r.doc_id: r.near_next for r in spot_fingerprints(docs(rows)).collect()}
    assert min(got[2 * i] for i in range(40)) > 0.85 and max(got[2 * i + 1] for i in range(40)) < 0.2


def test_classes_of_length_lose_no_pair(spark):
    sizes = [0, 1, 2, 9, 10, 11, 99, 100, 101, 1000]
    df = spark.createDataFrame([(i, j) for i in sizes for j in sizes], "a int, b int")
    # one set within the other: as like as their sizes allow
    sets = [F.when(F.col(c) > 0, F.sequence(F.lit(1), F.col(c))).otherwise(F.array().cast("array<int>")) for c in "ab"]
    for least in (0.1, 0.5, 0.8):
        got = df.select("a", "b", likeness(*sets, least).alias("x"), (length_class(sets[0], least) - length_class(sets[1], least)).alias("d")).collect()
        for r in got:
            true = 1.0 if r.a == r.b else min(r.a, r.b) / max(r.a, r.b)
            assert r.x == (true if true >= least else 0.0), r
            assert abs(r.d) <= 1 or true < least


# ---- phrases


def brute_phrases(rows, max_words=3, least=10, top=2000, percent=50):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        longer, scored = Counter(), []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                for m in range(2, len(p)):
                    for i in range(len(p) - m + 1):
                        longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), p, f[p[:k]], f[p[k:]]))
        scored = [s for s in scored if 100 * longer[s[3]] < percent * -s[1] or not longer[s[3]]]
        for rank, (score, a, phrase, _, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.fixture
def spoken(rnd):
    some = "red fox über den fluss ñandu stone A. b the The cloud; mirror blue: salt x!y iron\tlamp new\nline".split(" ")
    rows = [(" ".join(rnd.choice(some[: rnd.choice([5, 12, 18])]) for _ in range(rnd.choice([3, 40, 200]))), rnd.choice(["en", "de", None, ""])) for _ in range(80)]
    rows += [(None, "en"), ("", "fr"), ("one", "fr"), (". , ;", None), ("the red fox " * 30000, "en")] + [("deep blue sea", "es")] * 12 + [("hot dog stand", "und")] * 9
    return rows


@pytest.mark.parametrize(("max_words", "least", "top", "percent"), [(3, 10, 2000, 50), (2, 2, 5, 50), (4, 3, 40, 80)])
def test_phrases_match_brute_force(spark, docs, spoken, monkeypatch, max_words, least, top, percent):
    monkeypatch.setattr(phrases, "RANGE_BYTES", 20_000)
    table = docs([(i, t, lang, "s") for i, (t, lang) in enumerate(spoken)]).repartition(4)
    got = sorted(map(tuple, phrases.collocations(table, max_words, least, top, percent).collect()))
    assert got == brute_phrases(spoken, max_words, least, top, percent)


def test_phrases_do_not_depend_on_shards_and_ranges(spark, docs, spoken, monkeypatch):
    table = docs([(i, t, lang, "s") for i, (t, lang) in enumerate(spoken)])
    whole = count_transducers(table.select("lang", "text").na.fill("und", ["lang"]).na.fill(""), 1, 3, 5)
    split = count_transducers(table.select("lang", "text").na.fill("und", ["lang"]).na.fill("").repartition(7), 50, 3, 5)

    def weights(transducers):
        out = {}
        for row in transducers.toArrow().to_batches():
            for i in range(row.num_rows):
                t = phrases._read(pa.Table.from_batches([row.slice(i, 1)]), 3)
                for m in (1, 2, 3):
                    paths = t.paths(m)
                    assert (t.compose(paths) == t.levels[m - 1][-1]).all()
                    spelled = zip(*[t.words.take(pa.array(x)).to_pylist() for x in paths])
                    out.update({(row["lang"][i].as_py(), p): w for p, w in zip(spelled, t.levels[m - 1][-1].tolist())})
        return out

    assert weights(whole) == weights(split) and len(weights(whole)) > 50


def test_counts_past_64_bits_are_exact(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long")
    wide = df.select(*[F.col(c).cast("decimal(19,0)").alias(f"_{c}") for c in "alr"])
    assert wide.select(F.expr("(_a * _a * 1000000BD) div (_l * _r)").alias("s")).first().s == 1000000 * big * big // ((big + 1) * (big + 7))


def test_phrases_of_no_rows(spark, docs):
    assert collocations(docs([(1, "a b", "en", "s")]).limit(0)).count() == 0
    assert collocations(docs([(1, None, None, None), (2, "", "en", "s"), (3, "a b c", "en", "s")])).count() == 0


# ---- divergence


def brute_divergence(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    df, counts = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang, source) for _, lang, source in rows})
    for text, lang, source in rows:
        found = term.findall(lower(text))
        df[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        v, sources = len(kept), [s for x, s in groups if x == lang]
        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def p(count, n):
            return 1 + 10**9 * (count + 2) // (n + 2 * v)

        own = {t: p(counts[lang, source][t], totals[source]) for t in kept}
        pairs = []
        for s in sources:
            if s != source:
                q = [p(counts[lang, s][t], totals[s]) for t in kept]
                pairs.append((-sum((own[t] - x) ** 2 // (own[t] + x) for t, x in zip(kept, q)), s.encode()))
        terms = []
        for t in kept:
            q = p(whole[t], sum(whole.values()))
            if counts[lang, source][t] and own[t] > q:
                terms.append((-((own[t] - q) ** 2 // (own[t] + q)), t.encode()))
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture
def voices(rnd):
    rows = []
    for i in range(300):
        source = rnd.choice(["a", "a", "a", "b", "ç", "d", None])
        rows.append((" ".join(prose(rnd, rnd.choice([2, 30, 120])) + ["Über", "zz1zz", source or "none"]), rnd.choice(["en", "fr", None]), source))
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("12 34", "xx", "a"), ("rare words", "xx", "b"), ("only one source", "yy", "a"), ("the " * 50000, "fr", "long")]
    return rows + [rows[0]] * 3


@pytest.mark.parametrize(("fit_terms", "tile", "block"), [(10**6, 512, 10**5), (50, 2, 20)])
def test_divergence_matches_brute_force(spark, docs, voices, monkeypatch, fit_terms, tile, block):
    from mediacat.llm import divergence

    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    monkeypatch.setattr(divergence, "TASK_ENTRIES", block)
    table = docs([(i, t, lang, s) for i, (t, lang, s) in enumerate(voices)]).repartition(4)
    got = sorted(map(tuple, divergence.source_divergence(table, fit_terms=fit_terms, tile=tile).collect()))
    assert got == brute_divergence(voices)


def test_vectors_are_those_of_the_model(spark, voices):
    from mediacat.llm.divergence import document_vectors
    from mediacat.llm.textblocks import blocks

    texts = [t or "" for t, _, _ in voices]
    lists = spark.createDataFrame([(i, ["en\x01" + w for w in re.findall("[a-z\x80-\U0010ffff]+", lower(t))]) for i, t in enumerate(texts)], "i int, terms array<string>")
    model = CountVectorizer(inputCol="terms", outputCol="v", minDF=10.0, vocabSize=2**31 - 1).fit(lists)
    want = {r.i: dict(zip(r.v.indices.tolist(), r.v.values.tolist())) for r in model.transform(lists).collect()}
    (block,) = blocks(pa.array(texts), 1 << 30)
    got = {i: {} for i in range(len(texts))}
    for row, index, count in zip(*document_vectors(block, pa.array(["en"] * len(texts)), pa.array(model.vocabulary))):
        got[int(row)][int(index)] = float(count)
    assert got == want


def test_probabilities_past_64_bits_are_exact(spark):
    from mediacat.llm.divergence import _probability

    counts = [0, 1, 2**33 - 1, 2**33, 10**13, 10**14 + 7]
    df = spark.createDataFrame([(c, 3 * 10**14 + 1, 12345) for c in counts], "c long, n long, v long")
    got = [r.p for r in df.select(_probability(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (3 * 10**14 + 1 + 2 * 12345) for c in counts]


def test_divergence_of_few_rows(spark, docs):
    assert source_divergence(docs([(1, "a", "en", "s")]).limit(0)).count() == 0
    got = source_divergence(docs([(1, None, None, None), (2, "few words", "", "b")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_the_registered_queries_read_all(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").collect()
    queries = __spark_entry__.queries()
    rows = [(r.doc_id, r.n_chars, r.edited_sha256, r.n_signatures, round(r.near_edited, 9), round(r.near_next, 9)) for r in queries["op11_document_fingerprints"](spark, sf).collect()]
    want = brute_fingerprints([(d.doc_id, d.text) for d in documents])
    assert [r[:3] for r in sorted(rows)] == [w[:3] for w in sorted(want)]
    got = sorted(map(tuple, queries["op12_phrase_mining"](spark, sf).collect()))
    assert got == brute_phrases([(d.text, d.lang) for d in documents])
    got = sorted(map(tuple, queries["op13_source_divergence"](spark, sf).collect()))
    assert got == brute_divergence([(d.text, d.lang, d.source) for d in documents])
