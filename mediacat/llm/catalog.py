"""Registered queries of the training-data operators, with production
parameters over their whole tables, and their SQL where SQL can express them.

Queries without SQL are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .decontaminate import contaminations
from .divergence import source_divergence
from .language_id import language_of
from .minhash_dedup import near_duplicates
from .mixing import REST, mixing_order, source_weights
from .phrases import collocations
from .quality_rules import quality_verdicts
from .secret_scan import secret_spans
from .sharding import shard_documents
from .spotsigs import COMMON_WORDS, WORD, spot_fingerprints
from .substring_dedup import repeated_passages
from .url_filter import DEFAULT_VERDICT, GLOB_RULES, HOST_RULES, url_verdicts
from .warc import warc_round_trip

#: parts of the mixture, of 100: the named sources, and all others in equal shares
MIX_WEIGHTS = {"src0": 20, "src1": 15, "src2": 10, "src3": 10, REST: 45}
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the host rules and, where none fits, by the globs."""
    return url_verdicts(table(spark, sf_dir, "pages"), [*HOST_RULES, *GLOB_RULES], DEFAULT_VERDICT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that repeats across documents, with its cluster."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the place."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secret_spans(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates: 3-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc_round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8, and of 9."""
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of the sources."""
    documents = table(spark, sf_dir, "documents")
    return mixing_order(documents, source_weights(documents, MIX_WEIGHTS))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return language_of(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict; the host's rate to six digits."""
    return quality_verdicts(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they are."""
    found = spot_fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumn("n_signatures", F.size("signatures")).drop("signatures", "edited_signatures")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each language's sources are from each other, and what marks each of them."""
    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_substring_dedup, op3_decontaminate, op4_secret_scan, op5_minhash_dedup, op6_warc, op7_sharding, op8_mixing,
        op9_language_id, op10_quality_rules, op11_document_fingerprints, op12_phrase_mining, op13_source_divergence, pipeline,
    )
}

ORACLE = {
    "op1_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), urls AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), ruled AS (
            SELECT *,
                CASE
                    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
                END AS rule,
                CASE
                    WHEN regexp_matches(path, '(?s)^/.*\.exe$') THEN '*/*.exe'
                    WHEN regexp_matches(path, '(?s)^/.*\.zip$') THEN '*/*.zip'
                    WHEN contains('.' || host, '.ads.') AND starts_with(path, '/') THEN '*.ads.*/*'
                    WHEN regexp_matches(path, '(?s)^/.*/login') THEN '*/*/login*'
                    WHEN regexp_matches(path, '(?s)^/.*/cart/') THEN '*/*/cart/*'
                END AS plain
            FROM urls
        )
        SELECT page_id, host, path, rule,
            CASE rule
                WHEN 'org/' THEN '*.org/*' WHEN 'example.org/es/' THEN '*.example.org/es/*' WHEN 'example.org/en/1' THEN '*.example.org/en/1*'
                WHEN 'com/fr/' THEN '*.com/fr/*' WHEN 'com/de/' THEN '*.com/de/*' ELSE plain
            END AS glob,
            CASE
                WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN plain IS NOT NULL THEN 'block' ELSE 'allow'
            END AS verdict
        FROM ruled
    """,
    "op6_warc": """
        WITH rows AS (
            SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
            FROM pages
        ), firsts AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM rows
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
        FROM firsts
    """,
    "op10_quality_rules": r"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
        words AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs),
        tokens AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM words),
        wins AS (
            SELECT rid, i, a, lead(a, 1) OVER (PARTITION BY rid ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM tokens
        ), repeated AS (
            SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS times FROM wins WHERE c IS NOT NULL) x WHERE times > 1
        ), covered AS (
            SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM repeated) x GROUP BY rid
        ), lines AS (
            SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs
        ), measured AS (
            SELECT d.rid, d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
            FROM docs d JOIN words w ON w.rid = d.rid JOIN lines l ON l.rid = d.rid LEFT JOIN covered c ON c.rid = d.rid
        ), judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS strict_failed
            FROM measured
        ), hosts AS (
            SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(base_failed OR strict_failed) AS DOUBLE) AS x FROM judged GROUP BY source
        ), sums AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(n) AS n, sum(x) AS x, sum(n * n) AS n2, sum(x * x / n) AS x2 FROM hosts),
        squares AS (
            SELECT *, (x2 - x * x / n) / nullif(k - 1, 0) AS between_hosts, (x - x2) / nullif(n - k, 0) AS within, (n - n2 / n) / nullif(k - 1, 0) AS size FROM sums
        ), prior AS (
            SELECT x / n AS mean,
                1 / least(greatest(coalesce((between_hosts - within) / nullif(between_hosts + (size - 1) * within, 0), 0), 1e-6), 0.5) - 1 AS strength
            FROM squares
        ), rated AS (
            SELECT source, (h.x + p.mean * p.strength) / (h.n + p.strength) AS rate FROM hosts h, prior p
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, strict_failed,
            round(rate, 6) AS host_rate, rate >= 0.3 AS host_distrusted, NOT base_failed AND NOT (rate >= 0.3 AND strict_failed) AS kept
        FROM judged j JOIN rated r ON r.source IS NOT DISTINCT FROM j.source
    """,
    "op11_document_fingerprints": r"""
        WITH docs AS (
            SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS rid, doc_id, coalesce(text, '') AS t FROM documents
        ), following AS (
            SELECT *, length(t) AS n, length(t) // 4 AS cut,
                coalesce(lead(t) OVER (ORDER BY rid), first_value(t) OVER (ORDER BY rid)) AS next,
                coalesce(lead(rid) OVER (ORDER BY rid), 1) AS next_rid
            FROM docs
        ), edits AS (SELECT *, substr(t, 1, n - cut) || substr(next, 1, cut) AS edited FROM following),
        texts AS (SELECT rid, 0 AS part, t FROM edits UNION ALL SELECT rid, 1, edited FROM edits),
        tokens AS (
            SELECT rid, part, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
            FROM (SELECT rid, part, regexp_extract_all(lower(t), '{WORD}') AS ws FROM texts) x
        ), kinds AS (SELECT *, w IN ({COMMON}) AS common FROM tokens),
        numbered AS (
            SELECT *, CAST(coalesce(sum(CASE WHEN common THEN 0 ELSE 1 END) OVER (PARTITION BY rid, part ORDER BY i), 0) AS BIGINT) AS c FROM kinds
        ), content AS (SELECT rid, part, c, w FROM numbered WHERE NOT common),
        counted AS (SELECT rid, part, max(c) AS most, count(*) AS words FROM numbered GROUP BY rid, part),
        -- an anchor and the number of the content word after it
        anchors AS (
            SELECT rid, part, w, c + 1 AS c FROM numbered WHERE common
            UNION ALL SELECT rid, part, w, c + 1 FROM numbered WHERE NOT common AND md5(w)[1] = '0'
            UNION ALL SELECT rid, part, '^', 1 FROM counted
        ), chains AS (
            SELECT a.rid, a.part, a.w || ':' || coalesce(x.w, '') || CASE WHEN a.c <= most THEN ' ' ELSE '' END || coalesce(y.w, '') AS spot
            FROM anchors a JOIN counted k ON k.rid = a.rid AND k.part = a.part
            LEFT JOIN content x ON x.rid = a.rid AND x.part = a.part AND x.c = a.c
            LEFT JOIN content y ON y.rid = a.rid AND y.part = a.part AND y.c = a.c + 1
        ), sets AS (
            SELECT rid, part, list_sort(list_distinct(list(CAST('0x' || substr(md5(spot), 1, 15) AS BIGINT)))) AS s FROM chains GROUP BY rid, part
        ), likened AS (
            SELECT e.*, coalesce(a.s, []) AS s, coalesce(b.s, []) AS es, coalesce(c.s, []) AS ns
            FROM edits e LEFT JOIN sets a ON a.rid = e.rid AND a.part = 0 LEFT JOIN sets b ON b.rid = e.rid AND b.part = 1
            LEFT JOIN sets c ON c.rid = e.next_rid AND c.part = 0
        ), sizes AS (
            SELECT *, len(list_intersect(s, es)) AS both_edited, len(list_intersect(s, ns)) AS both_next FROM likened
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
            CASE WHEN len(s) > 0 THEN sha256(array_to_string(s, ',')) ELSE '' END AS fingerprint,
            CASE WHEN len(es) > 0 THEN sha256(array_to_string(es, ',')) ELSE '' END AS edited_fingerprint,
            CAST(len(s) AS INTEGER) AS n_signatures,
            CASE WHEN len(s) = 0 THEN -1 ELSE length(CAST(len(s) AS VARCHAR)) - 1 END::INTEGER AS length_class,
            CASE WHEN len(s) = 0 AND len(es) = 0 THEN 1.0
                WHEN len(s) = 0 OR len(es) = 0 OR least(len(s), len(es)) < CAST(0.1 AS DOUBLE) * greatest(len(s), len(es)) THEN 0.0
                ELSE CAST(both_edited AS DOUBLE) / (len(s) + len(es) - both_edited) END::DOUBLE AS near_edited,
            CASE WHEN len(s) = 0 AND len(ns) = 0 THEN 1.0
                WHEN len(s) = 0 OR len(ns) = 0 OR least(len(s), len(ns)) < CAST(0.1 AS DOUBLE) * greatest(len(s), len(ns)) THEN 0.0
                ELSE CAST(both_next AS DOUBLE) / (len(s) + len(ns) - both_next) END::DOUBLE AS near_next
        FROM sizes
    """.replace("{WORD}", WORD).replace("{COMMON}", ", ".join(sorted({f"'{w}'" for ws in COMMON_WORDS.values() for w in ws}))),
    "op12_phrase_mining": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), pieces AS (
            SELECT lang, unnest(list_transform(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS ws FROM docs
        ), words AS (SELECT lang, row_number() OVER () AS pid, ws FROM pieces WHERE len(ws) > 0),
        tokens AS (SELECT lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
        wins AS (
            SELECT lang, w, lead(w, 1) OVER piece AS w2, lead(w, 2) OVER piece AS w3 FROM tokens WINDOW piece AS (PARTITION BY pid ORDER BY i)
        ), counts AS (
            SELECT lang, w AS phrase, 1 AS size, count(*) AS f FROM wins GROUP BY ALL
            UNION ALL SELECT lang, w || ' ' || w2, 2, count(*) FROM wins WHERE w2 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3, count(*) FROM wins WHERE w3 IS NOT NULL GROUP BY ALL
        ), totals AS (SELECT lang, count(*) AS n FROM wins GROUP BY lang),
        keyed AS (SELECT lang || chr(10) || phrase AS key, f FROM counts),
        candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= 10),
        cuts AS (
            SELECT lang, phrase, size, f, ws, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
            FROM candidates, (VALUES (1), (2)) ks(k) WHERE k < size
        ), scored AS (
            SELECT c.lang, c.phrase, c.size, c.ws, c.f AS a, k, x.f AS l, y.f AS r,
                CAST((1000000::HUGEINT * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cuts c JOIN keyed x ON x.key = c.lang || chr(10) || c.lp JOIN keyed y ON y.key = c.lang || chr(10) || c.rp
        ), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, phrase, max(a) AS most
            FROM (
                SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM worst WHERE size = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM worst WHERE size = 3
            ) x GROUP BY lang, phrase
        ), left_over AS (
            SELECT w.* FROM worst w LEFT JOIN longer g ON w.size = 2 AND g.lang = w.lang AND g.phrase = w.phrase
            WHERE g.most IS NULL OR 100 * g.most < 50 * w.a
        )
        SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM left_over o JOIN totals t ON t.lang = o.lang
        QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), tokens AS (SELECT rid, lang, source, unnest(ws) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS c FROM tokens GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
        langs AS (
            SELECT g.lang, count(k.term) AS v, CAST(coalesce(sum(k.c), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang
        ), counts AS (
            SELECT t.lang, t.source, t.term, count(*) AS c FROM tokens t JOIN kept k ON k.lang || chr(10) || k.term = t.lang || chr(10) || t.term GROUP BY t.lang, t.source, t.term
        ), groups AS (
            SELECT d.lang, d.source, CAST(coalesce(sum(c.c), 0) AS HUGEINT) AS n
            FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN counts c ON c.lang = d.lang AND c.source = d.source GROUP BY d.lang, d.source
        ), cells AS (
            SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
                CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * l.v) AS BIGINT) AS p,
                CAST(1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
            FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
            LEFT JOIN counts c ON c.lang || chr(10) || c.source || chr(10) || c.term = g.lang || chr(10) || g.source || chr(10) || k.term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
            FROM cells a JOIN cells b ON b.lang || chr(10) || b.term = a.lang || chr(10) || a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
        ), all_pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
            FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        ), terms AS (
            SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM cells WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, 'pair' AS part, item, value FROM all_pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
        ), numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM numbered WHERE part = 'pair' OR rank <= 10
    """,
}
