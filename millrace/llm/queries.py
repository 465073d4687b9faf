"""The registered queries of the corpus operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_tokens
from .divergence import source_divergence
from .exact import exact_groups
from .html import extract_main
from .jaccard import near_components
from .mixing import mix_sources
from .periodic import periodic_runs
from .pu import fit_scorer, score_texts
from .sharding import shard_documents
from .suffix import remove_repeats
from .topk import top_k
from .vectors import near_vectors

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=10)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(_table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_texts(docs, fit_scorer(docs, _table(spark, sf_dir, "labels"), "quality", "shape"), threshold=0.3)


def op10_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_texts(docs, fit_scorer(docs, _table(spark, sf_dir, "labels"), "toxic", "words"), threshold=0.5)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_hamming, op2_jaccard_join, op3_byte_bpe, op4_exact_dedup, op5_mix_sources, op6_suffix_dedup, op7_html_main_text,
        op8_sharding, op9_quality_pu, op10_toxicity_pu, op11_source_divergence, op12_periodic_runs, op13_near_vectors,
    )
}

ORACLE_SQL = {
    "op1_topk_hamming": """
        WITH v AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbour_id,
                     CAST(list_sum(list_transform(list_zip(q.bits, n.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
              FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
    """,
    "op2_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
        u AS (SELECT doc_id, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
    """,
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
    "op5_mix_sources": """
        WITH RECURSIVE a AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS amount FROM documents GROUP BY source),
        t AS (SELECT sum(CASE WHEN amount > 0 THEN sqrt(amount) END) AS w, sum(amount) AS amount FROM a),
        r AS (SELECT a.source, CASE WHEN a.amount > 0 THEN sqrt(a.amount) / t.w * t.amount / a.amount ELSE 0 END AS rate FROM a, t),
        p AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
              UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < 60),
        u AS (SELECT d.*, CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM documents d),
        n AS (SELECT u.*, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.c <= u.u AND p.rate > 0) AS n FROM u),
        c AS (SELECT n.*, CAST(unnest(range(n.n)) AS INTEGER) AS mix_copy FROM n)
        SELECT doc_id, text, lang, source, n_chars, mix_copy,
               CAST(CAST('0x' || substr(md5('mix/order:' || mix_copy || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS mix_position
        FROM c
    """,
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS df FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS ln FROM c GROUP BY ALL HAVING sum(df) >= 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(ln) AS lang_n FROM k GROUP BY lang),
        x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.ln FROM g JOIN k ON k.lang = g.lang
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        s AS (SELECT lang, source, sum(n) AS group_n FROM x GROUP BY ALL),
        p AS (SELECT x.*, 1 + (1000000000::HUGEINT * (n + 1)) // (s.group_n + v.v) AS p, 1 + (1000000000::HUGEINT * (ln + 1)) // (v.lang_n + v.v) AS q
              FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN v ON v.lang = x.lang),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 200
    """,
    "op12_periodic_runs": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS w,
                          list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                                      lambda s, e: CASE WHEN e < 0 THEN xor(s >> 1, 3988292384 * (s & 1)) ELSE xor(s, e) END) AS s FROM documents),
        h AS (SELECT rid, doc_id, list_filter(w, lambda x: x <> '') AS w, coalesce(xor(s, 4294967295), 1) AS h FROM d),
        n AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM h),
        p AS (SELECT rid, doc_id, n, CASE WHEN h % 10 <> 0 THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS w FROM n),
        x AS (SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM p),
        e AS (SELECT a.rid, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 2),
        s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS stretch FROM e),
        t AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY rid, q, stretch HAVING count(*) >= greatest(q, 12 - q)),
        r AS (SELECT rid, start, length, min(q) AS period FROM t GROUP BY ALL),
        k AS (SELECT x.rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS
              (SELECT 1 FROM r WHERE r.rid = x.rid AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY x.rid),
        l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
                     arg_min(struct_pack(s := start, l := length, q := period), row(-length, start, period)) AS best FROM r GROUP BY rid)
        SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM p LEFT JOIN l ON l.rid = p.rid LEFT JOIN k ON k.rid = p.rid
    """,
    "op13_near_vectors": r"""
        WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        f AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.rid AS a, b.rid AS b FROM f a JOIN f b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        r AS (SELECT rid AS a, rid AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT r.a, min(e.vec_id) AS component_id FROM r JOIN e ON e.rid = r.b GROUP BY r.a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
        FROM e JOIN m ON m.a = e.rid LEFT JOIN n ON n.a = e.rid
    """,
}
