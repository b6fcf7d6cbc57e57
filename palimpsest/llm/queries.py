"""The registered queries of this subpackage, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontamination, embedding_dedup, jaccard, licenses, line_dedup, packing, pii, secrets, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"), k=4, threshold=(85, 100))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="n_lines_removed")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_license_scan,
        op3_harmonic_packing,
        op4_jaccard_join,
        op5_line_dedup,
        op6_pii,
        op7_secrets,
        op8_substring_dedup,
        op9_toxicity,
        op10_embedding_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": r"""
        WITH RECURSIVE
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM d),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.c FROM r JOIN p ON r.doc_id = p.a)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.c AS component_id
        FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
    """,
    "op5_line_dedup": r"""
        WITH
        l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3),
        x AS (SELECT doc_id, p, row_number() OVER (PARTITION BY ls[p], ls[p + 1], ls[p + 2] ORDER BY doc_id, p) AS k
              FROM w WHERE NOT (trim(ls[p]) = '' AND trim(ls[p + 1]) = '' AND trim(ls[p + 2]) = '')),
        c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM x WHERE k > 1),
        u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM l)
        SELECT u.doc_id, coalesce(string_agg(u.line, chr(10) ORDER BY u.p) FILTER (WHERE c.p IS NULL), '') AS text,
               count(c.p) AS n_lines_removed
        FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY u.doc_id
        UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
    """,
    "op10_embedding_dedup": """
        WITH RECURSIVE
        v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON r.vec_id = p.a),
        m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.c = e.vec_id AS kept
        FROM embeddings e JOIN m ON e.vec_id = m.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
    """,
}
