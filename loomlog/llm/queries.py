"""The registered queries of the corpus operators; each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, minhash, mixing, packing, secrets, sketches, toxicity, urlfilter, vectors, wavelet
from .common import table

#: Names of the public vocabularies and end ids.
WORD_VOCABULARY, BYTE_VOCABULARY, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet.read(wavelet.write(docs, vocabulary(WORD_VOCABULARY), end_id=1))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(mixing.sized(docs), tie=F.col("text_hash")).select("doc_id", "size", "source_size", "target", "taken")


def op3_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary(BYTE_VOCABULARY), end_id=0, capacity=2048)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_wavelet_tokens, op2_source_mix, op3_best_fit_pack, op4_toxicity, op5_url_filter, op6_secret_scan, op7_html_text, op8_vector_near_dedup, op9_minhash_near_dedup, op10_document_fingerprints)}
ORACLE: dict[str, str] = {
    "op5_url_filter": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), rules(h, p, v) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), fit AS (
            SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
            FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM split s LEFT JOIN fit f ON s.page_id = f.page_id AND f.k = 1
    """,
    "op8_vector_near_dedup": r"""
        WITH RECURSIVE rows AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
        ), usable AS (
            SELECT vec_id, v FROM rows WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach AS (
            SELECT vec_id AS id, vec_id AS other FROM usable
            UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
        ), comp AS (
            SELECT id, min(other) AS c FROM reach GROUP BY id
        ), degree AS (
            SELECT a, count(*) AS n FROM links GROUP BY a
        )
        SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN comp c ON e.vec_id = c.id LEFT JOIN degree d ON e.vec_id = d.a
    """,
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, s, len(s) AS n FROM (
                SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM words)
        ), items AS (
            SELECT doc_id, n, unnest(s) AS shingle FROM sets
        ), rare AS (
            SELECT doc_id, n, shingle, row_number() OVER (PARTITION BY doc_id ORDER BY f, shingle) AS k
            FROM (SELECT *, count(*) OVER (PARTITION BY shingle) AS f FROM items)
        ), heads AS MATERIALIZED (
            SELECT doc_id, n, shingle FROM rare WHERE k <= n - (80 * n + 99) // 100 + 1
        ), likely AS (
            SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
            WHERE 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
        ), near AS MATERIALIZED (
            SELECT a, b FROM likely JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 180 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n)
        ), links AS (
            SELECT a, b FROM near UNION ALL SELECT b, a FROM near
        ), reach AS (
            SELECT doc_id AS id, doc_id AS other FROM documents
            UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
        ), comp AS (
            SELECT id, min(other) AS c FROM reach GROUP BY id
        )
        SELECT s.doc_id, s.n AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM sets s JOIN comp c ON s.doc_id = c.id
    """,
}
