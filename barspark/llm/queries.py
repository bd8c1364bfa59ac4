"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barspark.llm import codebooks, decontaminate, embeddings, interpolation, jaccard, language, licenses, lines, mixing, sharding, spans, warc, whitening
from barspark.llm.common import materialize, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
        return materialize(decontaminate.digest(found), outer=True)


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dg AS (SELECT doc_id, q, n, array_to_string(w[q:q + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS q FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, q, n, item_id FROM dg JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(q, q + n)) AS p FROM (SELECT DISTINCT doc_id, q, n FROM hit)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""



def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_table(spark, sf_dir, "documents")).drop("tk")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over web pages, where the evidence is the lang attribute, the suffix and the host."""
    return language.identify_pages(_table(spark, sf_dir, "pages"), language.fit(_table(spark, sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.archive(_table(spark, sf_dir, "pages")))


_B32 = " || ".join(f"translate(to_base(CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in range(4))

OP4_SQL = f"""
WITH p AS (SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id, {_B32} AS payload_digest FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[^:/]+://', '') AS rest FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(rest, '^[^/]*')), '^www[.]', ''), '.')), ',') || ')' || regexp_replace(rest, '^[^/]*', '') AS url_key, true AS digest_ok
FROM u
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return materialize(mixing.digest(mixing.mix(_table(spark, sf_dir, "documents"))), outer=True)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
h AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, d.doc_id = class_id AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.a = d.doc_id
"""


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x <> 0)) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign_shards(_table(spark, sf_dir, "documents"), 8))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op13_compress_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.digest(codebooks.compress(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "page_languages": page_languages,
    "op3_license_scan": op3_license_scan,
    "op4_warc": op4_warc,
    "op5_mix_sources": op5_mix_sources,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_line_dedup": op10_line_dedup,
    "op11_shard_documents": op11_shard_documents,
    "op12_whiten": op12_whiten,
    "op13_compress_vectors": op13_compress_vectors,
}

ORACLE = {
    "op1_decontaminate": OP1_SQL,
    "op3_license_scan": licenses.oracle_sql(),
    "op4_warc": OP4_SQL,
    "op5_mix_sources": mixing.oracle_sql(),
    "op6_jaccard_join": OP6_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op13_compress_vectors": codebooks.oracle_sql(),
}
