"""The operators' queries over the driver's tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from . import fingerprint, jaccard, kdtree, langid, lm, mixing, packing, quality, repair, sharding, tokencount, warc, whitening
from .common import read

REGISTRY = Registry()

WORDS_SQL = r"len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+'))"


@REGISTRY.query("op1_fingerprint")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(read(spark, sf_dir, "documents"))


@REGISTRY.query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5"""


@REGISTRY.query("op3_top_k", TOP_K_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"))


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL.format("text")} AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix') AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS most FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(most) OVER b, 0) AS DOUBLE) AS rest,
             CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS heavy
      FROM w WINDOW b AS (ORDER BY CAST(most AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * heavy <= rest * weight AS filled FROM l),
t AS (SELECT source, source_size, CASE WHEN filled THEN CAST(most AS DOUBLE)
             ELSE max(CASE WHEN NOT filled THEN rest / heavy END) OVER () * weight END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, quota - begun)) + greatest(0, least(size, quota - begun - source_size)) AS BIGINT) AS taken FROM p"""


@REGISTRY.query("op4_mix", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@REGISTRY.query("op5_pack")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@REGISTRY.query("op6_shard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@REGISTRY.query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit_quality(docs, read(spark, sf_dir, "labels")))


@REGISTRY.query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS kept FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN k.kept IS NULL OR k.kept = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.kept IS DISTINCT FROM p.page_id THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html"""


@REGISTRY.query("op9_warc", WARC_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages")).drop("html")


@REGISTRY.query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_languages(docs))


@REGISTRY.query("op11_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(read(spark, sf_dir, "conversations"))


@REGISTRY.query("op12_lm_score")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(read(spark, sf_dir, "documents"))


@REGISTRY.query("op13_whiten")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read(spark, sf_dir, "embeddings"))


def all_queries() -> Registry:
    return REGISTRY
