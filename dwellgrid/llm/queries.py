"""Each operator on the driver's tables, with its production parameters, and its SQL answer where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm import (
    decontamination, embeddings, html, near_copies, negatives, pieces, pii, resampling, sharding, substrings, tokens, toxicity, warc,
)
from dwellgrid.llm.common import identified, table
from dwellgrid.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ANSWERS: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 2048
SHARDS = 8


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query
def op2_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.groups(table(spark, folder, "documents")).drop("node")


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove(table(spark, folder, "documents"))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, folder, "documents"), pieces.model_path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_copies(table(spark, folder, "embeddings"))


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), pieces.model_path(PIECES), digest=True)


@query
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages"))


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = new_folder(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive)
    return warc.payloads(warc.read(spark, archive))


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors, key = table(spark, folder, "embeddings"), F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), anchors=key % 50 == 0)


@query
def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = identified(table(spark, folder, "documents"), "doc_id", "text")
    crc = F.crc32(F.col("text").cast("binary"))
    sized = docs.select("doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), crc.alias("text_crc32"))
    dealt = sharding.shuffle(sized, SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ANSWERS["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
         sha256(coalesce(html, '')) AS digest
  FROM pages),
g AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND n >= 100
"""

ANSWERS["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 3
"""
ANSWERS["op12_resampling"] = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
words AS (
  SELECT doc_id, true AS mine, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT NULL, false, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
known AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
bucketed AS (
  SELECT w, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
                lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS BIGINT)])), 4294967295) % 10000 AS b
  FROM known, crc),
counts AS (SELECT b, count(*) FILTER (mine) AS s, count(*) FILTER (NOT mine) AS t FROM words JOIN bucketed USING (w) GROUP BY b),
gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM counts),
weighed AS (
  SELECT doc_id, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM words JOIN bucketed USING (w) JOIN gain USING (b) WHERE mine GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents AS d LEFT JOIN weighed USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed
"""
