"""The registered queries of this subpackage, one for each operator, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import licenses, lines, mixing, negatives, packing, resample, secret_scan, simhash, sketch, tokens, topk, toxicity, whitening
from tidewater.llm.common import documents, share_package


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    share_package(spark)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.exact_top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_documents(documents(spark, folder))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = sketch.edited_fingerprints(documents(spark, folder))
    texts = {"fingerprint": F.lower(F.hex("sketch")), "edited_fingerprint": F.lower(F.hex("edited_sketch"))}
    return found.withColumns(texts).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edited")


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree source/hundreds/name, in which the first of each hundred is the directory's licence file."""
    docs = documents(spark, folder)
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return licenses.licenses(docs.select("doc_id", path.alias("path"), "text"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(documents(spark, folder))
    return found.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines"), "text")


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    share_package(spark)
    rows = negatives.labelled(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return negatives.hard_negatives(rows, rows.where("vec_id % 50 = 0"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    share_package(spark)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", whitening.whole(F.col("embedding")).alias("vector"))
    return whitening.whiten(rows, whitening.fit(rows))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_topk": op2_topk,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_resample": op9_resample,
    "op10_lines": op10_lines,
    "op11_token_counts": op11_token_counts,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

#: The share that no cap binds is found by trying every number of capped sources, in order of cap by weight.
OP5_SQL = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
     src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
     ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM src),
     weighed AS (SELECT *, 1 + r % 3 AS w, 3 * source_size AS cap FROM ranked),
     tried AS (SELECT *, (SELECT CAST(sum(source_size) AS BIGINT) FROM weighed) - coalesce(sum(cap) OVER up, 0) AS left_over, (SELECT CAST(sum(w) AS BIGINT) FROM weighed) - coalesce(sum(w) OVER up, 0) AS share
               FROM weighed WINDOW up AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     level AS (SELECT left_over, share FROM tried WHERE w * left_over <= cap * share ORDER BY cap / w, r LIMIT 1),
     goals AS (SELECT source, source_size, r, least(CAST(cap AS DOUBLE), CAST(left_over AS DOUBLE) * w / CAST(share AS DOUBLE)) AS target FROM weighed, level),
     placed AS (SELECT doc_id, size, source_size, target, r, CAST(round(target) AS BIGINT) AS goal,
                       CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
                FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
     sloped AS (SELECT *, (r % 3 - 1) * 0.5::DOUBLE AS slope, before::DOUBLE / nullif(goal, 0) AS part FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - before - source_size)) + greatest(0, least(size, goal - before - 2 * source_size)) AS BIGINT) AS taken,
       CASE WHEN goal > before THEN 2 * part / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)) ELSE 1 + before / greatest(source_size, 1) END AS position
FROM sloped
"""

#: Templates are compared as text here. Lines of the same text in one document are told apart by their number.
OP10_SQL = """
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
     cut AS (SELECT doc_id, n, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS tokens FROM split),
     masked AS (SELECT doc_id, n, tokens, list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '<*>' ELSE t END) AS m FROM cut WHERE len(tokens) >= 1),
     shaped AS (SELECT doc_id, n, CASE WHEN len(list_filter(m, lambda t: t = '<*>')) < len(m) THEN m ELSE tokens END AS shape FROM masked),
     gone AS (SELECT doc_id, n FROM (SELECT *, min(doc_id) OVER (PARTITION BY shape) AS first FROM shaped) WHERE doc_id > first),
     kept AS (SELECT s.doc_id, list(s.line ORDER BY s.n) FILTER (WHERE g.n IS NULL) AS stay, list(s.n ORDER BY s.n) FILTER (WHERE g.n IS NOT NULL) AS lost FROM split s LEFT JOIN gone g USING (doc_id, n) GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(len(lost), 0) AS BIGINT) AS n_dropped, coalesce(array_to_string(lost, ','), '') AS dropped_lines, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
     placed AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same),
     positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM placed WHERE place <= 5),
     ranked AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
                FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

ORACLE_SQL = {
    "op12_hard_negatives": OP12_SQL,
    "op2_topk": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op10_lines": OP10_SQL,
}
