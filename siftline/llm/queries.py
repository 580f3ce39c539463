"""Registered queries over the training-data operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from siftline.llm import conversation, decontaminate, hard_negatives, language_id, line_dedup, mixing, near_dedup, quality, quality_classifier, secret_scan, sharding, token_output, warc
from siftline.plans.registry import registry
from siftline.session import load, scratch

QUERIES, ORACLES, query = registry()

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_output")
def op1_token_output(spark, sf_dir):
    folder = scratch(spark, "tokens")
    token_output.write_tokens(load(spark, sf_dir, "documents"), folder, TOKENIZER, 0, public_tokenizers.PATTERN)
    return token_output.read_tokens(spark, folder, digest=True)


@query("op2_line_dedup")
def op2_line_dedup(spark, sf_dir):
    return line_dedup.line_report(load(spark, sf_dir, "documents"))


@query("op3_secret_scans")
def op3_secret_scans(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


@query("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), words=3, hundredths=85)


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    found = decontaminate.find_matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("row_hash")


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    out = sharding.write_shards(load(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return out.select(
        "doc_id", F.coalesce(F.octet_length("text") + 1, F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op9_mixing",
    r"""WITH RECURSIVE d AS (
         SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
       s AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY 1),
       total AS (SELECT sum(t)::DOUBLE AS total, 0.9 * ln(count(*) FILTER (t > 0)) AS goal, count(*) FILTER (t > 0) AS k FROM s),
       p AS (SELECT t / total AS p FROM s, total WHERE t > 0),
       bisect(i, low) AS (
         SELECT 0, 0::DOUBLE UNION ALL
         SELECT i + 1, low + CASE WHEN (SELECT ln(sum(pow(p, low + pow(2, -i - 1)))) - (low + pow(2, -i - 1)) *
             sum(pow(p, low + pow(2, -i - 1)) * ln(p)) / sum(pow(p, low + pow(2, -i - 1))) FROM p) >= (SELECT goal FROM total)
           THEN pow(2, -i - 1) ELSE 0 END
         FROM bisect WHERE i < 20),
       e AS (SELECT CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= (SELECT goal FROM total) OR (SELECT k FROM total) = 1 THEN 1.0 ELSE max(low) END AS a FROM bisect),
       m AS (SELECT source, t, CASE WHEN t > 0 THEN pow(t / total, a) ELSE 0 END AS v FROM s, total, e),
       z AS (SELECT sum(v) AS z, ceil(max(CASE WHEN t > 0 THEN t / v * (SELECT sum(v) FROM m) END)) AS budget FROM m),
       q AS (SELECT source, t, v / z AS w, round(v / z * budget)::BIGINT AS quota FROM m, z WHERE t > 0),
       c AS (SELECT *, quota // t AS whole, quota % t AS rest FROM q),
       last AS (SELECT d.doc_id, d.source, n, whole, rest, sum(n) OVER (PARTITION BY d.source
           ORDER BY md5('23:' || whole || ':' || doc_id) RANGE UNBOUNDED PRECEDING) AS upto FROM d JOIN c USING (source)),
       copies AS (SELECT doc_id, source, n, unnest(range(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM last),
       placed AS (SELECT *, epoch * t + coalesce(sum(n) OVER (PARTITION BY source, epoch
           ORDER BY md5('23:' || epoch || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
         FROM copies JOIN c USING (source))
       SELECT doc_id, source, epoch::INT AS epoch, n AS n_tokens, start::BIGINT AS start, floor(start / (w * 1000000.0))::BIGINT AS block,
         md5('24:' || epoch || ':' || doc_id) AS "order" FROM placed""",
)
def op9_mixing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("n_tokens"))
    planned = mixing.plan(docs, "whole", entropy=0.9, tokens=F.col("n_tokens"))
    return mixing.blocks(mixing.apply(docs, planned), planned, block_tokens=1_000_000)


@query(
    "op10_warc",
    """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
         f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
       SELECT page_id, n AS payload_bytes, d AS payload_digest,
         CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""",
)
def op10_warc(spark, sf_dir):
    folder = scratch(spark, "packages")
    warc.write_packages(load(spark, sf_dir, "pages"), folder)
    return warc.read_packages(spark, folder).drop("url")


@query(
    "op11_hard_negatives",
    """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
         FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
       s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
           list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)])::BIGINT AS score
         FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
       p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
       SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank,
         s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
       FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
       QUALIFY rank <= 10""",
)
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantised(load(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    return conversation.report(conversation.repair(conversation.damage(load(spark, sf_dir, "conversations"))))


@query("op13_quality_classifier")
def op13_quality_classifier(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").where(~quality_classifier.held_out())
    model = quality_classifier.fit(docs, labels)
    return quality_classifier.score(docs, model).withColumn("held_out", quality_classifier.held_out()).select("doc_id", "held_out", "score", "predicted")
