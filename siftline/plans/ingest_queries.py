"""Registered queries over ingest, sources and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import vocab as V
from siftline.operators import ingest as I
from siftline.operators import ranking as R
from siftline.plans.registry import registry
from siftline.plans.sqltext import any_kw
from siftline.session import load
from siftline.sources import catalogs, posts, tables

QUERIES, ORACLES, query = registry()


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("title"), F.col("text").alias("description"),
        F.col("text").alias("full_text"), "source",
    )


@query(
    "hash_dedup",
    """SELECT seq, source FROM (SELECT doc_id AS seq, source,
         row_number() OVER (PARTITION BY md5(lang || text) ORDER BY doc_id) AS rn FROM documents)
       WHERE rn = 1""",
)
def hash_dedup(spark, sf_dir):
    return I.hash_dedup(_docs(spark, sf_dir)).select("seq", "source")


@query(
    "quality_filter",
    "SELECT doc_id AS seq, source FROM documents WHERE length(text) >= 50 AND lang <> '' AND text <> ''",
)
def quality_filter(spark, sf_dir):
    return I.quality_filter(_docs(spark, sf_dir)).select("seq", "source")


_POSTS = """p AS (SELECT p_partkey AS seq, CASE p_size % 3 WHEN 0 THEN 'kaggle' WHEN 1 THEN 'github' ELSE 'direct_input' END AS source,
   p_size / 5.0 AS usability, p_partkey % 97 AS stars, p_name AS title FROM part)"""


def _part_posts(spark, sf_dir):
    size = F.col("p_size")
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.when(size % 3 == 0, "kaggle").when(size % 3 == 1, "github").otherwise("direct_input").alias("source"),
        (size / 5.0).alias("usability"), (F.col("p_partkey") % 97).alias("stars"),
        F.col("p_name").alias("title"),
    )


_ORDER = """CASE WHEN source = 'kaggle' THEN 0 ELSE 1 END, CASE WHEN source = 'kaggle' THEN usability ELSE 0 END {d},
   CASE WHEN source = 'github' THEN stars ELSE 0 END {d}, seq"""


@query(
    "source_priority_sort",
    f"WITH {_POSTS} SELECT seq, source, title FROM p ORDER BY {_ORDER.format(d='')}",
)
def source_priority_sort(spark, sf_dir):
    return I.rank_problems(_part_posts(spark, sf_dir), n=None).select("seq", "source", "title")


@query(
    "top_n_problems",
    f"WITH {_POSTS} SELECT * FROM (SELECT seq, source, title, 'asc' AS direction FROM p ORDER BY {_ORDER.format(d='')} LIMIT 10)"
    f" UNION ALL SELECT * FROM (SELECT seq, source, title, 'desc' AS direction FROM p ORDER BY {_ORDER.format(d='DESC')} LIMIT 10)",
)
def top_n_problems(spark, sf_dir):
    p = _part_posts(spark, sf_dir)
    cols = ("seq", "source", "title")
    low = I.rank_problems(p, n=10).select(*cols, F.lit("asc").alias("direction"))
    high = I.rank_problems(p, n=10, descending=True).select(*cols, F.lit("desc").alias("direction"))
    return low.unionByName(high)


@query(
    "analysed_only",
    """SELECT seq, CASE WHEN failed OR p_size % 2 = 0 THEN title ELSE 'T' || seq END AS title
       FROM (SELECT p_partkey AS seq, p_name AS title, p_size, p_size % 7 = 0 AS failed, p_size % 5 <> 0 AS ok, p_size / 50.0 AS conf FROM part)
       WHERE failed OR (ok AND conf >= 0.6)""",
)
def analysed_only(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    p = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("d").alias("description"))
    size = F.col("p_size")
    a = part.select(
        F.col("p_partkey").alias("id"), (size % 5 != 0).alias("is_ml_problem"), (size / 50.0).alias("confidence"),
        F.struct(
            F.when(size % 2 != 0, F.concat(F.lit("T"), F.col("p_partkey").cast("string"))).alias("title"),
            F.lit(None).cast("string").alias("problem_statement"),
        ).alias("details"),
        (size % 7 == 0).alias("failed"),
    )
    return I.analysed_only(p, a).select(F.col("id").alias("seq"), "title")


# -- catalogs ---------------------------------------------------------------

_CATALOG = """c AS (SELECT p_partkey AS seq, lower(replace(p_brand, '#', '')) AS source, 'part/' || p_partkey AS id,
    CASE WHEN p_size % 11 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS description,
    CASE WHEN p_size % 6 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * 23 END AS size, p_partkey * 7 % 3000 AS download_count,
    p_size / 50.0 AS usability_rating FROM part)"""


def _catalog(spark, sf_dir):
    size = F.col("p_size")
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.lower(F.regexp_replace("p_brand", "#", "")).alias("source"),
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(size % 11 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.when(size % 4 == 0, "").otherwise(F.col("p_type")).alias("description"),
        F.when(size % 6 == 0, 0).otherwise(size.cast("long") * 23).alias("size"),
        (F.col("p_partkey") * 7 % 3000).alias("download_count"), (size / 50.0).alias("usability_rating"),
    )


_KEEP = "(title <> '' OR description <> '') AND (title <> '' OR id <> '') AND NOT (size > 0 AND (size < 100 OR size > 1000000))"


@query(
    "catalog_filter_rank",
    f"""WITH {_CATALOG} SELECT seq, CASE WHEN description = '' THEN source || ' dataset: ' || title ELSE description END AS description,
       round(usability_rating * 0.7 + least(download_count / 1000.0, 1.0) * 0.3, 6) AS score FROM c WHERE {_KEEP} ORDER BY 3 DESC, 1""",
)
def catalog_filter_rank(spark, sf_dir):
    return I.filter_rank_catalog(_catalog(spark, sf_dir), 100, 1_000_000).select(
        "seq", "description", F.round("score", 6).alias("score")
    )


@query(
    "catalog_reject_reasons",
    f"""WITH {_CATALOG} SELECT seq, concat_ws('; ', CASE WHEN title = '' AND description = '' THEN 'no description and no title' END,
       CASE WHEN size > 0 AND (size < 100 OR size > 1000000) THEN 'size ' || size || ' out of range' END) AS reasons FROM c WHERE NOT ({_KEEP})""",
)
def catalog_reject_reasons(spark, sf_dir):
    reasons = I.catalog_reject_reasons(100, 1_000_000)
    return (
        _catalog(spark, sf_dir).withColumn("r", reasons).where(F.size("r") > 0)
        .select("seq", F.array_join("r", "; ").alias("reasons"))
    )


@query(
    "catalog_union",
    """SELECT 'aws_opendata' AS source, 's3://' || s_name AS id, 'AWS Open Data bucket: ' || s_name AS description, 0.5::DOUBLE AS usability_rating FROM supplier
       UNION ALL SELECT 'uci', CAST(c_custkey AS VARCHAR), 'UCI ML Repository: ' || c_name, 0.8 FROM customer
       UNION ALL SELECT 'huggingface', 'hub/' || p_name, p_type, 0.0 FROM part
       UNION ALL SELECT 'kaggle', 'k/' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN 7.5 ELSE 3.0 END FROM orders""",
)
def catalog_union(spark, sf_dir):
    aws = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.lit("climate").alias("keyword"), F.col("s_name").alias("bucket"), F.col("s_name").alias("title"))
    uci = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("uci_id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("keywords"))
    hub = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("hub/"), F.col("p_name")).alias("id"), F.col("p_type").alias("description"),
        F.lit(0).alias("downloads"), F.array("p_brand").alias("tags"))
    even = F.col("o_orderkey") % 2 == 0
    kag = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("k/"), F.col("o_orderkey").cast("string")).alias("ref"),
        F.col("o_orderstatus").alias("title"), F.lit(5).alias("size"), F.lit(3.0).alias("usability"), F.lit(1).alias("downloads"),
        F.array().cast("array<string>").alias("files"),
        F.when(even, F.struct(
            F.lit("m").alias("title"), F.col("o_orderpriority").alias("description"), F.lit(9).alias("totalBytes"),
            F.lit(8).alias("downloadCount"), F.lit(7.5).alias("usabilityRating"), F.array(F.lit("t")).alias("tags"))).alias("meta"))
    parts = [catalogs.normalise_catalog(d, s) for d, s in ((aws, "aws_opendata"), (uci, "uci"), (hub, "huggingface"), (kag, "kaggle"))]
    return I.union_sources(*parts).select("source", "id", "description", "usability_rating")


@query(
    "catalog_resources",
    """SELECT seq, CASE WHEN seq % 3 = 0 THEN 'nm' || seq ELSE 'id' || seq END AS id, substring(text, 1, 500) AS description,
         CASE WHEN seq % 2 = 0 THEN 'u2/' || seq ELSE 'u1/' || seq END AS download_url,
         CASE WHEN seq % 2 = 0 THEN 'u2/' || seq || ',u3/' || seq ELSE 'u1/' || seq END AS files
       FROM (SELECT doc_id AS seq, text FROM documents)""",
)
def catalog_resources(spark, sf_dir):
    n, even = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0

    def res(fmt, url):
        return F.struct(fmt.alias("format"), F.concat(F.lit(url), n).alias("url"))

    raw = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("id"), n)).alias("id"),
        F.concat(F.lit("nm"), n).alias("name"), F.lit("t").alias("title"), F.col("text").alias("notes"),
        F.array(res(F.lit("PDF"), "u1/"), res(F.when(even, "csv").otherwise("XLS"), "u2/"), res(F.when(even, "Json").otherwise("XML"), "u3/")).alias("resources"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("tags"),
    )
    c = catalogs.normalise_catalog(raw, "datagov")
    return c.select("seq", "id", "description", "download_url", F.array_join("files", ",").alias("files"))


@query(
    "indicator_flatten",
    """SELECT o_orderkey, country, year, value FROM (
         SELECT o_orderkey, o_orderpriority AS country, '2001' AS year, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END AS value FROM orders
         UNION ALL SELECT o_orderkey, o_orderstatus, '2002', CAST(o_custkey AS DOUBLE) FROM orders) WHERE value IS NOT NULL""",
)
def indicator_flatten(spark, sf_dir):
    def row(country, year, value):
        return F.struct(F.struct(F.col(country).alias("value")).alias("country"), F.lit(year).alias("date"), value.alias("value"))

    rows = F.to_json(F.array(
        row("o_orderpriority", "2001", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice"))),
        row("o_orderstatus", "2002", F.col("o_custkey").cast("double")),
    ))
    resp = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit('[{"page":1},'), rows, F.lit("]")).alias("response"))
    return tables.flatten_indicator(resp)


@query(
    "catalog_keyword_join",
    """WITH q AS (SELECT c_custkey AS query_id, unnest([lower(c_mktsegment), lower(c_name), 'ring', 'mac']) AS kw FROM customer),
       d AS (SELECT DISTINCT p_partkey AS dataset_id, unnest(string_split(p_name, ' ') || [lower(p_type)]) AS dk FROM part),
       k AS (SELECT DISTINCT kw FROM q), dd AS (SELECT DISTINCT dk FROM d),
       pairs AS (SELECT kw, dk FROM k JOIN dd ON contains(kw, dk) OR contains(dk, kw)),
       hits AS (SELECT DISTINCT kw, dataset_id FROM pairs JOIN d USING (dk))
       SELECT dataset_id, CAST(sum(n) AS BIGINT) AS score FROM (SELECT kw, count(*) AS n FROM q GROUP BY kw) JOIN hits USING (kw) GROUP BY ALL""",
)
def catalog_keyword_join(spark, sf_dir):
    q = load(spark, sf_dir, "customer").select(
        F.lit(0).alias("query_id"),
        F.array(F.lower("c_mktsegment"), F.lower("c_name"), F.lit("ring"), F.lit("mac")).alias("keywords"))
    c = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dataset_id"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("keywords"))
    return I.keyword_scores(q, c).select("dataset_id", "score")


_ASKED = """q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 4 = 0 THEN []::VARCHAR[] ELSE [lower(c_mktsegment),
    CASE c_nationkey % 5 WHEN 0 THEN 'ring' WHEN 1 THEN 'gear box' WHEN 2 THEN 'ol' WHEN 3 THEN 'economy' ELSE 'zzz' END] END AS keywords FROM customer)"""


def _asked(spark, sf_dir):
    n = F.col("c_nationkey") % 5
    word = F.when(n == 0, "ring").when(n == 1, "gear box").when(n == 2, "ol").when(n == 3, "economy").otherwise("zzz")
    some = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("c_mktsegment"), word))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), some.alias("keywords"))


@query(
    "catalog_keyword_search",
    f"""WITH {_ASKED}, d AS (SELECT DISTINCT p_partkey AS dataset_id, unnest(string_split(p_name, ' ') || [lower(p_type)]) AS dk FROM part),
       k AS (SELECT query_id, unnest(keywords) AS kw FROM q),
       pairs AS (SELECT kw, dk FROM (SELECT DISTINCT kw FROM k) JOIN (SELECT DISTINCT dk FROM d) ON contains(kw, dk) OR contains(dk, kw)),
       hits AS (SELECT DISTINCT kw, dataset_id FROM pairs JOIN d USING (dk)),
       s AS (SELECT query_id, dataset_id, count(*) AS score FROM k JOIN hits USING (kw) GROUP BY ALL
         UNION ALL SELECT query_id, p_partkey, 0 FROM q, part WHERE len(keywords) = 0)
       SELECT query_id, dataset_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dataset_id)::INT AS rank FROM s QUALIFY rank <= 3""",
)
def catalog_keyword_search(spark, sf_dir):
    """The three best entries of each query, of which a quarter has no keywords."""
    c = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dataset_id"), F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("keywords"))
    return I.search_entries(_asked(spark, sf_dir), c, 3)


@query(
    "keyword_buckets",
    """WITH q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment || ' ' || c_name) END AS t, c_custkey % 5 = 0 AS every FROM customer)
       SELECT query_id, n_name AS bucket FROM q JOIN nation ON every OR contains(t, CAST(n_nationkey + 10 AS VARCHAR))
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_nationkey) <= 3""",
)
def keyword_buckets(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    asked = c.select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 5 == 0, none).otherwise(F.array("c_mktsegment", "c_name")).alias("keywords"))
    topics = load(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 10).cast("string").alias("keyword"), F.col("n_name").alias("bucket"), F.col("n_nationkey").alias("place"))
    return I.keyword_buckets(asked, topics, 3).select("query_id", "bucket")


@query(
    "keyword_gate",
    f"""SELECT doc_id, list_has_any([lang, lower(source)], ['en', 'web']) AS hit, contains(lang || ' ' || lower(source), 'n w') AS bucket,
          {any_kw('lower(text)', V.COMPETITION_ML)} AS competition, {any_kw("lower(lang || ' ' || text)", V.ISSUE_ML)}
          AND NOT {any_kw("lower(lang || ' ' || text)", V.ISSUE_REJECT)} AS issue FROM documents""",
)
def keyword_gate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", I.any_keyword_of(F.array("lang", "source"), ("en", "web")).alias("hit"),
        I.joined_keyword_text(F.array("lang", "source")).contains("n w").alias("bucket"),
        I.is_ml_competition("text").alias("competition"), I.is_ml_issue("lang", "text").alias("issue"),
    )


@query(
    "issue_posts",
    f"""SELECT 'github_issue_' || doc_id AS id, lang AS title, lang || chr(10) || chr(10) || text AS full_text, 'l1,' || source AS labels
        FROM documents WHERE {any_kw("lower(lang || ' ' || text)", ('el', 'und'))} AND NOT {any_kw("lower(lang || ' ' || text)", ('ui', 'que'))}""",
)
def issue_posts(spark, sf_dir):
    raw = load(spark, sf_dir, "documents").where(I.is_ml_issue("lang", "text", ("el", "und"), ("ui", "que"))).select(
        F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.col("doc_id").alias("number"), F.col("lang").alias("title"),
        F.col("text").alias("body"), F.lit("u").alias("html_url"), F.col("source").alias("repository"),
        F.array(F.struct(F.lit("l1").alias("name")), F.struct(F.col("source").alias("name"))).alias("labels"),
    )
    return posts.normalise_problems(raw, "issue", ml_only=False).select(
        "id", "title", "full_text", F.array_join("labels", ",").alias("labels"))


@query(
    "post_sources",
    f"""SELECT id, source_type, title, description FROM (
      SELECT 'github_repo_' || doc_id AS id, 'readme' AS source_type, lang || ': ML Problem from README' AS title, substring(text, 1, 500) AS description
        FROM documents WHERE {any_kw('lower(text)', V.ISSUE_ML)}
      UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END, text FROM documents
      UNION ALL SELECT p_name, 'competition', p_name, p_type FROM part WHERE {any_kw('lower(p_type)', V.COMPETITION_ML)}
      UNION ALL SELECT 'o/' || p_partkey, 'dataset', p_name, p_type FROM part WHERE p_size >= 40 AND {any_kw("lower(p_name || ' ' || p_type)", V.DATASET_ML)})""",
)
def post_sources(spark, sf_dir):
    docs, part = load(spark, sf_dir, "documents"), load(spark, sf_dir, "part")
    readme = docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.lit("r").alias("full_name"),
                         F.col("text").alias("content"), F.lit("u").alias("html_url"), F.lit(1).alias("stars"))
    direct = docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.col("text").alias("statement"))
    comp = part.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("ref"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    data = part.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("o/"), F.col("p_partkey").cast("string")).alias("ref"), F.col("p_name").alias("title"),
                       F.col("p_type").alias("description"), (F.col("p_size") / 8.0).alias("usability"), F.lit(0).alias("download_count"))
    all_posts = I.union_sources(*[posts.normalise_problems(d, k) for d, k in ((readme, "readme"), (direct, "statement"), (comp, "competition"), (data, "dataset"))])
    return all_posts.select("id", "source_type", "title", "description")


# -- ranks, quotas, samples -------------------------------------------------


@query(
    "quota_per_key",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 4",
)
def quota_per_key(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.first_per_group(ev, ["user_id"], [F.col("value").desc(), "event_id"], 4).select("user_id", "event_id")


@query(
    "cap_per_source",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
       WHERE rn <= CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 10 WHEN 'error' THEN 5 ELSE 20 END""",
)
def cap_per_source(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_type", "event_id")
    return R.cap_per_source(ev, "event_type", ["event_id"], {"click": 20, "view": 10, "error": 5})


@query(
    "exact_sample",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 1000",
)
def exact_sample(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return R.sample_exact(o, "o_orderkey", 1000)


@query(
    "task_category",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'text-classification' WHEN 'fr' THEN 'tabular-regression' WHEN 'de' THEN 'unsupervised' END AS category FROM documents",
)
def task_category(spark, sf_dir):
    task = F.when(F.col("lang") == "en", "classification").when(F.col("lang") == "fr", "regression").when(F.col("lang") == "de", "clustering")
    return load(spark, sf_dir, "documents").select("doc_id", I.task_category(task).alias("category"))


@query(
    "ordered_keywords",
    """SELECT doc_id, string_agg(k, ',' ORDER BY i) AS keywords FROM (
         SELECT doc_id, k, min(i) AS i FROM (SELECT doc_id, unnest([lang, source, lang, 'en']) AS k, unnest([1, 2, 3, 4]) AS i FROM documents) GROUP BY ALL) GROUP BY doc_id""",
)
def ordered_keywords(spark, sf_dir):
    arr = F.array_distinct(F.array("lang", "source", "lang", F.lit("en")))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(arr, ",").alias("keywords"))


@query(
    "drop_null_rows",
    "SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0",
)
def drop_null_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("v"))
    return o.na.drop(subset=["v"]).select("o_orderkey")


@query(
    "assemble_target",
    "SELECT o_orderkey, o_orderpriority, o_totalprice AS target FROM orders",
)
def assemble_target(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return tables.with_target(
        o.select("o_orderkey", "o_orderpriority"), o.select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey")

