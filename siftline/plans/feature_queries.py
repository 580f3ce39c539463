"""Registered queries over feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import features as FX
from siftline.operators import models as MD
from siftline.plans.registry import registry
from siftline.session import load

QUERIES, ORACLES, query = registry()


@query(
    "detect_target",
    """WITH n AS (SELECT count(DISTINCT p_partkey) AS a, count(DISTINCT p_name) AS b FROM part), o AS (SELECT count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b FROM orders)
       SELECT 'part_cls' AS tbl, CASE WHEN a < 20 AND a > 1 THEN 'p_partkey' WHEN b > 1 THEN 'p_name' END AS target FROM n
       UNION ALL SELECT 'orders_cls', CASE WHEN a < 20 AND a > 1 THEN 'o_orderkey' WHEN b < 20 AND b > 1 THEN 'o_custkey' ELSE 'o_orderstatus' END FROM o
       UNION ALL SELECT 'part_reg', 'p_retailprice' UNION ALL SELECT 'vec_cls', 'label'""",
)
def detect_target(spark, sf_dir):
    part, orders, vec = (load(spark, sf_dir, t) for t in ("part", "orders", "embeddings"))
    rows = [
        ("part_cls", FX.detect_target(part, "classification")), ("orders_cls", FX.detect_target(orders, "classification")),
        ("part_reg", FX.detect_target(part, "regression")), ("vec_cls", FX.detect_target(vec, "classification")),
    ]
    return spark.createDataFrame(rows, "tbl string, target string")


_STACK = "(SELECT 'p_name' AS col, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part)"


@query(
    "top_categories",
    f"""WITH c AS (SELECT col, value, count(*) AS n FROM {_STACK} GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rn FROM c) SELECT col, value, n FROM r WHERE rn <= 50""",
)
def top_categories(spark, sf_dir):
    v = FX.value_counts(load(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return v.select(F.col("column").alias("col"), "value", F.col("count").alias("n"))


@query(
    "cap_categories",
    """WITH t AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 50)
       SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM t) THEN p_name ELSE 'other' END AS p_name, p_brand FROM part""",
)
def cap_categories(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return FX.cap_categories(part, FX.top_categories(part, ["p_name", "p_brand"]))


@query(
    "ordinal_encode",
    """WITH x AS (SELECT p_partkey, coalesce(CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_brand END, 'nan') AS b, p_type AS t FROM part)
       SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY b) - 1 AS INTEGER) AS b, CAST(dense_rank() OVER (ORDER BY t) - 1 AS INTEGER) AS t FROM x""",
)
def ordinal_encode(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).alias("b"), F.col("p_type").alias("t"))
    return FX.ordinal_encode(part, ["b", "t"])


@query(
    "onehot_dropfirst",
    "SELECT p_partkey, 't_' || p_type AS feature FROM part WHERE p_type <> (SELECT min(p_type) FROM part)",
)
def onehot_dropfirst(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("t"))
    wide = FX.onehot(part, FX.onehot_levels(part, ["t"]))
    feats = [c for c in wide.columns if c != "p_partkey"]
    return FX.stacked(wide, feats, "int", keep=["p_partkey"]).where("value = 1").select("p_partkey", F.col("column").alias("feature"))


_GAPS = "g AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority END AS prio FROM orders)"


@query(
    "impute_median_mode",
    f"""WITH {_GAPS} SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM g)), 6) AS price,
        coalesce(prio, (SELECT prio FROM g WHERE prio IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, prio LIMIT 1)) AS prio FROM g""",
)
def impute_median_mode(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderpriority")).alias("prio"))
    fills = FX.fill_values(o.drop("o_orderkey"))
    return FX.impute(o, fills).select("o_orderkey", F.round("price", 6).alias("price"), "prio")


@query(
    "impute_mean",
    f"WITH {_GAPS} SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM g)), 4) AS price FROM g",
)
def impute_mean(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")).alias("price"))
    return FX.impute_mean(o, ["price"]).select("o_orderkey", F.round("price", 4).alias("price"))


@query(
    "distinct_levels",
    "SELECT 'l_returnflag' AS col, count(DISTINCT l_returnflag) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem",
)
def distinct_levels(spark, sf_dir):
    got = FX.distinct_counts(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_quantity", "l_suppkey"])
    return spark.createDataFrame(list(got.items()), "col string, n bigint")


@query(
    "stratified_split",
    """SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id)
         <= ceil(0.2 * count(*) OVER (PARTITION BY quality) - 1e-9) AS is_test FROM labels""",
)
def stratified_split(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return FX.split(lab, "doc_id", "quality").select("doc_id", "is_test")


@query(
    "train_rest",
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
       WHERE rn > ceil(0.2 * n - 1e-9)""",
)
def train_rest(spark, sf_dir):
    return FX.split(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").where("not is_test").select("o_orderkey")


_ANOVA = """WITH x AS (SELECT l_returnflag AS c, {f}::DOUBLE AS v FROM lineitem), g AS (SELECT c, count(v) AS n, avg(v) AS m, var_pop(v) * count(v) AS w FROM x GROUP BY c),
  t AS (SELECT sum(n) AS n, count(*) AS k, sum(w) AS ssw, sum(n * m) / sum(n) AS gm FROM g)
  SELECT '{f}' AS feature, (SELECT sum(g.n * pow(g.m - gm, 2)) FROM g) / (k - 1) / (ssw / (n - k)) AS f FROM t"""


@query(
    "anova_f",
    "SELECT feature, round(f, 4) AS f_value FROM (" + ") UNION ALL SELECT feature, round(f, 4) FROM (".join(_ANOVA.format(f=f) for f in ("l_quantity", "l_discount", "l_tax")) + ")",
)
def anova_f(spark, sf_dir):
    a = FX.anova_f(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag")
    return a.select("feature", F.round("f_value", 4).alias("f_value"))


def _scaled(c: str) -> str:
    q1, q2, q3 = (f"(SELECT quantile_cont({c}, {p}) FROM lineitem)" for p in (0.25, 0.5, 0.75))
    return f"round(({c} - {q2}) / CASE WHEN {q3} - {q1} = 0 THEN 1 ELSE {q3} - {q1} END, 6) AS {c}"


@query(
    "robust_scale",
    f"SELECT l_orderkey, l_linenumber, {_scaled('l_quantity')}, {_scaled('l_extendedprice')} FROM lineitem",
)
def robust_scale(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    cols = ["l_quantity", "l_extendedprice"]
    s = FX.robust_scale(li, FX.robust_stats(li, cols))
    return s.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "bracket_quantiles",
    """SELECT 'l_extendedprice' AS col, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.9) AS q3 FROM lineitem
       UNION ALL SELECT 'l_tax', quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.9) FROM lineitem""",
)
def bracket_quantiles(spark, sf_dir):
    """The way taken by large tables, on this one."""
    got = FX.exact_quantiles(load(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"], (0.25, 0.5, 0.9), direct_rows=0)
    return spark.createDataFrame([(c, *v) for c, v in got.items()], "col string, q1 double, q2 double, q3 double")


@query(
    "class_imbalance",
    "SELECT min(n) AS smallest, max(n) AS largest, round(max(n) / min(n), 6) AS ratio FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)",
)
def class_imbalance(spark, sf_dir):
    return FX.class_balance(load(spark, sf_dir, "labels"), "quality").withColumn("ratio", F.round("ratio", 6))


@query("column_align", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, 0) AS size, 0 AS extra FROM part")
def column_align(spark, sf_dir):
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"))
    return FX.align_columns(part, ["p_partkey", "size", "extra"])


@query("smote")
def smote(spark, sf_dir):
    """Documents with a quality label, grown to equal classes."""
    return FX.smote(documents_table(spark, sf_dir).select("doc_id", "quality", F.array("n_chars", "n_words", "punct_ratio").alias("vec")), "doc_id", "quality")


def documents_table(spark, sf_dir):
    """documents joined with labels: a small table with numbers, text and two uneven classes."""
    docs, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    punct = F.length("text") - F.length(F.regexp_replace("text", r"[.,;:!?]", ""))
    return docs.join(lab, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("n_words"),
        (punct / F.greatest(F.col("n_chars"), F.lit(1))).alias("punct_ratio"), "lang", "quality")


@query(
    "documents_table",
    r"""SELECT doc_id, n_chars::DOUBLE AS n_chars, len(regexp_split_to_array(trim(text), '\s+'))::DOUBLE AS n_words,
        round((length(text) - length(regexp_replace(text, '[.,;:!?]', '', 'g'))) / greatest(n_chars, 1), 6) AS punct_ratio, lang, quality FROM documents JOIN labels USING (doc_id)""",
)
def documents_features(spark, sf_dir):
    return documents_table(spark, sf_dir).withColumn("punct_ratio", F.round("punct_ratio", 6))


_KNN = """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
  d AS (SELECT a.id, b.id AS nb, b.label, list_distance(a.e, b.e) AS dist FROM v a CROSS JOIN v b),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rn FROM d)"""


@query(
    "knn_classify",
    _KNN + " SELECT id, label::DOUBLE AS prediction FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS k FROM r WHERE rn <= 7 GROUP BY id, label) WHERE k = 1",
)
def knn_classify(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), F.col("embedding").alias("vec"))
    return MD.knn_predict(v, v, 7)


@query("knn_regress", _KNN + " SELECT id, round(avg(label), 6) AS prediction FROM r WHERE rn <= 5 GROUP BY id")
def knn_regress(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), F.col("embedding").alias("vec"))
    return MD.knn_predict(v, v, 5, "regression").withColumn("prediction", F.round("prediction", 6))
