"""Registered queries over answers, metrics and run analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import answers as A
from siftline.functions import vocab as V
from siftline.operators import evaluate as E
from siftline.operators import ranking as R
from siftline.operators import runlog as L
from siftline.operators import triage as TR
from siftline.plans import corpus
from siftline.plans.registry import registry
from siftline.plans.sqltext import any_kw
from siftline.plans.triage_queries import ALL_SQL
from siftline.session import load

QUERIES, ORACLES, query = registry()


# -- answers ----------------------------------------------------------------


@query(
    "answer_parse_json",
    """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'classification' WHEN 1 THEN 'regression' WHEN 2 THEN 'other' WHEN 4 THEN 'clustering' END AS task_type,
         CASE WHEN o_custkey % 5 <> 3 THEN round(o_totalprice / 1000000, 6) END AS confidence,
         CASE WHEN o_custkey % 5 <> 3 THEN o_orderkey % 2 = 0 END AS feasible FROM orders""",
)
def answer_parse_json(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    case = F.col("o_custkey") % 5
    kind = F.when(case == 0, "Classifier").when(case == 1, "regression").when(case == 2, "ranking").otherwise("Cluster analysis")
    body = F.to_json(F.struct((F.col("o_orderkey") % 2 == 0).alias("feasible"), kind.alias("task_type"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence")))
    text = F.when(case == 3, F.lit("No {answer} here")).otherwise(F.concat(F.lit("Sure, here it is:\n"), body, F.lit("\nHope it helps.")))
    p = A.parse_answers(o.select("o_orderkey", text.alias("response_text")), A.KIND_JSON)
    return p.select("o_orderkey", "answer.task_type", "answer.confidence", "answer.feasible")


@query(
    "answer_parse_canonical",
    """SELECT o_orderkey, CASE c WHEN 0 THEN 'rejected' WHEN 1 THEN 'invalid' WHEN 2 THEN 'unknown' ELSE lower(o_orderpriority) END AS problem_type,
        c > 2 AS is_ml_problem, CASE c WHEN 3 THEN 0.7 WHEN 4 THEN 0.8 WHEN 5 THEN 0.9 WHEN 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
        CASE WHEN c > 2 OR c = 1 THEN o_orderstatus END AS target FROM (SELECT *, o_custkey % 7 AS c FROM orders)""",
)
def answer_parse_canonical(spark, sf_dir):
    c = F.col("o_custkey") % 7
    body = F.to_json(F.struct(
        F.when(c > 2, F.col("o_orderpriority")).alias("problem_type"), F.col("o_orderstatus").alias("target_variable"),
        F.when(c > 2, F.array(F.lit("a"), F.lit("b"))).alias("input_features"), F.when(c > 3, F.lit("use")).alias("intended_use"),
        F.when(c > 4, F.lit("src")).alias("data_source"), F.when(c > 5, F.lit("acc")).alias("evaluation_metric")))
    text = F.when(c == 0, F.concat(F.lit("Rejected: no. "), body)).when(c == 2, F.lit("{not json}")).otherwise(F.concat(F.lit("Result "), body))
    p = A.parse_answers(load(spark, sf_dir, "orders").select("o_orderkey", text.alias("response_text")), A.KIND_CANONICAL)
    return p.select("o_orderkey", "problem_type", "is_ml_problem", F.round("confidence", 6).alias("confidence"), F.col("canonical.target_variable").alias("target"))


@query(
    "answer_parse_sections",
    f"""SELECT doc_id, c > 0 AND (c < 3 OR ({any_kw('lower(text)', V.ANSWER_ML)} AND len(text) > 100)) AS is_ml_problem,
         CASE c WHEN 1 THEN 0.8 WHEN 2 THEN 1.0 ELSE CASE WHEN c = 3 AND {any_kw('lower(text)', V.ANSWER_ML)} AND len(text) > 100 THEN 0.5 ELSE 0.0 END END::DOUBLE AS confidence,
         CASE c WHEN 0 THEN 'rejected' WHEN 2 THEN source ELSE 'unknown' END AS problem_type,
         CASE WHEN c IN (1, 2) THEN lang END AS title FROM (SELECT *, doc_id % 4 AS c FROM documents)""",
)
def answer_parse_sections(spark, sf_dir):
    c = F.col("doc_id") % 4
    nl = F.lit("\n")
    head = F.concat(F.lit("### ML Problem Title:\n"), F.col("lang"), F.lit("\n\n## problem statement\n"), F.lit("Say it."), nl)
    more = F.concat(F.lit("### Problem Type:\n"), F.upper("source"), F.lit("\n### Target Variable\ny\n### Input Features: \n a, b \n---\n"))
    text = F.when(c == 0, F.concat(F.lit("rejected: "), F.col("text"))).when(c == 1, head).when(c == 2, F.concat(head, more, F.col("text"))).otherwise(F.col("text"))
    p = A.parse_answers(load(spark, sf_dir, "documents").select("doc_id", text.alias("response_text")), A.KIND_SECTIONS)
    return p.select("doc_id", "is_ml_problem", F.round("confidence", 6).alias("confidence"), "problem_type", "details.title")


@query(
    "merge_canonical",
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Predict ' || c_mktsegment || ' using a, b, c' ELSE c_name END AS full_text,
        CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'target' END AS target_variable,
        CASE WHEN c_nationkey % 2 = 0 THEN '' END AS intended_use FROM customer""",
)
def merge_canonical(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_text"), F.col("c_name").alias("description"))
    none = F.lit(None).cast("string")
    canon = F.struct(F.lit("regression").alias("problem_type"), F.col("c_mktsegment").alias("target_variable"),
                     F.array(*[F.lit(x) for x in "abcd"]).alias("input_features"), none.alias("intended_use"), none.alias("data_source"), none.alias("evaluation_metric"))
    a = c.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("id"), canon.alias("canonical"))
    return TR.merge_canonical(p, a).select(F.col("id").alias("c_custkey"), "full_text", "target_variable", "intended_use")


@query(
    "classify_with_answers",
    """SELECT p_partkey, CASE WHEN p_size > 35 AND ok THEN 'clustering' ELSE 'none' END AS task_type,
         CASE WHEN p_size > 35 AND ok THEN round(p_size / 50.0, 6) ELSE 0.3 END AS confidence FROM (SELECT *, p_size / 50.0 >= 0.7 AS ok FROM part)""",
)
def classify_with_answers(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    p = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("full_text"))
    none = F.array().cast("array<string>")
    a = part.where("p_size > 35").select(F.col("p_partkey").alias("id"), F.struct(
        F.lit(True).alias("feasible"), F.lit("clustering").alias("task_type"), (F.col("p_size") / 50.0).alias("confidence"),
        none.alias("key_features"), F.lit("r").alias("reasoning"), F.lit(False).alias("is_discussion")).alias("answer"))
    return TR.classify(p, a).select(F.col("id").alias("p_partkey"), "ml_classification.task_type", F.round("ml_classification.confidence", 6).alias("confidence"))


# -- reports ----------------------------------------------------------------


def _decisions(spark, sf_dir):
    d = TR.triage(corpus.posts(spark, sf_dir))
    return d.select("seq", "decision.decision", "decision.category", "decision.reasoning", "decision.recommended_action")


@query(
    "rejection_report",
    ALL_SQL + """, r AS (SELECT category, reasoning, recommended_action, count(*) AS n FROM decided WHERE decision = 'do_not_train' GROUP BY ALL)
      SELECT *, CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS category_n FROM r""",
)
def rejection_report(spark, sf_dir):
    return L.rejection_report(_decisions(spark, sf_dir))


@query("rejection_counts", ALL_SQL + " SELECT category, count(*) AS n FROM decided WHERE decision = 'do_not_train' GROUP BY ALL")
def rejection_counts(spark, sf_dir):
    return L.rejection_counts(_decisions(spark, sf_dir))


@query(
    "rejection_samples",
    ALL_SQL + ' SELECT seq + 1 AS "index", category, reasoning, recommended_action FROM decided WHERE decision = \'do_not_train\' ORDER BY seq LIMIT 20',
)
def rejection_samples(spark, sf_dir):
    return L.rejection_samples(_decisions(spark, sf_dir))


@query(
    "stage_summary",
    ALL_SQL + """ SELECT lang, count(*) AS evaluated, count(*) FILTER (decision = 'train') AS approved,
        count(*) FILTER (decision <> 'train') AS rejected FROM decided GROUP BY lang""",
)
def stage_summary(spark, sf_dir):
    d = TR.triage(corpus.posts(spark, sf_dir)).select("lang", "decision.decision")
    return L.stage_summary(d, ["lang"])


_STAGE = "CASE event_type WHEN 'click' THEN 'Problem Mining' WHEN 'view' THEN 'Dataset Matching' WHEN 'error' THEN NULL WHEN 'signup' THEN 'ML Feasibility Classification (Secondary Validation)' ELSE 'Model Training' END"


def _markers(spark, sf_dir):
    t = F.col("event_type")
    stage = (
        F.when(t == "click", "Problem Mining").when(t == "view", "Dataset Matching").when(t == "error", None)
        .when(t == "signup", "ML Feasibility Classification (Secondary Validation)").otherwise("Model Training")
    )
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("line_no"), stage.alias("stage"))


_LATENCY = f"""lat AS (SELECT * FROM (SELECT user_id AS run_id, event_id, {_STAGE} AS stage,
    epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events) WHERE us IS NOT NULL AND stage IS NOT NULL)"""


@query("stage_latency", f"WITH {_LATENCY} SELECT run_id, stage, round(us / 1e6, 6) AS seconds FROM lat")
def stage_latency(spark, sf_dir):
    return L.stage_latency(_markers(spark, sf_dir)).select("run_id", "stage", F.round("seconds", 6).alias("seconds"))


@query(
    "mean_latency",
    f"""WITH {_LATENCY} SELECT CASE WHEN contains(lower(stage), 'feasibility') THEN 'feasibility' WHEN stage = 'Dataset Matching' THEN 'dataset_matching' ELSE 'training' END AS canonical,
      round(avg(us / 1e6), 3) AS mean_seconds, count(*) AS n FROM lat WHERE stage <> 'Problem Mining' GROUP BY 1""",
)
def mean_latency(spark, sf_dir):
    return L.mean_latency(L.stage_latency(_markers(spark, sf_dir))).select("canonical", F.round("mean_seconds", 3).alias("mean_seconds"), "n")


# Runs: one per order for the funnel.
_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey % 2 = 0 AS s1, o_custkey % 3 <> 0 AS s2, o_custkey % 5 <> 0 AS s3, o_custkey % 7 <> 0 AS s4, o_custkey % 11 <> 0 AS s5,
    CASE WHEN o_orderstatus = 'F' THEN o_custkey % 4 END AS total, o_orderdate AS t0, o_orderdate + to_seconds(CAST(o_custkey % 50 - 10 AS BIGINT)) AS t1 FROM orders)"""


def _runs(spark, sf_dir):
    k = F.col("o_custkey")

    def ok(cond):
        return F.struct(cond.alias("success"))

    gate = F.struct(
        F.struct(F.when(k % 6 == 0, "news_announcement").otherwise("predictive_ml_task").alias("category")).alias("intent"),
        F.struct((k % 6 != 1).alias("feasible")).alias("feasibility"), F.struct((k % 6 != 2).alias("valid")).alias("causal_validity"),
        F.struct((k % 6 != 3).alias("justified")).alias("justification"))
    decision = F.struct(F.when(k % 6 == 5, "train").otherwise("do_not_train").alias("decision"), F.lit("c").alias("category"), gate.alias("gate_results"))
    decisions = F.when(F.col("o_orderstatus") != "P", F.array(decision))
    stages = F.struct(
        F.struct((k % 2 == 0).alias("success"), decisions.alias("decisions")).alias("ml_decision"), ok(k % 3 != 0).alias("feasibility"),
        ok(k % 5 != 0).alias("dataset_discovery"), ok(k % 7 != 0).alias("training"), ok(k % 11 != 0).alias("testing"))
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("start_time"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=k % 50 - 10)).alias("end_time"), (k % 2 == 0).alias("success"),
        F.when(F.col("o_orderstatus") == "F", k % 4).alias("total_problems_evaluated"), stages.alias("stages"))


@query(
    "success_funnel",
    f"""WITH {_RUNS} SELECT CAST(sum(coalesce(total, 1)) AS BIGINT) AS total, count(*) FILTER (s1) AS logic_decision, count(*) FILTER (s1 AND s2) AS feasibility,
      count(*) FILTER (s1 AND s2 AND s3) AS dataset_discovery, count(*) FILTER (s1 AND s2 AND s3 AND s4) AS training,
      count(*) FILTER (s1 AND s2 AND s3 AND s4 AND s5) AS testing FROM runs""",
)
def success_funnel(spark, sf_dir):
    return L.success_funnel(_runs(spark, sf_dir))


@query(
    "gate_funnel",
    """WITH r AS (SELECT o_custkey AS k, o_orderstatus <> 'P' AS dec, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 4 ELSE 0 END AS total FROM orders),
       c AS (SELECT sum(total) + count(*) FILTER (NOT dec AND k % 2 = 0) AS ev, count(*) FILTER (NOT dec AND k % 2 = 0) AS da,
         count(*) FILTER (dec AND k % 6 IN (0, 4)) AS i, count(*) FILTER (dec AND k % 6 = 1) AS f, count(*) FILTER (dec AND k % 6 = 2) AS c, count(*) FILTER (dec AND k % 6 = 5) AS a FROM r)
       SELECT CAST(ev AS BIGINT) AS evaluated, CAST(ev - i AS BIGINT) AS intent_valid, CAST(ev - i - f AS BIGINT) AS feasible, CAST(ev - i - f - c AS BIGINT) AS causal_valid, a + da AS approved FROM c""",
)
def gate_funnel(spark, sf_dir):
    return L.gate_funnel(_runs(spark, sf_dir))


@query(
    "run_duration",
    f"WITH {_RUNS} SELECT round(avg(d), 6) AS mean_seconds, count(*) AS n FROM (SELECT (epoch_us(t1) - epoch_us(t0)) / 1e6 AS d FROM runs) WHERE d > 0",
)
def run_duration(spark, sf_dir):
    return L.run_duration(_runs(spark, sf_dir)).select(F.round("mean_seconds", 6).alias("mean_seconds"), "n")


def _models(spark, sf_dir):
    """A model registry with one entry per part; a regression for large parts."""
    s = F.col("p_size")
    reg = s > 30
    m = F.struct(
        F.when(reg, "regression").otherwise("classification").alias("task_type"), F.col("p_brand").alias("best_model"),
        F.when(~reg, (s - 3) / 50.0).alias("accuracy"), F.when(~reg, s / 60.0).alias("precision"), F.when(~reg & (s % 2 == 0), s / 70.0).alias("recall"),
        F.lit(None).cast("double").alias("f1_score"), F.when(reg, (s - 35) / 50.0).alias("r2"))
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("registry_seq"), F.when(reg, "regression").otherwise("classification").alias("task_type"),
        F.array(m).alias("metrics"), (s % 4).alias("train_count"), (s % 3).cast("long").alias("seen_count"),
        F.struct(F.when(s % 5 == 0, F.concat(F.lit("synthetic_"), F.col("p_name"))).when(s % 5 == 1, F.concat(F.lit("a/"), F.col("p_name"))).otherwise(F.col("p_name")).alias("id"),
                 F.when(s % 5 == 2, "from Kaggle").otherwise("x").alias("description")).alias("dataset"))


_METRIC = """m AS (SELECT 'accuracy' AS metric, CASE WHEN p_size > 30 THEN (p_size - 35) / 50.0 ELSE (p_size - 3) / 50.0 END AS v FROM part
  UNION ALL SELECT 'precision', p_size / 60.0 FROM part WHERE p_size <= 30
  UNION ALL SELECT 'recall', p_size / 70.0 FROM part WHERE p_size <= 30 AND p_size % 2 = 0
  UNION ALL SELECT 'r2_score', (p_size - 35) / 50.0 FROM part WHERE p_size > 30)"""


@query(
    "metric_summary",
    f"""WITH {_METRIC} SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v)::DOUBLE, 6) AS low, round(max(v)::DOUBLE, 6) AS high, count(*) AS n
        FROM m WHERE v <> 0 GROUP BY metric""",
)
def metric_summary(spark, sf_dir):
    s = L.metric_summary(_models(spark, sf_dir))
    return s.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")], "n")


@query(
    "metric_defaults",
    f"""WITH {_METRIC}, d AS (SELECT unnest({list(V.METRIC_DEFAULTS)}) AS metric, unnest({list(V.METRIC_DEFAULTS.values())})::DOUBLE AS fallback),
        a AS (SELECT metric, avg(v) AS mean, count(*) AS n FROM m WHERE v > 0 GROUP BY metric)
        SELECT metric, round(coalesce(mean, fallback), 6) AS mean, coalesce(n, 0) AS n FROM d LEFT JOIN a USING (metric)""",
)
def metric_defaults(spark, sf_dir):
    s = L.metric_summary(_models(spark, sf_dir), positive_only=True, defaults=V.METRIC_DEFAULTS)
    return s.select("metric", F.round("mean", 6).alias("mean"), "n")


@query("model_share", "SELECT p_brand AS model, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def model_share(spark, sf_dir):
    return R.share(L.best_models(_models(spark, sf_dir)), "model").select("model", "n", F.round("share", 6).alias("share"))


@query(
    "task_share",
    "SELECT CASE WHEN p_size > 30 THEN 'regression' ELSE 'classification' END AS task_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1",
)
def task_share(spark, sf_dir):
    return R.share(_models(spark, sf_dir), "task_type").select("task_type", "n", F.round("share", 6).alias("share"))


@query(
    "source_share",
    """SELECT s AS source, count(p_partkey) AS n FROM (SELECT unnest(['Kaggle', 'Synthetic', 'Other']) AS s)
       LEFT JOIN part ON s = CASE p_size % 5 WHEN 0 THEN 'Synthetic' WHEN 1 THEN 'Kaggle' WHEN 2 THEN 'Kaggle' ELSE 'Other' END GROUP BY 1""",
)
def source_share(spark, sf_dir):
    return L.source_share(_models(spark, sf_dir).select("dataset.id", "dataset.description"))


@query(
    "registry_stats",
    """SELECT count(*) AS total_problems, CAST(sum(p_size % 3) AS BIGINT) AS total_seen_count, count(*) FILTER (p_size % 3 = 1) AS unique_problems,
       count(*) FILTER (p_size % 3 <> 1) AS duplicate_problems FROM part""",
)
def registry_stats(spark, sf_dir):
    return L.problem_registry_stats(_models(spark, sf_dir))


@query(
    "model_registry_stats",
    "SELECT count(*) AS total_entries, CAST(sum(p_size % 4) AS BIGINT) AS total_trainings, count(*) FILTER (p_size % 4 >= 2) AS duplicate_models FROM part",
)
def model_registry_stats(spark, sf_dir):
    return L.model_registry_stats(_models(spark, sf_dir))


# -- metrics ----------------------------------------------------------------

_PRED = """p AS (SELECT event_id AS id, user_id % 4 AS label, CASE WHEN value < 20 THEN user_id % 4 WHEN value < 40 THEN (user_id + 1) % 4 ELSE 5 END AS prediction, value, event_type FROM events)"""
_CLASS = f"""{_PRED}, k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
 t AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS said, count(*) FILTER (label = c AND prediction = c) AS hit FROM k CROSS JOIN p GROUP BY c),
 s AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM t),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM s)"""


def _preds(spark, sf_dir):
    u, v = F.col("user_id"), F.col("value")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (u % 4).alias("label"),
        F.when(v < 20, u % 4).when(v < 40, (u + 1) % 4).otherwise(5).alias("prediction"), "value", "event_type")


@query(
    "weighted_metrics",
    f"""WITH {_CLASS} SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1_score * support) / sum(support), 6) AS f1_score, CAST(sum(support) AS BIGINT) AS n FROM f""",
)
def weighted_metrics(spark, sf_dir):
    m = E.classification_metrics(_preds(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")], "n")


@query(
    "classification_report",
    f"""WITH {_CLASS}, r AS (SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1_score, support FROM f
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM f
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support) FROM f
      UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f)
      SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM r""",
)
def classification_report(spark, sf_dir):
    m = E.classification_report(_preds(spark, sf_dir))
    return m.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query(
    "regression_metrics",
    """SELECT l_returnflag, round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
        round(avg(abs(l_extendedprice - 1500 * l_quantity)), 2) AS mae, round(sqrt(avg(pow(l_extendedprice - 1500 * l_quantity, 2))), 2) AS rmse, count(*) AS n FROM lineitem GROUP BY 1""",
)
def regression_metrics(spark, sf_dir):
    p = load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    m = E.regression_metrics(p, ["l_returnflag"])
    return m.select("l_returnflag", F.round("r2", 6).alias("r2"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), "n")


@query(
    "cv_summary",
    "SELECT event_type AS model, round(avg(s), 6) AS cv_mean, round(stddev_pop(s), 6) AS cv_std FROM (SELECT event_type, user_id % 5 AS fold, avg(value) AS s FROM events GROUP BY ALL) GROUP BY 1",
)
def cv_summary(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    folds = ev.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("score"))
    return E.cv_summary(folds).select("model", F.round("cv_mean", 6).alias("cv_mean"), F.round("cv_std", 6).alias("cv_std"))


@query(
    "leaderboard_top",
    "SELECT model, round(score, 6) AS score FROM (SELECT event_type AS model, avg(value) AS score FROM events GROUP BY 1) ORDER BY score DESC, model LIMIT 3",
)
def leaderboard_top(spark, sf_dir):
    s = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("score"))
    return E.leaderboard(s, order="model", n=3).select("model", F.round("score", 6).alias("score"))


@query(
    "vote_hard",
    "SELECT l_orderkey AS id, max_by(p, n * 1000000 - p) AS prediction FROM (SELECT l_orderkey, l_linenumber * l_partkey % 3 AS p, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1",
)
def vote_hard(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * F.col("l_partkey") % 3).alias("prediction"))
    return E.vote_hard(li)


@query(
    "vote_soft",
    """WITH p AS (SELECT l_orderkey AS id, avg(l_discount * 5) AS p1, avg(1 - l_discount * 5) AS p0 FROM lineitem GROUP BY 1)
       SELECT id, CASE WHEN p1 > p0 + 1e-9 THEN 1.0 WHEN abs(p1 - p0) <= 1e-9 THEN 0.0 ELSE 0.0 END::DOUBLE AS prediction, round(greatest(p0, p1), 6) AS confidence FROM p""",
)
def vote_soft(spark, sf_dir):
    d = F.col("l_discount") * 5
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.array(1 - d, d).alias("probability"))
    v = E.vote_soft(li)
    tie = F.abs(F.col("confidence") - 0.5) <= 1e-9
    return v.select("id", F.when(tie, 0.0).otherwise(F.col("prediction")).alias("prediction"), F.round("confidence", 6).alias("confidence"))


@query(
    "silhouette_squared",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
      d AS (SELECT a.vec_id AS id, a.label AS la, b.label AS lb, sum(pow(list_distance(a.e, b.e), 2)) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL),
      ab AS (SELECT id, min(s / n) FILTER (la = lb) AS a, min(s / n) FILTER (la <> lb) AS b FROM d GROUP BY id)
      SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM ab""",
)
def silhouette_squared(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    s = E.silhouette_squared(v, "label", "embedding")
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n")


@query(
    "silhouette_exact",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
      d AS (SELECT a.vec_id AS id, a.label AS la, b.label AS lb, sum(list_distance(a.e, b.e)) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL),
      ab AS (SELECT id, min(s / n) FILTER (la = lb) AS a, min(s / n) FILTER (la <> lb) AS b FROM d GROUP BY id)
      SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM ab""",
)
def silhouette_exact(spark, sf_dir):
    s = E.silhouette(load(spark, sf_dir, "embeddings"), "label", "embedding")
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n")
