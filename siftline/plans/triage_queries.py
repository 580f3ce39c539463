"""Registered queries over triage: what Spark runs and what SQL must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import messages as M
from siftline.functions import patterns as P
from siftline.functions import text as X
from siftline.functions import vocab as V
from siftline.operators import triage as T
from siftline.plans import corpus
from siftline.plans import sqltext as S
from siftline.plans.registry import registry
from siftline.plans.sqltext import any_kw, any_word, q
from siftline.session import load

QUERIES, ORACLES, query = registry()


# -- SQL of the gates -------------------------------------------------------

_wants = f"({any_kw('a', V.ML_ACTION)} AND {any_kw('a', V.ML_KEYWORD)})"
GATE1_SQL = f"""g1 AS (
  SELECT *, CASE
    WHEN {any_kw('a', V.RESEARCH_PAPER)} THEN 'ml_research_paper'
    WHEN {any_kw('a', V.SYSTEM_DESIGN)} THEN 'system_design'
    WHEN {any_kw('a', V.RESEARCH_DISCUSSION)}
      THEN CASE WHEN {_wants} THEN 'escaped' ELSE 'research_discussion' END
    WHEN {any_kw('a', V.NEWS)} THEN 'news_announcement'
    WHEN {any_word('a', V.PERSONAL)} THEN 'personal_experience'
    WHEN {any_kw('a', V.PRODUCT)} THEN 'product_discussion'
    WHEN {any_kw('a', V.EXPLORATORY)} THEN 'exploratory_analysis'
    WHEN {_wants} THEN 'predictive_ml_task'
    ELSE 'unknown' END AS code1
  FROM posts),
gate1 AS (
  SELECT *, CASE code1 WHEN 'escaped' THEN 'predictive_ml_task' ELSE code1 END AS category1,
    CASE code1 WHEN 'escaped' THEN 0.6 {' '.join(f"WHEN {q(c)} THEN {r[0]}" for c, r in M.INTENT.items())} END AS confidence1,
    CASE code1 WHEN 'escaped' THEN {q(M.INTENT_ESCAPED[1])} {' '.join(f"WHEN {q(c)} THEN {q(r[1])}" for c, r in M.INTENT.items())} END AS reasoning1,
    CASE code1 WHEN 'escaped' THEN 'No action needed' {' '.join(f"WHEN {q(c)} THEN {q(r[2])}" for c, r in M.INTENT.items())} END AS action1
  FROM g1)"""

GATE2_SQL = f"""g2 AS (
  SELECT *, {S.found('raw', P.TARGET)} AS targets, {S.found('raw', P.FEATURE)} AS feats,
    {S.any_re('raw', P.DATA_SOURCE)} AS has_source,
    nullif({S.context('raw', P.INTENDED_USE)}, '') AS use_text,
    CASE WHEN {any_kw('lower(raw)', V.TASK_CLASSIFICATION)} THEN 'classification'
         WHEN {any_kw('lower(raw)', V.TASK_REGRESSION)} THEN 'regression'
         WHEN {any_kw('lower(raw)', V.TASK_CLUSTERING)} THEN 'clustering' ELSE 'unknown' END AS task0
  FROM gate1),
g2b AS (
  SELECT *, list_filter([
      CASE WHEN len(targets) = 0 AND NOT {any_kw('a', V.TARGET_WORDS)} THEN {q(M.MISSING_TARGET)} END,
      CASE WHEN len(feats) = 0 AND NOT has_source THEN {q(M.MISSING_FEATURES)} END,
      CASE WHEN use_text IS NULL AND NOT direct THEN {q(M.MISSING_USE)} END], lambda m: m IS NOT NULL) AS missing,
    list_filter([
      CASE WHEN len(targets) > 1 AND NOT direct THEN {q(M.AMBIGUOUS_TARGET)} END,
      CASE WHEN len(feats) > 3 AND NOT direct THEN {q(M.AMBIGUOUS_FEATURES)} END], lambda m: m IS NOT NULL) AS ambiguous
  FROM g2),
g2c AS (
  SELECT *, (direct OR (len(missing) = 0 AND len(ambiguous) = 0)) AS feasible2,
    CASE WHEN direct AND len(missing) > 0 THEN
      CASE WHEN contains(a, 'predict') THEN nullif(regexp_extract(raw, {q('(?i)' + P.TARGET_AFTER_PREDICT)}, 1), '')
           WHEN contains(a, 'churn') THEN 'churn'
           WHEN contains(a, 'price') OR contains(a, 'cost') THEN 'price' END END AS guess_t,
    CASE WHEN direct AND len(missing) > 0 AND regexp_matches(raw, {q('(?i)' + P.BASED_ON)})
      THEN {S.trim(f"split_part(regexp_extract(raw, {q('(?i)' + P.BASED_ON)}, 1), ',', 1)")} END AS guess_f
  FROM g2b),
gate2 AS (
  SELECT *,
    CASE WHEN feasible2 THEN coalesce(guess_t, targets[1], {q(M.DEFAULT_TARGET)}) END AS target2,
    CASE WHEN feasible2 THEN coalesce(guess_f, feats[1], {q(M.DEFAULT_FEATURES)}) END AS features2,
    CASE WHEN feasible2 THEN CASE task0 WHEN 'unknown' THEN 'classification' ELSE task0 END END AS task2,
    CASE WHEN feasible2 THEN CASE WHEN has_source THEN 'mentioned' ELSE {q(M.DEFAULT_SOURCE)} END END AS source2,
    CASE WHEN feasible2 THEN coalesce(use_text, {q(M.DEFAULT_USE)}) END AS use2,
    CASE WHEN feasible2 THEN {q(M.FEASIBLE_TEXT)}
         WHEN len(missing) > 0 THEN {q(M.MISSING_PREFIX)} || array_to_string(missing, ', ') || {q(M.MISSING_SUFFIX)}
         ELSE {q(M.AMBIGUOUS_PREFIX)} || array_to_string(ambiguous, ', ') || {q(M.AMBIGUOUS_SUFFIX)} END AS reasoning2
  FROM g2c)"""

STEP3_SQL = f"""step3 AS (
  SELECT *, list_filter([
      CASE WHEN {any_kw('a', V.TRAINING_PARADIGM)} THEN {q(M.CONCEPTS[0])} END,
      CASE WHEN {any_kw('a', V.MODEL_INTERNALS)} THEN {q(M.CONCEPTS[1])} END,
      CASE WHEN {any_kw('a', V.ARCHITECTURAL)} THEN {q(M.CONCEPTS[2])} END], lambda m: m IS NOT NULL) AS concepts
  FROM @src)"""

GATE3_SQL = f"""g3 AS (
  SELECT *, CASE
    WHEN {any_kw('a', V.DECISION_MAKING)} AND {any_kw('a', V.HIGH_STAKES)} AND NOT {any_kw('a', V.CAUSAL)} THEN 'high_stakes'
    WHEN {any_kw('a', V.CORRELATION_WARNING)} THEN 'warned'
    WHEN NOT {any_kw('a', V.DECISION_MAKING)} THEN 'low' ELSE 'medium' END AS code3
  FROM @src),
gate3 AS (
  SELECT *, code3 IN ('low', 'medium') AS valid3,
    CASE code3 {' '.join(f"WHEN {q(c)} THEN {q(r[0])}" for c, r in M.CAUSAL.items())} END AS reasoning3,
    CASE code3 {' '.join(f"WHEN {q(c)} THEN {q(r[1])}" for c, r in M.CAUSAL.items() if r[1])} END AS action3
  FROM g3)"""

GATE4_SQL = f"""g4 AS (
  SELECT *, CASE
    WHEN coalesce(task2, 'unknown') = 'regression' AND NOT {any_kw('b', ('regression', 'predict', 'forecast'))} THEN 'implicit_regression'
    WHEN {any_kw('b', V.SIMPLE_RULE)} AND NOT {any_kw('b', V.COMPLEXITY)} THEN 'simple_rule'
    WHEN NOT {any_kw('b', V.DATASET_MENTION)} AND coalesce(source2, '') = {q(M.DEFAULT_SOURCE)} THEN 'no_dataset'
    WHEN coalesce(task2, 'unknown') = 'unknown' OR (task2 = 'classification' AND NOT {any_kw('b', ('classif', 'categor'))}) THEN 'unclear_task'
    ELSE 'ok' END AS code4
  FROM @src),
gate4 AS (
  SELECT *, code4 = 'ok' AS justified4,
    CASE code4 WHEN 'unclear_task' THEN replace({q(M.JUSTIFY['unclear_task'][0])}, '%s', coalesce(task2, 'unknown'))
      {' '.join(f"WHEN {q(c)} THEN {q(r[0])}" for c, r in M.JUSTIFY.items() if c != 'unclear_task')} END AS reasoning4,
    CASE code4 {' '.join(f"WHEN {q(c)} THEN {q(r[1])}" for c, r in M.JUSTIFY.items() if r[1])} END AS action4
  FROM g4)"""

DECISION_SQL = f"""decided AS (
  SELECT *,
    CASE WHEN NOT ok1 THEN category1 WHEN NOT feasible2 THEN 'insufficient_information'
         WHEN len(concepts) > 0 THEN 'research_concept' ELSE 'predictive_ml_task' END AS content_type,
    CASE WHEN NOT ok1 THEN category1 WHEN NOT feasible2 THEN 'insufficient_information'
         WHEN len(concepts) > 0 THEN 'research_concept' WHEN NOT valid3 THEN 'causal_concern'
         WHEN NOT justified4 THEN 'unjustified_ml' ELSE 'predictive_ml_task' END AS category,
    CASE WHEN ok1 AND feasible2 AND len(concepts) = 0 AND valid3 AND justified4
         THEN 'train' ELSE 'do_not_train' END AS decision,
    CASE WHEN NOT ok1 THEN reasoning1 WHEN NOT feasible2 THEN reasoning2
         WHEN len(concepts) > 0 THEN {q(M.RESEARCH_PREFIX)} || array_to_string(concepts, ', ') || {q(M.RESEARCH_SUFFIX)}
         WHEN NOT valid3 THEN reasoning3 WHEN NOT justified4 THEN reasoning4
         ELSE {q(M.TRAIN_REASONING)} END AS reasoning,
    CASE WHEN NOT ok1 THEN action1 WHEN NOT feasible2 THEN {q(M.INSUFFICIENT_ACTION)}
         WHEN len(concepts) > 0 THEN {q(M.RESEARCH_ACTION)} WHEN NOT valid3 THEN action3
         WHEN NOT justified4 THEN action4 ELSE {q(M.TRAIN_ACTION)} END AS recommended_action
  FROM (SELECT *, (direct OR category1 = 'predictive_ml_task') AS ok1 FROM gate4))"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


ALL_SQL = chain(
    corpus.POSTS_SQL, GATE1_SQL, GATE2_SQL, STEP3_SQL.replace("@src", "gate2"), GATE3_SQL.replace("@src", "step3"),
    GATE4_SQL.replace("@src", "gate3"), DECISION_SQL,
)
_DIRECT_POSTS = corpus.POSTS_SQL.replace("source, lang", "'direct_input' AS source, lang")
DIRECT_SQL = ALL_SQL.replace(corpus.POSTS_SQL, _DIRECT_POSTS)


# -- single checks ----------------------------------------------------------


@query(
    "keyword_any",
    chain(corpus.POSTS_SQL)
    + f" SELECT seq, {any_kw('a', V.ML_KEYWORD)} AS hit, {any_kw('a', V.ML_ACTION)} AS action FROM posts",
)
def keyword_any(spark, sf_dir):
    text = X.combined("title", "full_text")
    return corpus.posts(spark, sf_dir).select(
        "seq",
        X.any_keyword(text, V.ML_KEYWORD).alias("hit"),
        X.any_keyword(text, V.ML_ACTION).alias("action"),
    )


@query(
    "keyword_word_boundary",
    chain(corpus.POSTS_SQL)
    + f" SELECT seq, {any_word('a', V.PERSONAL)} AS personal, {any_word('a', ('story', 'el', 'der'))} AS word FROM posts",
)
def keyword_word_boundary(spark, sf_dir):
    text = X.combined("title", "full_text")
    return corpus.posts(spark, sf_dir).select(
        "seq",
        X.any_keyword(text, V.PERSONAL, word_boundary=True).alias("personal"),
        X.any_keyword(text, ("story", "el", "der"), word_boundary=True).alias("word"),
    )


_DISC = f"({any_kw('a', V.DISCUSSION_MARKER)} AND NOT {any_kw('a', V.DISCUSSION_ACTION)})"


@query(
    "discussion_flag",
    chain(corpus.POSTS_SQL)
    + f""" SELECT seq, {_DISC} AS discussion,
      ({any_kw("lower(right(title, 10))", V.QUESTION_WORD)} OR contains(title, '?')) AS question FROM posts""",
)
def discussion_flag(spark, sf_dir):
    return corpus.posts(spark, sf_dir).select(
        "seq",
        T.discussion_flag("title", "full_text").alias("discussion"),
        X.is_question("title").alias("question"),
    )


_SEEN = lambda v: any_kw("b || ' ' || lower(title)", v)
_TOK = S.tokens("b")
RULE_SQL = f"""ruled AS (
  SELECT *, CASE WHEN {_DISC} THEN 'discussion' WHEN NOT {_SEEN(V.FEASIBLE_ML)} THEN 'no_ml'
    WHEN {_SEEN(V.FEASIBLE_CLASSIFICATION)} THEN 'classification'
    WHEN {_SEEN(V.FEASIBLE_REGRESSION)} THEN 'regression'
    WHEN {_SEEN(V.FEASIBLE_CLUSTERING)} THEN 'clustering' ELSE 'other' END AS code
  FROM posts),
rule AS (
  SELECT *, code NOT IN ('discussion', 'no_ml') AS feasible,
    CASE WHEN code IN ('discussion', 'no_ml') THEN 'none' ELSE code END AS task_type,
    CAST(CASE code WHEN 'discussion' THEN 0.9 WHEN 'no_ml' THEN 0.3 WHEN 'clustering' THEN 0.65
      WHEN 'other' THEN 0.6 ELSE 0.7 END AS DOUBLE) AS confidence
  FROM ruled)"""


@query(
    "rule_classify",
    chain(corpus.POSTS_SQL, RULE_SQL) + " SELECT seq, feasible, task_type, confidence FROM rule",
)
def rule_classify(spark, sf_dir):
    return T.rule_classify(corpus.posts(spark, sf_dir)).select(
        "seq", "rule.feasible", "rule.task_type", "rule.confidence"
    )


@query(
    "filter_feasible",
    chain(corpus.POSTS_SQL, RULE_SQL)
    + " SELECT seq, task_type FROM rule WHERE feasible AND confidence >= 0.7 AND task_type NOT IN ('none', 'other')",
)
def filter_feasible(spark, sf_dir):
    return T.filter_feasible(T.classify(corpus.posts(spark, sf_dir))).select(
        "seq", "ml_classification.task_type"
    )


@query(
    "gate1_intent",
    chain(corpus.POSTS_SQL, GATE1_SQL)
    + " SELECT seq, category1 AS category, CAST(confidence1 AS DOUBLE) AS confidence, reasoning1 AS reasoning FROM gate1",
)
def gate1_intent(spark, sf_dir):
    return T.gate1(corpus.posts(spark, sf_dir)).select(
        "seq", "intent.category", "intent.confidence", "intent.reasoning"
    )


@query(
    "gate2_extract",
    chain(corpus.POSTS_SQL, GATE1_SQL, GATE2_SQL)
    + """ SELECT seq, feasible2 AS feasible, target2 AS target, features2 AS features, task2 AS task_type,
       source2 AS data_source, use2 AS intended_use, array_to_string(missing, '; ') AS missing,
       array_to_string(ambiguous, '; ') AS ambiguous FROM gate2""",
)
def gate2_extract(spark, sf_dir):
    f = F.col("feasibility")
    return T.gate2(corpus.posts(spark, sf_dir)).select(
        "seq", f["feasible"].alias("feasible"), f["target"].alias("target"),
        f["features"][0].alias("features"), f["task_type"].alias("task_type"),
        f["data_source"].alias("data_source"), f["intended_use"].alias("intended_use"),
        F.array_join(f["missing"], "; ").alias("missing"),
        F.array_join(f["ambiguous"], "; ").alias("ambiguous"),
    )


@query(
    "gate2_direct",
    chain(_DIRECT_POSTS, GATE1_SQL, GATE2_SQL)
    + " SELECT seq, feasible2 AS feasible, target2 AS target, features2 AS features, task2 AS task_type FROM gate2",
)
def gate2_direct(spark, sf_dir):
    f = F.col("feasibility")
    return T.gate2(corpus.posts(spark, sf_dir).withColumn("source", F.lit("direct_input"))).select(
        "seq", f["feasible"].alias("feasible"), f["target"].alias("target"),
        f["features"][0].alias("features"), f["task_type"].alias("task_type"),
    )


@query(
    "step3_research",
    chain(corpus.POSTS_SQL, STEP3_SQL.replace("@src", "posts"))
    + " SELECT seq, len(concepts) > 0 AS is_research, array_to_string(concepts, '; ') AS concepts FROM step3",
)
def step3_research(spark, sf_dir):
    return T.step3(corpus.posts(spark, sf_dir)).select(
        "seq", "research.is_research", F.array_join("research.concepts", "; ").alias("concepts")
    )


@query(
    "gate3_causal",
    chain(corpus.POSTS_SQL, GATE3_SQL.replace("@src", "posts"))
    + " SELECT seq, valid3 AS valid, CASE WHEN valid3 THEN code3 END AS risk_level, reasoning3 AS reasoning FROM gate3",
)
def gate3_causal(spark, sf_dir):
    return T.gate3(corpus.posts(spark, sf_dir)).select(
        "seq", "causal_validity.valid", "causal_validity.risk_level", "causal_validity.reasoning"
    )


@query(
    "gate4_justify",
    chain(corpus.POSTS_SQL, GATE1_SQL, GATE2_SQL, GATE4_SQL.replace("@src", "gate2"))
    + " SELECT seq, justified4 AS justified, reasoning4 AS reasoning, action4 AS recommended_action FROM gate4",
)
def gate4_justify(spark, sf_dir):
    return T.gate4(T.gate2(corpus.posts(spark, sf_dir))).select(
        "seq", "justification.justified", "justification.reasoning", "justification.recommended_action"
    )


@query(
    "gate_fields",
    chain(corpus.POSTS_SQL, GATE1_SQL, GATE2_SQL, STEP3_SQL.replace("@src", "gate2"), GATE3_SQL.replace("@src", "step3"), GATE4_SQL.replace("@src", "gate3"))
    + f""" SELECT seq, CASE WHEN len(concepts) > 0 THEN 'research_concept: ' || array_to_string(concepts, '; ') END AS explain,
        CASE WHEN code3 = 'medium' THEN 'Monitor for distribution shift and validate causal assumptions if deployed.' END AS causal_warning,
        CASE WHEN justified4 THEN 'Proceed with ' || task2 || ' model family. Ensure dataset is real and appropriate before training.' END AS note,
        CASE WHEN justified4 THEN NOT (NOT {any_kw('b', V.DATASET_MENTION)} AND coalesce(source2, '') = 'to be discovered') END AS dataset_validated FROM gate4""",
)
def gate_fields(spark, sf_dir):
    """What the gates say besides their verdicts; every gate is run for every post."""
    d = T.gate4(T.gate3(T.step3(T.gate2(T.gate1(corpus.posts(spark, sf_dir))))))
    about = F.concat_ws(": ", "research.conceptual_content.type", F.array_join("research.conceptual_content.concepts", "; "))
    return d.select(
        "seq", F.when(F.col("research.conceptual_content.should_not_train"), about).alias("explain"),
        F.col("causal_validity.warning").alias("causal_warning"), "justification.note", "justification.dataset_validated")


_DECISION_COLS = ("decision", "content_type", "category", "reasoning", "recommended_action")


@query("triage_decision", ALL_SQL + f" SELECT seq, {', '.join(_DECISION_COLS)} FROM decided")
def triage_decision(spark, sf_dir):
    return T.triage(corpus.posts(spark, sf_dir)).select(
        "seq", *[f"decision.{c}" for c in _DECISION_COLS]
    )


@query("triage_direct", DIRECT_SQL + " SELECT seq, decision, category, reasoning FROM decided")
def triage_direct(spark, sf_dir):
    posts = corpus.posts(spark, sf_dir).withColumn("source", F.lit("direct_input"))
    return T.triage(posts).select("seq", "decision.decision", "decision.category", "decision.reasoning")


@query(
    "triage_counts",
    ALL_SQL + " SELECT decision, category, count(*) AS n FROM decided GROUP BY ALL",
)
def triage_counts(spark, sf_dir):
    d = T.triage(corpus.posts(spark, sf_dir))
    return d.groupBy("decision.decision", "decision.category").agg(F.count("*").alias("n"))


@query(
    "approved_posts",
    ALL_SQL + " SELECT seq, target2 AS target, task2 AS task_type FROM decided WHERE decision = 'train'",
)
def approved_posts(spark, sf_dir):
    return T.approved(T.triage(corpus.posts(spark, sf_dir))).select(
        "seq", "definition.target", "definition.task_type"
    )


@query(
    "first_approved",
    ALL_SQL + " SELECT seq, title FROM decided WHERE decision = 'train' ORDER BY seq LIMIT 1",
)
def first_approved(spark, sf_dir):
    return T.first_approved(T.triage(corpus.posts(spark, sf_dir))).select("seq", "title")


@query(
    "task_resolve",
    ALL_SQL
    + f""", ruled AS (SELECT *, CASE WHEN {_DISC} THEN 'none' WHEN NOT {_SEEN(V.FEASIBLE_ML)} THEN 'none'
      WHEN {_SEEN(V.FEASIBLE_CLASSIFICATION)} THEN 'classification' WHEN {_SEEN(V.FEASIBLE_REGRESSION)} THEN 'regression'
      WHEN {_SEEN(V.FEASIBLE_CLUSTERING)} THEN 'clustering' ELSE 'other' END AS rule_task FROM decided)
    SELECT seq, CASE WHEN decision = 'train' THEN task2 ELSE rule_task END AS task_type FROM ruled""",
)
def task_resolve(spark, sf_dir):
    d = T.triage(corpus.posts(spark, sf_dir))
    return T.resolve_task(T.classify(d)).select("seq", "task_type")


@query(
    "default_problem",
    chain(corpus.POSTS_SQL)
    + """ SELECT seq, CASE WHEN NOT contains(b, 'churn') AND (contains(b, 'price') OR contains(b, 'cost'))
        THEN 'regression' ELSE 'classification' END AS problem_type,
      CASE WHEN contains(b, 'churn') THEN 'churn' WHEN contains(b, 'price') OR contains(b, 'cost') THEN 'price'
        ELSE 'target' END AS target_variable FROM posts""",
)
def default_problem(spark, sf_dir):
    return T.default_problem(corpus.posts(spark, sf_dir)).select(
        "seq", "problem_type", "target_variable"
    )


@query(
    "direct_decision",
    chain(corpus.POSTS_SQL)
    + f""" SELECT seq, 'train' AS decision, {q(M.DIRECT_REASONING)} AS reasoning,
      CASE WHEN contains(b, 'churn') THEN 'churn' WHEN contains(b, 'price') OR contains(b, 'cost') THEN 'price'
        ELSE 'target' END AS target, {q(M.DEFAULT_SOURCE)} AS data_source FROM posts""",
)
def direct_decision(spark, sf_dir):
    p = T.default_problem(corpus.posts(spark, sf_dir))
    p = p.withColumns({c: F.lit(None).cast("string") for c in ("data_source", "intended_use")})
    return T.direct_decision(p).select(
        "seq", "decision.decision", "decision.reasoning", "definition.target", "definition.data_source"
    )


# -- text functions ---------------------------------------------------------


@query(
    "target_extract",
    chain(corpus.POSTS_SQL)
    + f" SELECT seq, array_to_string({S.found('raw', P.TARGET)}, ', ') AS targets FROM posts",
)
def target_extract(spark, sf_dir):
    raw = F.concat("title", F.lit(" "), "full_text")
    return corpus.posts(spark, sf_dir).select(
        "seq", F.array_join(X.find_all(raw, P.TARGET), ", ").alias("targets")
    )


@query(
    "feature_extract",
    chain(corpus.POSTS_SQL)
    + f" SELECT seq, array_to_string({S.found('raw', P.FEATURE)}, ' # ') AS features FROM posts",
)
def feature_extract(spark, sf_dir):
    raw = F.concat("title", F.lit(" "), "full_text")
    return corpus.posts(spark, sf_dir).select(
        "seq", F.array_join(X.find_all(raw, P.FEATURE), " # ").alias("features")
    )


@query(
    "use_context",
    chain(corpus.POSTS_SQL)
    + f" SELECT seq, {S.context('raw', P.INTENDED_USE)} AS intended_use, {S.any_re('raw', P.DATA_SOURCE)} AS has_source FROM posts",
)
def use_context(spark, sf_dir):
    raw = F.concat("title", F.lit(" "), "full_text")
    return corpus.posts(spark, sf_dir).select(
        "seq",
        X.context_of(raw, P.INTENDED_USE).alias("intended_use"),
        X.any_pattern(raw, P.DATA_SOURCE).alias("has_source"),
    )


@query(
    "split_features",
    chain(corpus.POSTS_SQL)
    + f""" SELECT seq, array_to_string(list_transform(string_split(regexp_extract(raw, {q('(?i)' + P.BASED_ON)}, 1), ','),
         lambda x: {S.trim('x')}), ' # ') AS items FROM posts WHERE regexp_matches(raw, {q('(?i)' + P.BASED_ON)})""",
)
def split_features(spark, sf_dir):
    raw = F.concat("title", F.lit(" "), "full_text")
    return (
        corpus.posts(spark, sf_dir)
        .select("seq", X.first_match(raw, P.BASED_ON).alias("m"))
        .where("m is not null")
        .select("seq", F.array_join(X.split_list("m"), " # ").alias("items"))
    )


_WORDS = f"regexp_extract_all(lower(%s), {q('(' + P.LONG_WORD + ')')}, 1)"


@query(
    "keyword_extract",
    f"""WITH w AS (SELECT doc_id, list_concat([lang], {_WORDS % 'source'}, {_WORDS % "substring(text, 1, 300)"}) AS l
          FROM documents),
      u AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w),
      d AS (SELECT doc_id, l[i] AS k, min(i) AS i FROM u GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM d)
      SELECT doc_id, string_agg(k, ',' ORDER BY rn) AS keywords FROM r WHERE rn <= 15 GROUP BY doc_id""",
)
def keyword_extract(spark, sf_dir):
    kw = X.discovery_keywords(F.array("lang"), F.lit(None).cast("string"), "source", "text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(kw, ",").alias("keywords")
    )


@query(
    "next_word_features",
    f"""WITH t AS (SELECT doc_id, {S.tokens('lower(text)')} AS w FROM documents),
      f AS (SELECT doc_id, list_filter(list_transform(range(1, len(w)),
              lambda i: CASE WHEN w[i] IN ('el', 'und', 'the', 'les') THEN substring(w[i + 1], 1, 20) END), lambda x: x IS NOT NULL) AS k FROM t)
      SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k[1:5], ',') ELSE 'features,data' END AS key_features FROM f""",
)
def next_word_features(spark, sf_dir):
    # The documents hold none of the default marker words; common words stand in for them.
    words = X.next_words("text", markers=("el", "und", "the", "les"))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(words, ",").alias("key_features"))


@query(
    "slugify",
    f"""SELECT doc_id, substring(regexp_replace(lower(regexp_replace(regexp_replace(text,
          {q('[^' + P.WORD[1:-1] + P.SPACE_SET + '-]')}, '', 'g'), {q('[-' + P.SPACE_SET + ']+')}, '_', 'g')), '^_+|_+$', '', 'g'), 1, 50) AS slug,
        coalesce(nullif(regexp_replace(substring(lower(regexp_replace(text, {q('[^' + P.WORD[1:-1] + '-]')}, '', 'g')), 1, 100), '^-+|-+$', '', 'g'), ''), 'ml-solution') AS repo
        FROM documents""",
)
def slugify(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", X.slug("text").alias("slug"), X.repo_slug("text").alias("repo")
    )


@query(
    "problem_text",
    chain(corpus.POSTS_SQL, RULE_SQL)
    + f""" SELECT seq, title || CASE WHEN {any_kw('lower(title)', V.EXPLAIN_TITLE)} THEN ' ' || task_type || ' dataset machine learning data' ELSE '' END
        || ' ' || substring(full_text, 1, 500) || ' Task type: ' || task_type AS match_text FROM rule""",
)
def problem_text(spark, sf_dir):
    p = T.rule_classify(corpus.posts(spark, sf_dir))
    none = F.lit(None).cast("array<string>")
    return p.select(
        "seq", X.problem_text("title", "full_text", "rule.task_type", none).alias("match_text")
    )


@query(
    "dataset_text",
    """SELECT p_partkey, concat_ws(' ', p_name, nullif(p_type, ''), p_brand || ' ' || p_type) AS match_text,
         'part' || '/' || p_partkey AS ref, p_name || ' ' || p_type AS signature FROM part""",
)
def dataset_text(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        X.dataset_text("p_name", "p_type", F.array("p_brand", "p_type")).alias("match_text"),
        F.concat_ws("/", F.lit("part"), F.col("p_partkey").cast("string")).alias("ref"),
        X.problem_signature("p_name", "p_type").alias("signature"),
    )
