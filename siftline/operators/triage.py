"""Triage of posts: six checks decide whether a post is a model-training task.

Each check is a struct column computed from the post's own text, so triage is a
chain of projections over the scan: no shuffle, no Python worker. A check is
only evaluated for the posts that passed the ones before it.

Posts carry ``title``, ``full_text``, ``source`` and, optionally, ``canonical``
(struct with problem_type, target_variable, input_features, intended_use,
data_source, evaluation_metric).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import messages as M
from siftline.functions import patterns as P
from siftline.functions import text as X
from siftline.functions import vocab as V

CANONICAL_TYPE = T.StructType(
    [
        T.StructField("problem_type", T.StringType()),
        T.StructField("target_variable", T.StringType()),
        T.StructField("input_features", T.ArrayType(T.StringType())),
        T.StructField("intended_use", T.StringType()),
        T.StructField("data_source", T.StringType()),
        T.StructField("evaluation_metric", T.StringType()),
    ]
)
STRINGS = T.ArrayType(T.StringType())


@dataclass(frozen=True)
class Vocabulary:
    """Word lists of the gates; pass a changed copy to tune triage."""

    research_paper: Sequence[str] = V.RESEARCH_PAPER
    system_design: Sequence[str] = V.SYSTEM_DESIGN
    research_discussion: Sequence[str] = V.RESEARCH_DISCUSSION
    news: Sequence[str] = V.NEWS
    personal: Sequence[str] = V.PERSONAL
    product: Sequence[str] = V.PRODUCT
    exploratory: Sequence[str] = V.EXPLORATORY
    ml_action: Sequence[str] = V.ML_ACTION
    ml_keyword: Sequence[str] = V.ML_KEYWORD
    target_words: Sequence[str] = V.TARGET_WORDS
    concepts: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: dict(
            zip(M.CONCEPTS, (V.TRAINING_PARADIGM, V.MODEL_INTERNALS, V.ARCHITECTURAL))
        )
    )
    decision_making: Sequence[str] = V.DECISION_MAKING
    causal: Sequence[str] = V.CAUSAL
    high_stakes: Sequence[str] = V.HIGH_STAKES
    correlation_warning: Sequence[str] = V.CORRELATION_WARNING
    simple_rule: Sequence[str] = V.SIMPLE_RULE
    complexity: Sequence[str] = V.COMPLEXITY
    dataset_mention: Sequence[str] = V.DATASET_MENTION


DEFAULT = Vocabulary()


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(STRINGS)


def _text_columns(df: DataFrame) -> DataFrame:
    """Add the lower-cased texts every gate reads, and a typed ``canonical``."""
    if "canonical" not in df.columns:
        df = df.withColumn("canonical", F.lit(None).cast(CANONICAL_TYPE))
    return df.withColumns(
        {
            "_raw": F.concat(X.blank("title"), F.lit(" "), X.blank("full_text")),
            "_all": X.combined("title", "full_text"),
            "_body": F.lower(X.blank("full_text")),
            "_direct": F.coalesce(F.col("source") == "direct_input", F.lit(False)),
        }
    )


# -- gate 1 -----------------------------------------------------------------


def gate1(df: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Add ``intent``: struct(category, confidence, reasoning, recommended_action, skipped)."""
    df = _text_columns(df) if "_all" not in df.columns else df
    text = F.col("_all")
    wants_model = X.any_keyword(text, vocab.ml_action) & X.any_keyword(text, vocab.ml_keyword)

    category = (
        F.when(X.any_keyword(text, vocab.research_paper), "ml_research_paper")
        .when(X.any_keyword(text, vocab.system_design), "system_design")
        .when(
            X.any_keyword(text, vocab.research_discussion),
            F.when(wants_model, "escaped").otherwise("research_discussion"),
        )
        .when(X.any_keyword(text, vocab.news), "news_announcement")
        .when(X.any_keyword(text, vocab.personal, word_boundary=True), "personal_experience")
        .when(X.any_keyword(text, vocab.product), "product_discussion")
        .when(X.any_keyword(text, vocab.exploratory), "exploratory_analysis")
        .when(wants_model, "predictive_ml_task")
        .otherwise("unknown")
    )
    return df.withColumn("_intent", X.once(category)).withColumn("intent", _intent_struct()).drop("_intent")


def _intent_struct() -> Column:
    code = F.col("_intent")
    escaped = code == "escaped"
    default_action = M.INTENT["predictive_ml_task"][2]

    def lookup(i: int, for_escaped) -> Column:
        table = F.create_map(
            *[F.lit(x) for cat, row in M.INTENT.items() for x in (cat, row[i])]
        )
        return F.when(escaped, F.lit(for_escaped)).otherwise(table[code])

    return F.struct(
        F.when(escaped, "predictive_ml_task").otherwise(code).alias("category"),
        lookup(0, M.INTENT_ESCAPED[0]).alias("confidence"),
        lookup(1, M.INTENT_ESCAPED[1]).alias("reasoning"),
        lookup(2, default_action).alias("recommended_action"),
        F.lit(False).alias("skipped"),
    )


def skipped_intent() -> Column:
    return F.struct(
        F.lit("predictive_ml_task").alias("category"),
        F.lit(M.INTENT_SKIPPED[0]).alias("confidence"),
        F.lit(M.INTENT_SKIPPED[1]).alias("reasoning"),
        F.lit(M.INTENT["predictive_ml_task"][2]).alias("recommended_action"),
        F.lit(True).alias("skipped"),
    )


# -- gate 2 -----------------------------------------------------------------


def gate2(
    df: DataFrame,
    vocab: Vocabulary = DEFAULT,
    strict: bool = True,
    where: Column | None = None,
) -> DataFrame:
    """Add ``feasibility``; ``where`` limits the pattern search to some posts."""
    df = _text_columns(df) if "_all" not in df.columns else df
    run = F.lit(True) if where is None else where
    canon, direct, raw, text = (F.col(c) for c in ("canonical", "_direct", "_raw", "_all"))

    has_canonical = X.filled(canon["target_variable"]).isNotNull() & (
        F.size(canon["input_features"]) > 0
    )
    from_text = run & ~F.coalesce(has_canonical, F.lit(False))
    none = F.array().cast(STRINGS)

    def searched(expr: Column) -> Column:
        return X.once(F.when(from_text, expr))

    df = df.withColumns(
        {
            "_found_targets": searched(X.find_all(raw, P.TARGET, lower=text)),
            "_found_features": searched(X.find_all(raw, P.FEATURE, lower=text)),
            "_has_source": searched(X.any_pattern(raw, P.DATA_SOURCE, text)),
            "_use": searched(X.context_of(raw, P.INTENDED_USE, lower=text)),
            "_task": searched(X.task_by_keyword(raw)),
            "_names_target": searched(X.any_keyword(text, vocab.target_words)),
        }
    )
    targets, feats = F.col("_found_targets"), F.col("_found_features")
    use = X.filled("_use")

    no_target = (F.size(targets) == 0) & ~F.col("_names_target")
    no_feature = (F.size(feats) == 0) & ~F.col("_has_source")
    missing = _strings(
        F.when(no_target, M.MISSING_TARGET),
        F.when(no_feature, M.MISSING_FEATURES),
        F.when(use.isNull() & ~direct, M.MISSING_USE),
    )
    ambiguous = _strings(
        F.when((F.size(targets) > 1) & ~direct, M.AMBIGUOUS_TARGET),
        F.when((F.size(feats) > 3) & ~direct, M.AMBIGUOUS_FEATURES),
    )
    df = df.withColumns({"_missing": searched(missing), "_ambiguous": searched(ambiguous)})
    missing, ambiguous = F.col("_missing"), F.col("_ambiguous")

    # A direct statement with gaps: read the target and the features off the text.
    infer = direct & (F.size(missing) > 0)
    guessed_target = F.when(
        text.contains("predict"), X.first_match(raw, P.TARGET_AFTER_PREDICT)
    ).otherwise(
        F.when(text.contains("churn"), "churn").when(
            text.contains("price") | text.contains("cost"), "price"
        )
    )
    df = df.withColumn("_guess_target", F.when(infer, guessed_target)).withColumn(
        "_guess_features",
        F.when(infer & text.contains("based on"), X.split_list(X.first_match(raw, P.BASED_ON))),
    )
    target = F.coalesce(F.col("_guess_target"), F.try_element_at(targets, F.lit(1)))
    feature = F.coalesce(
        F.try_element_at(F.col("_guess_features"), F.lit(1)),
        F.try_element_at(feats, F.lit(1)),
        F.lit(M.DEFAULT_FEATURES),
    )
    rejected_missing = (F.size(missing) > 0) & ~direct
    rejected_ambiguous = (F.size(ambiguous) > 0) & ~direct & F.lit(strict)
    feasible = ~rejected_missing & ~rejected_ambiguous

    reasoning = (
        F.when(
            rejected_missing,
            F.concat(F.lit(M.MISSING_PREFIX), F.array_join(missing, ", "), F.lit(M.MISSING_SUFFIX)),
        )
        .when(
            rejected_ambiguous,
            F.concat(
                F.lit(M.AMBIGUOUS_PREFIX), F.array_join(ambiguous, ", "), F.lit(M.AMBIGUOUS_SUFFIX)
            ),
        )
        .otherwise(M.FEASIBLE_TEXT)
    )
    kind = canon["problem_type"]
    known = F.coalesce(F.when(kind != "unknown", kind), F.lit("classification"))
    canonical_result = F.struct(
        F.lit(True).alias("feasible"),
        canon["target_variable"].alias("target"),
        canon["input_features"].cast(STRINGS).alias("features"),
        known.alias("task_type"),
        F.coalesce(X.filled(canon["data_source"]), F.lit(M.DEFAULT_SOURCE)).alias("data_source"),
        F.coalesce(X.filled(canon["intended_use"]), F.lit(M.DEFAULT_CANONICAL_USE)).alias("intended_use"),
        none.alias("missing"),
        none.alias("ambiguous"),
        F.lit(M.FEASIBLE_CANONICAL).alias("reasoning"),
        F.lit(True).alias("from_canonical"),
    )
    text_result = F.struct(
        feasible.alias("feasible"),
        F.when(feasible, F.coalesce(target, F.lit(M.DEFAULT_TARGET))).alias("target"),
        F.when(feasible, F.array(feature)).alias("features"),
        F.when(
            feasible,
            F.when(F.col("_task") == "unknown", "classification").otherwise(F.col("_task")),
        ).alias("task_type"),
        F.when(
            feasible, F.when(F.col("_has_source"), "mentioned").otherwise(M.DEFAULT_SOURCE)
        ).alias("data_source"),
        F.when(feasible, F.coalesce(use, F.lit(M.DEFAULT_USE))).alias("intended_use"),
        missing.alias("missing"),
        ambiguous.alias("ambiguous"),
        reasoning.alias("reasoning"),
        F.lit(False).alias("from_canonical"),
    )
    out = F.when(from_text, text_result).when(run, canonical_result)
    helpers = [
        "_found_targets", "_found_features", "_has_source", "_use", "_task", "_names_target",
        "_missing", "_ambiguous", "_guess_target", "_guess_features",
    ]
    return df.withColumn("feasibility", out).drop(*helpers)


# -- step 3 and gate 3 ------------------------------------------------------


def step3(df: DataFrame, vocab: Vocabulary = DEFAULT, where: Column | None = None) -> DataFrame:
    """Add ``research``: struct(is_research, concepts, reasoning, recommended_action, conceptual_content).

    ``conceptual_content`` tells what to explain instead of training: concepts, type and two flags.
    """
    df = _text_columns(df) if "_all" not in df.columns else df
    run = F.lit(True) if where is None else where
    found = _strings(
        *[F.when(X.any_keyword("_all", ws), name) for name, ws in vocab.concepts.items()]
    )
    df = df.withColumn("_concepts", X.once(F.when(run, found)))
    concepts = F.col("_concepts")
    yes = F.size(concepts) > 0
    research = F.struct(
        yes.alias("is_research"),
        concepts.alias("concepts"),
        F.when(
            yes,
            F.concat(F.lit(M.RESEARCH_PREFIX), F.array_join(concepts, ", "), F.lit(M.RESEARCH_SUFFIX)),
        ).otherwise(M.NOT_RESEARCH).alias("reasoning"),
        F.when(yes, M.RESEARCH_ACTION).alias("recommended_action"),
        F.when(yes, F.struct(
            concepts.alias("concepts"), F.lit(M.CONCEPT_TYPE).alias("type"), F.lit(True).alias("should_explain"), F.lit(True).alias("should_not_train"),
        )).alias("conceptual_content"),
    )
    return df.withColumn("research", F.when(run, research)).drop("_concepts")


def gate3(df: DataFrame, vocab: Vocabulary = DEFAULT, where: Column | None = None) -> DataFrame:
    """Add ``causal_validity``: struct(valid, risk_level, reasoning, recommended_action, warning)."""
    df = _text_columns(df) if "_all" not in df.columns else df
    run = F.lit(True) if where is None else where
    text = F.col("_all")
    decides = X.any_keyword(text, vocab.decision_making)
    code = (
        F.when(
            decides & X.any_keyword(text, vocab.high_stakes) & ~X.any_keyword(text, vocab.causal),
            "high_stakes",
        )
        .when(X.any_keyword(text, vocab.correlation_warning), "warned")
        .when(~decides, "low")
        .otherwise("medium")
    )
    df = df.withColumn("_risk", X.once(F.when(run, code)))
    code = F.col("_risk")
    result = F.struct(
        code.isin("low", "medium").alias("valid"),
        F.when(code.isin("low", "medium"), code).alias("risk_level"),
        _by_code(code, M.CAUSAL, 0).alias("reasoning"),
        _by_code(code, M.CAUSAL, 1).alias("recommended_action"),
        _by_code(code, {c: (w,) for c, w in M.CAUSAL_WARNING.items()}, 0).alias("warning"),
    )
    return df.withColumn("causal_validity", F.when(run, result)).drop("_risk")


def _by_code(code: Column, table: Mapping[str, tuple], i: int) -> Column:
    out = F.lit(None).cast("string")
    for key, row in table.items():
        out = F.when(code == key, F.lit(row[i]).cast("string")).otherwise(out)
    return out


# -- gate 4 -----------------------------------------------------------------


def gate4(
    df: DataFrame,
    vocab: Vocabulary = DEFAULT,
    strict: bool = True,
    where: Column | None = None,
) -> DataFrame:
    """Add ``justification``: struct(justified, model_family, reasoning, recommended_action, note, warning,
    dataset_validated, direct_problem_mode)."""
    df = _text_columns(df) if "_all" not in df.columns else df
    run = F.lit(True) if where is None else where
    body, task = F.col("_body"), F.coalesce(F.col("feasibility.task_type"), F.lit("unknown"))
    source = F.coalesce(F.col("feasibility.data_source"), F.lit(""))
    mentioned = X.any_keyword(body, vocab.dataset_mention)
    code = (
        F.when(
            (task == "regression") & ~X.any_keyword(body, ("regression", "predict", "forecast")),
            "implicit_regression",
        )
        .when(
            X.any_keyword(body, vocab.simple_rule) & ~X.any_keyword(body, vocab.complexity),
            "simple_rule",
        )
        .when(F.col("_direct") & F.col("canonical").isNotNull(), "direct")
        .when(
            ~mentioned & (source == M.DEFAULT_SOURCE),
            "no_dataset" if strict else "dataset_later",
        )
        .when(
            (task == "unknown")
            | ((task == "classification") & ~X.any_keyword(body, ("classif", "categor"))),
            "unclear_task",
        )
        .otherwise("ok")
    )
    df = df.withColumn("_why", X.once(F.when(run, code)))
    code = F.col("_why")
    reasoning = F.when(
        code == "unclear_task", F.format_string(M.JUSTIFY["unclear_task"][0], task)
    ).otherwise(_by_code(code, M.JUSTIFY, 0))
    result = F.struct(
        code.isin("direct", "dataset_later", "ok").alias("justified"),
        F.when(code == "ok", task).alias("model_family"),
        reasoning.alias("reasoning"),
        _by_code(code, M.JUSTIFY, 1).alias("recommended_action"),
        F.when(code == "ok", F.format_string(M.JUSTIFY_NOTE["ok"], task)).otherwise(
            _by_code(code, {c: (n,) for c, n in M.JUSTIFY_NOTE.items()}, 0)).alias("note"),
        _by_code(code, {c: (w,) for c, w in M.JUSTIFY_WARNING.items()}, 0).alias("warning"),
        # Whoever gets as far as "ok" has named a dataset or a source.
        F.when(code == "ok", True).alias("dataset_validated"),
        F.when(code == "direct", True).alias("direct_problem_mode"),
    )
    return df.withColumn("justification", F.when(run, result)).drop("_why")


# -- the decision -----------------------------------------------------------


def triage(
    df: DataFrame, vocab: Vocabulary = DEFAULT, strict: bool = True, direct: bool = False, where: Column | str | None = None
) -> DataFrame:
    """Add the gate structs and ``decision``, decided by the first gate that fails.

    ``direct`` (or a post whose source is 'direct_input') skips gate 1. ``where`` limits the posts
    that are triaged; unlike a filter written after triage it reaches the scan.
    """
    df = _text_columns(df if where is None else df.where(where))
    skip = F.lit(direct) | F.col("_direct")
    df = gate1(df, vocab).withColumn("intent", F.when(skip, skipped_intent()).otherwise(F.col("intent")))
    ok1 = F.col("intent.category") == "predictive_ml_task"
    df = gate2(df, vocab, strict, ok1)
    ok2 = F.coalesce(F.col("feasibility.feasible"), F.lit(False))
    df = step3(df, vocab, ok2)
    ok3 = F.coalesce(~F.col("research.is_research"), F.lit(False))
    df = gate3(df, vocab, ok3)
    ok4 = F.coalesce(F.col("causal_validity.valid"), F.lit(False))
    df = gate4(df, vocab, strict, ok4)
    ok5 = F.coalesce(F.col("justification.justified"), F.lit(False))

    def verdict(decision, content, category, reasoning, justification, action):
        return F.struct(
            F.lit(decision).alias("decision"),
            X.as_col(content).alias("content_type"),
            X.as_col(category).alias("category"),
            reasoning.alias("reasoning"),
            justification.alias("justification"),
            action.alias("recommended_action"),
        )

    no, task = "do_not_train", F.lit("predictive_ml_task")
    intent, feas = F.col("intent"), F.col("feasibility")
    short, research = F.lit("insufficient_information"), F.lit("research_concept")
    result = (
        F.when(
            ~ok1,
            verdict(no, intent["category"], intent["category"], intent["reasoning"],
                    intent["reasoning"], intent["recommended_action"]),
        )
        .when(
            ~ok2,
            verdict(no, short, short, feas["reasoning"], F.lit(M.INSUFFICIENT_JUSTIFICATION),
                    F.lit(M.INSUFFICIENT_ACTION)),
        )
        .when(
            ~ok3,
            verdict(no, research, research, F.col("research.reasoning"),
                    F.lit(M.RESEARCH_JUSTIFICATION), F.col("research.recommended_action")),
        )
        .when(
            ~ok4,
            verdict(no, task, F.lit("causal_concern"), F.col("causal_validity.reasoning"),
                    F.lit(M.CAUSAL_JUSTIFICATION), F.col("causal_validity.recommended_action")),
        )
        .when(
            ~ok5,
            verdict(no, task, F.lit("unjustified_ml"), F.col("justification.reasoning"),
                    F.lit(M.UNJUSTIFIED_JUSTIFICATION), F.col("justification.recommended_action")),
        )
        .otherwise(
            verdict("train", task, task, F.lit(M.TRAIN_REASONING),
                    F.col("justification.reasoning"), F.lit(M.TRAIN_ACTION))
        )
    )
    definition = F.when(
        ok5,
        F.struct(*[feas[c].alias(c) for c in ("target", "features", "task_type", "data_source", "intended_use")]),
    )
    return (
        df.withColumn("decision", X.once(result))
        .withColumn("definition", X.once(definition))
        .drop("_raw", "_all", "_body", "_direct")
    )


def approved(decided: DataFrame) -> DataFrame:
    """Posts that may go on to training."""
    return decided.where(F.col("decision.decision") == "train")


def first_approved(decided: DataFrame, order: Sequence[str] = ("seq",), n: int = 1) -> DataFrame:
    """The first approved post in list order."""
    return approved(decided).orderBy(*order).limit(n)


def direct_decision(df: DataFrame) -> DataFrame:
    """Direct mode after enhancement: every statement is approved, no gate is run."""
    definition = F.struct(
        F.coalesce(X.filled("target_variable"), F.lit("target")).alias("target"),
        F.coalesce(F.col("input_features"), F.array().cast(STRINGS)).alias("features"),
        F.coalesce(X.filled("problem_type"), F.lit("classification")).alias("task_type"),
        F.coalesce(X.filled("data_source"), F.lit(M.DEFAULT_SOURCE)).alias("data_source"),
        F.coalesce(X.filled("intended_use"), F.lit(M.DEFAULT_CANONICAL_USE)).alias("intended_use"),
    )
    decision = F.struct(
        F.lit("train").alias("decision"),
        F.lit("predictive_ml_task").alias("content_type"),
        F.lit("predictive_ml_task").alias("category"),
        F.lit(M.DIRECT_REASONING).alias("reasoning"),
        F.lit(M.DIRECT_JUSTIFICATION).alias("justification"),
        F.lit(M.TRAIN_ACTION).alias("recommended_action"),
    )
    return df.withColumns({"decision": decision, "definition": definition})


def resolve_task(df: DataFrame) -> DataFrame:
    """Add ``task_type`` and ``key_features``: decision, then classification, then canonical form."""
    by_decision, by_class, by_canon = (
        X.filled("definition.task_type"),
        X.filled("ml_classification.task_type"),
        X.filled("canonical.problem_type"),
    )
    none = F.array().cast(STRINGS)
    return df.withColumns(
        {
            "task_type": F.coalesce(by_decision, by_class, by_canon, F.lit("classification")),
            "key_features": F.coalesce(
                F.when(by_decision.isNotNull(), F.coalesce("definition.features", none))
                .when(by_class.isNotNull(), F.coalesce("ml_classification.key_features", none))
                .when(by_canon.isNotNull(), F.coalesce("canonical.input_features", none)),
                none,
            ),
        }
    )


def default_problem(df: DataFrame, statement: str = "full_text") -> DataFrame:
    """Problem fields guessed from a bare statement."""
    text = F.lower(X.blank(statement))
    money = text.contains("price") | text.contains("cost")
    churn = text.contains("churn")
    return df.withColumns(
        {
            "problem_type": F.when(~churn & money, "regression").otherwise("classification"),
            "target_variable": F.when(churn, "churn").when(money, "price").otherwise("target"),
            "input_features": F.array(*[F.lit(x) for x in M.DEFAULT_INPUT_FEATURES]),
        }
    )


def merge_canonical(df: DataFrame, answers: DataFrame, on: str = "id") -> DataFrame:
    """Bring parsed canonical answers into the posts and restate their text.

    ``answers`` has ``on`` and ``canonical``; posts without an answer keep their text
    and get the guessed fields.
    """
    got = df.drop("canonical").join(answers.select(on, "canonical"), on, "left")
    canon = F.col("canonical")
    has = canon.isNotNull()
    guess = default_problem(got)
    restated = X.enhanced_statement(canon["target_variable"], canon["input_features"])
    fields = {
        "problem_type": F.when(has, F.coalesce(canon["problem_type"], F.lit("unknown"))).otherwise(F.col("problem_type")),
        "target_variable": F.when(has, X.blank(canon["target_variable"])).otherwise(F.col("target_variable")),
        "input_features": F.when(
            has, F.coalesce(canon["input_features"], F.array().cast(STRINGS))
        ).otherwise(F.col("input_features")),
        "intended_use": F.when(has, X.blank(canon["intended_use"])),
        "data_source": F.when(has, X.blank(canon["data_source"])),
        "evaluation_metric": F.when(has, X.blank(canon["evaluation_metric"])),
        "full_text": F.when(has, restated).otherwise(F.col("full_text")),
        "description": F.when(has, restated).otherwise(F.col("description")),
    }
    return guess.withColumns(fields)


# -- feasibility classification --------------------------------------------


def discussion_flag(title: X.Col, text: X.Col) -> Column:
    """Talks about a topic without asking for anything to be built."""
    return X.bound(X.combined(title, text), _discusses)


def _discusses(low: X.Col) -> Column:
    return X.any_keyword(low, V.DISCUSSION_MARKER) & ~X.any_keyword(low, V.DISCUSSION_ACTION)


def rule_classify(df: DataFrame) -> DataFrame:
    """Add ``rule``: the keyword classifier's answer as a struct."""
    # Columns of their own: computed once, not once per word list.
    df = df.withColumns({
        "_rule_title": F.lower(X.blank("title")), "_rule_body": F.lower(X.blank("full_text")), "_rule_all": X.combined("title", "full_text")})

    def seen(vocab):
        return X.any_keyword("_rule_body", vocab) | X.any_keyword("_rule_title", vocab)

    code = (
        F.when(_discusses("_rule_all"), "discussion")
        .when(~seen(V.FEASIBLE_ML), "no_ml")
        .when(seen(V.FEASIBLE_CLASSIFICATION), "classification")
        .when(seen(V.FEASIBLE_REGRESSION), "regression")
        .when(seen(V.FEASIBLE_CLUSTERING), "clustering")
        .otherwise("other")
    )
    df = df.withColumn("_code", X.once(code))
    code = F.col("_code")
    rejected = code.isin("discussion", "no_ml")
    confidence = (
        F.when(code == "discussion", 0.9).when(code == "no_ml", 0.3)
        .when(code == "clustering", 0.65).when(code == "other", 0.6).otherwise(0.7)
    )
    rule = F.struct(
        (~rejected).alias("feasible"),
        F.when(rejected, "none").otherwise(code).alias("task_type"),
        confidence.alias("confidence"),
        F.when(~rejected, X.next_words("full_text", default=M.DEFAULT_KEY_FEATURES)).alias("key_features"),
        F.when(code == "discussion", M.DISCUSSION).when(code == "no_ml", M.NO_ML)
        .otherwise(F.concat(F.lit(M.RULE_PREFIX), code, F.lit(M.RULE_SUFFIX))).alias("reasoning"),
        (code == "discussion").alias("is_discussion"),
        F.when(~rejected, "rule_based").alias("method"),
    )
    return df.withColumn("rule", rule).drop("_code", "_rule_title", "_rule_body", "_rule_all")


def classify(
    df: DataFrame,
    answers: DataFrame | None = None,
    min_confidence: float = 0.7,
    key: str = "id",
) -> DataFrame:
    """Add ``ml_classification``.

    ``answers`` (optional): ``key`` and ``answer`` struct(feasible, task_type, confidence,
    key_features, reasoning, is_discussion), at most one row per key. An answer counts
    when it is confident enough and the post is not a discussion; else the rule decides.
    """
    df = rule_classify(df)
    rule = F.col("rule")
    empty = F.struct(
        F.lit(False).alias("feasible"),
        F.lit("none").alias("task_type"),
        F.lit(0.0).alias("confidence"),
        F.lit(None).cast(STRINGS).alias("key_features"),
        F.lit(M.EMPTY_TEXT).alias("reasoning"),
        F.lit(False).alias("is_discussion"),
        F.lit(None).cast("string").alias("method"),
    )
    result = rule
    if answers is not None:
        df = df.join(answers.select(key, F.col("answer").alias("_answer")), key, "left")
        a = F.col("_answer")
        answered = F.struct(
            a["feasible"].alias("feasible"),
            a["task_type"].alias("task_type"),
            a["confidence"].alias("confidence"),
            a["key_features"].cast(STRINGS).alias("key_features"),
            a["reasoning"].alias("reasoning"),
            F.coalesce(a["is_discussion"], F.lit(False)).alias("is_discussion"),
            F.lit("answer").alias("method"),
        )
        usable = F.coalesce(a["confidence"] >= min_confidence, F.lit(False))
        result = F.when(usable & ~rule["is_discussion"], answered).otherwise(rule)
    result = F.when(F.length(X.blank("full_text")) == 0, empty).otherwise(result)
    return df.withColumn("ml_classification", result).drop("rule", "_answer")


def filter_feasible(
    df: DataFrame,
    min_confidence: float = 0.7,
    exclude_types: Sequence[str] = ("none", "other"),
) -> DataFrame:
    """Feasible, confident and of a usable task type; pass () to ignore the type."""
    c = F.col("ml_classification")
    keep = c["feasible"] & (c["confidence"] >= min_confidence)
    if exclude_types:
        keep = keep & ~c["task_type"].isin(*exclude_types)
    return df.where(keep)
