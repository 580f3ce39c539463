"""Structured answers embedded in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as X
from siftline.functions import vocab as V
from siftline.operators.triage import CANONICAL_TYPE

KIND_JSON, KIND_CANONICAL, KIND_SECTIONS = "feasibility", "canonical", "sections"

_ANSWER = T.StructType(
    [
        T.StructField("feasible", T.BooleanType()),
        T.StructField("task_type", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("dataset_available", T.BooleanType()),
        T.StructField("key_features", T.ArrayType(T.StringType())),
        T.StructField("challenges", T.ArrayType(T.StringType())),
        T.StructField("reasoning", T.StringType()),
        T.StructField("is_discussion", T.BooleanType()),
    ]
)


def json_part(text: X.Col) -> Column:
    """From the first '{' to the last '}', NULL without both."""
    t = X.trimmed(X.blank(text))
    start, back = F.instr(t, "{"), F.instr(F.reverse(t), "}")
    end = F.length(t) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(t, start, end - start + 1))


def _has_keys(doc: Column, keys: tuple[str, ...]) -> Column:
    """All keys are there, whatever their values; NULL for text that is not a JSON object."""
    names = F.json_object_keys(doc)
    return F.size(F.array_intersect(names, F.array(*[F.lit(k) for k in keys]))) == len(keys)


def _normal_task(task: Column) -> Column:
    task = F.lower(X.blank(task))
    return (
        F.when(task.isin(*V.TASK_TYPES), task)
        .when(task.contains("classif"), "classification")
        .when(task.contains("regress"), "regression")
        .when(task.contains("cluster"), "clustering")
        .otherwise("other")
    )


def parse_feasibility(df: DataFrame, text: str = "response_text") -> DataFrame:
    """Add ``answer``, NULL unless the text holds a JSON object with the three required fields."""
    df = df.withColumn("_json", json_part(text))
    doc = F.col("_json")
    ok = _has_keys(doc, ("feasible", "task_type", "confidence"))
    df = df.withColumn("_a", F.when(ok, F.from_json(doc, _ANSWER, {"mode": "PERMISSIVE"})))
    a = F.col("_a")
    confidence = a["confidence"].try_cast("double")
    fields = [a[f.name].alias(f.name) for f in _ANSWER.fields if f.name not in ("task_type", "confidence")]
    answer = F.struct(_normal_task(a["task_type"]).alias("task_type"), confidence.alias("confidence"), *fields)
    return df.withColumn("answer", F.when(a.isNotNull() & confidence.isNotNull(), answer)).drop("_json", "_a")


def parse_canonical(df: DataFrame, text: str = "response_text") -> DataFrame:
    """Add is_ml_problem, confidence, problem_type and ``canonical``."""
    refused = X.any_keyword(F.upper(X.blank(text)), [w.upper() for w in V.CANONICAL_REJECT])
    df = df.withColumns({"_refused": refused, "_json": json_part(text)})
    doc, refused = F.col("_json"), F.col("_refused")
    keys = F.json_object_keys(doc)
    df = df.withColumns(
        {
            "_c": F.when(~refused & keys.isNotNull(), F.from_json(doc, CANONICAL_TYPE)),
            "_whole": F.when(~refused, _has_keys(doc, ("problem_type", "target_variable", "input_features"))),
        }
    )
    c, whole = F.col("_c"), F.coalesce(F.col("_whole"), F.lit(False))
    given = sum(
        (X.filled(c[f]).isNotNull().cast("int") for f in ("intended_use", "data_source", "evaluation_metric")),
        F.lit(0),
    )
    kind = (
        F.when(refused, "rejected")
        .when(whole, F.lower(F.coalesce(c["problem_type"], F.lit("unknown"))))
        .when(c.isNotNull(), "invalid")
        .otherwise("unknown")
    )
    return df.withColumns(
        {
            "is_ml_problem": whole,
            "confidence": F.when(whole, 0.7 + (given / 3) * 0.3).otherwise(0.0),
            "problem_type": kind,
            "canonical": c,
        }
    ).drop("_refused", "_json", "_c", "_whole")


def section(text: X.Col, heading: str) -> Column:
    """First line under a '## heading', NULL when there is none."""
    return X.bound(X.trimmed(X.blank(text)), lambda t: _section(t, heading))


def _section(text: X.Col, heading: str) -> Column:
    regex = r"(?i)###?\s*" + heading + r":?\s*\n([^\n]+)"
    text = X.as_col(text)
    return F.when(text.contains("##"), X.filled(X.trimmed(F.regexp_extract(text, regex, 1))))


def parse_sections(df: DataFrame, text: str = "response_text", weak_length: int = 100, width: int = 500) -> DataFrame:
    """Add is_ml_problem, confidence, problem_type, extracted_problem and ``details``."""
    # Trimmed once, not once per section; tied to the row so that it is not copied into them again.
    df = df.withColumn("_raw", X.once(X.trimmed(X.blank(text))))
    raw = F.col("_raw")
    refused = F.upper(raw).contains("REJECTED:") | F.lower(raw).contains("not suitable")
    df = df.withColumn("_refused", refused).withColumn(
        "_d", F.struct(*[_section("_raw", h).alias(name) for name, h in V.ANSWER_SECTIONS.items()])
    )
    d, refused = F.col("_d"), F.col("_refused")
    strong = ~refused & d["title"].isNotNull() & d["problem_statement"].isNotNull()
    weak = ~refused & X.any_keyword(F.lower(raw), V.ANSWER_ML) & (F.length(raw) > weak_length)
    given = sum(
        (d[f].isNotNull().cast("int") for f in ("title", "problem_statement", "target_variable", "input_features")),
        F.lit(0),
    )
    df = df.withColumns({"_strong": strong, "_weak": weak})
    strong, weak = F.col("_strong"), F.col("_weak")
    return df.withColumns(
        {
            "is_ml_problem": strong | weak,
            "confidence": F.when(strong, 0.6 + (given / 4) * 0.4).when(weak, 0.5).otherwise(0.0),
            "problem_type": F.when(refused, "rejected")
            .when(strong, F.lower(F.coalesce(d["problem_type"], F.lit("unknown")))).otherwise("unknown"),
            "extracted_problem": F.when(strong, F.concat(d["title"], F.lit("\n\n"), d["problem_statement"]))
            .when(weak, F.substring(raw, 1, width)).otherwise(""),
            "details": F.when(strong, d),
        }
    ).drop("_raw", "_refused", "_d", "_strong", "_weak")


PARSERS = {KIND_JSON: parse_feasibility, KIND_CANONICAL: parse_canonical, KIND_SECTIONS: parse_sections}


def parse_answers(df: DataFrame, kind: str, text: str = "response_text") -> DataFrame:
    return PARSERS[kind](df, text)
