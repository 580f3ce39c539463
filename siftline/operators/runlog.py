"""Analytics over run results, logs, decisions and model registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import patterns as P
from siftline.functions import text as X
from siftline.functions import vocab as V
from siftline.schemas import RUN_RESULT


def read_runs(spark: SparkSession, folder: str, glob: str = "pipeline_results_*.json", multi_line: bool = False) -> DataFrame:
    """Run results of many files, a row per line; what does not parse is left out.

    ``multi_line`` reads files that hold one result each, spread over lines.
    """
    return (
        spark.read.schema(RUN_RESULT).option("pathGlobFilter", glob).option("multiLine", multi_line)
        .option("mode", "DROPMALFORMED").json(folder)
    )


# -- stage latency ----------------------------------------------------------


def next_value(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, out: str, bucket: str = "day"
) -> DataFrame:
    """Add ``out``: ``value`` of the next row of the same key in (ts, tie) order.

    A plain ``lead`` sorts all rows of a key in one task. Here a key's rows are cut into
    time buckets; inside a bucket ``lead`` does the work, and a bucket's last row takes
    the value from the first row of the key's next bucket.
    """
    b = df.withColumn("_b", F.date_trunc(bucket, ts))
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, tie)
    heads = b.groupBy(*keys, "_b").agg(F.min(F.struct(F.col(ts).alias("a"), F.col(tie).alias("b"), F.col(value).alias("v"))).alias("_h"))
    follow = heads.withColumn("_next", F.lead("_h").over(Window.partitionBy(*keys).orderBy("_b"))).select(
        *keys, "_b", F.col("_next.v").alias("_carry")
    )
    led = b.withColumn("_v", F.lead(value).over(inside)).withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    joined = led.join(follow, [*keys, "_b"])
    return joined.withColumn(out, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col("_v"))).drop(
        "_b", "_v", "_last", "_carry"
    )


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def stage_latency(
    markers: DataFrame, run: str = "run_id", ts: str = "ts", order: str = "line_no", stage: str = "stage", bucket: str = "day"
) -> DataFrame:
    """(run, stage, ts, seconds): from each marker to the next one of its run.

    A marker with a NULL stage ends the stage before it and starts none.
    """
    led = next_value(markers.select(run, ts, order, stage), [run], ts, order, ts, "_end", bucket)
    led = led.where(F.col("_end").isNotNull() & F.col(stage).isNotNull())
    return led.select(run, stage, ts, seconds_between(ts, "_end").alias("seconds"))


def canonical_stage(name: X.Col, titles: dict[str, str] = V.STAGE_NAMES) -> Column:
    """Reported name of a stage title; any other title with 'feasibility' in it is that stage."""
    table = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    known = table[X.as_col(name)]
    known = F.when(known.isin(*V.LATENCY_STAGES), known)
    return F.coalesce(known, F.when(F.lower(X.as_col(name)).contains("feasibility"), "feasibility"))


def mean_latency(latencies: DataFrame, stage: str = "stage", titles: dict[str, str] = V.STAGE_NAMES) -> DataFrame:
    named = latencies.withColumn("canonical", canonical_stage(stage, titles)).where("canonical is not null")
    return named.groupBy("canonical").agg(F.avg("seconds").alias("mean_seconds"), F.count("*").alias("n"))


def read_markers(lines: DataFrame, run: str = "run_id", line: str = "value", order: str = "line_no") -> DataFrame:
    """Stage markers of raw log lines (run, line_no, value).

    A marker stands on the timestamped line or on the line right after it.
    """
    parts = lines.select(
        run, order, F.col(line).alias("_l"),
        F.try_to_timestamp(F.nullif(F.regexp_extract(line, P.LOG_LINE, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("_ts"),
        F.regexp_extract(line, P.LOG_LINE, 2).alias("_msg"),
    )
    # The text of an empty message is the next line: shift line numbers instead of sorting the log.
    stamped = parts.where("_ts is not null")
    below = stamped.where(F.trim("_msg") == "").select(run, (F.col(order) + 1).alias(order), F.col("_ts").alias("ts"))
    own = stamped.where(F.trim("_msg") != "").select(run, order, F.col("_ts").alias("ts"), F.col("_msg").alias("msg"))
    cont = parts.where("_ts is null").select(run, order, F.col("_l").alias("msg")).join(below, [run, order])
    msgs = own.unionByName(cont.select(run, order, "ts", "msg"))
    msgs = msgs.where(F.col("msg").rlike(P.STAGE_MARKER) | F.col("msg").rlike(P.END_MARKER))
    return msgs.select(run, order, "ts", X.filled(F.regexp_extract("msg", P.STAGE_MARKER, 1)).alias("stage"))


# -- funnels ----------------------------------------------------------------


def success_funnel(runs: DataFrame) -> DataFrame:
    """Runs that got through each stage, all earlier stages included."""
    levels = ("ml_decision", "feasibility", "dataset_discovery", "training", "testing")
    names = ("logic_decision", "feasibility", "dataset_discovery", "training", "testing")
    aggs, so_far = [], F.lit(True)
    for level, name in zip(levels, names):
        so_far = so_far & F.coalesce(F.col(f"stages.{level}.success"), F.lit(False))
        aggs.append(F.count_if(so_far).alias(name))
    return runs.agg(F.sum(F.coalesce("total_problems_evaluated", F.lit(1))).alias("total"), *aggs)


def rejecting_gate(d: Column) -> Column:
    """The gate that stopped a rejected decision; an unmarked rejection counts as intent."""
    g = d["gate_results"]
    return (
        F.when(F.coalesce(g["intent"]["category"] != "predictive_ml_task", F.lit(False)), "intent")
        .when(~F.coalesce(g["feasibility"]["feasible"], F.lit(True)), "feasibility")
        .when(~F.coalesce(g["causal_validity"]["valid"], F.lit(True)), "causal")
        .when(~F.coalesce(g["justification"]["justified"], F.lit(True)), "justification")
        .otherwise("intent")
    )


def gate_funnel(runs: DataFrame) -> DataFrame:
    """Posts left after each gate, step by step."""
    decisions = F.col("stages.ml_decision.decisions")
    none = F.coalesce(F.size(decisions), F.lit(0)) <= 0
    direct = none & F.col("success") & F.col("stages.training").isNotNull()

    def passed(d: Column) -> Column:
        return F.coalesce(d["decision"] == "train", F.lit(False))

    def stopped_by(gate: str):
        return lambda d: ~passed(d) & (rejecting_gate(d) == gate)

    def number(test) -> Column:
        return F.sum(F.when(~none, F.size(F.filter(decisions, test))).otherwise(0))

    c = runs.agg(
        F.sum(F.coalesce("total_problems_evaluated", F.lit(0)) + F.when(direct, 1).otherwise(0)).alias("evaluated"),
        (number(passed) + F.count_if(direct)).alias("approved"),
        *[number(stopped_by(g)).alias(g) for g in ("intent", "feasibility", "causal")],
    )
    v2 = F.col("evaluated") - F.col("intent")
    return c.select(
        "evaluated", v2.alias("intent_valid"), (v2 - F.col("feasibility")).alias("feasible"),
        (v2 - F.col("feasibility") - F.col("causal")).alias("causal_valid"), "approved",
    )


def run_duration(runs: DataFrame) -> DataFrame:
    """Mean length of the runs that ended after they started."""
    s = seconds_between("start_time", "end_time")
    return runs.select(s.alias("s")).where("s > 0").agg(F.avg("s").alias("mean_seconds"), F.count("*").alias("n"))


def stage_summary(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Evaluated, approved and rejected posts."""
    ok = F.col("decision") == "train"
    return decisions.groupBy(*by).agg(
        F.count("*").alias("evaluated"), F.count_if(ok).alias("approved"), F.count_if(~ok).alias("rejected")
    )


# -- rejection report -------------------------------------------------------


def _rejected(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision") == "do_not_train").select(
        "seq", F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("reasoning", F.lit("Unknown")).alias("reasoning"),
        F.coalesce("recommended_action", F.lit("N/A")).alias("recommended_action"),
    )


def rejection_counts(decisions: DataFrame) -> DataFrame:
    return _rejected(decisions).groupBy("category").agg(F.count("*").alias("n"))


def rejection_report(decisions: DataFrame) -> DataFrame:
    """Rejections by category and reason.

    One row per distinct reason with its count in place of a list with every copy of it.
    """
    reasons = _rejected(decisions).groupBy("category", "reasoning", "recommended_action").agg(F.count("*").alias("n"))
    # Reasons come from a fixed set of texts, so the table under the window is small.
    return reasons.withColumn("category_n", F.sum("n").over(Window.partitionBy("category")))


def rejection_samples(decisions: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rejections with their 1-based position; ``seq`` counts posts from 0."""
    first = _rejected(decisions).orderBy("seq").limit(n)
    return first.select((F.col("seq") + 1).alias("index"), "category", "reasoning", "recommended_action")


# -- model registry ---------------------------------------------------------


def _metric_rows(registry: DataFrame) -> DataFrame:
    """(task_type, metric, value): r2 stands in for the accuracy of a regression."""
    m = registry.select("task_type", F.explode("metrics").alias("m"))
    reg = F.col("task_type") == "regression"
    cls = F.col("task_type") == "classification"
    cols = {
        "accuracy": F.when(cls, F.col("m.accuracy")).when(reg, F.col("m.r2")),
        **{c: F.when(cls, F.col(f"m.{c}")) for c in ("precision", "recall", "f1_score")},
        "r2_score": F.when(reg, F.col("m.r2")),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in cols.items()])
    return m.select(F.explode(entries).alias("e")).select("e.metric", "e.value")


def metric_summary(registry: DataFrame, positive_only: bool = False, defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Mean, population deviation, range and count per metric, zeros left out.

    ``positive_only`` leaves negative values out too; ``defaults`` fills metrics without values.
    """
    rows = _metric_rows(registry)
    keep = F.col("value") > 0 if positive_only else F.col("value") != 0
    out = rows.where(keep & F.col("value").isNotNull()).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.count("*").alias("n"),
    )
    if defaults is None:
        return out
    spark = registry.sparkSession
    known = spark.createDataFrame(list(defaults.items()), "metric string, fallback double")
    return F.broadcast(known).join(out, "metric", "left").select(
        "metric", F.coalesce("mean", "fallback").alias("mean"), F.coalesce("n", F.lit(0)).alias("n")
    )


def best_models(registry: DataFrame) -> DataFrame:
    return registry.select(F.explode("metrics").alias("m")).select(F.coalesce("m.best_model", F.lit("Unknown")).alias("model"))


def dataset_source(dataset_id: X.Col, description: X.Col) -> Column:
    ident = F.lower(X.blank(dataset_id))
    return (
        F.when(ident.contains("synthetic"), "Synthetic")
        .when(ident.contains("/") | F.lower(X.blank(description)).contains("kaggle"), "Kaggle")
        .otherwise("Other")
    )


def source_share(datasets: DataFrame) -> DataFrame:
    """Rows (id, description) per kind of source, kinds without rows included."""
    counts = datasets.select(dataset_source("id", "description").alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    kinds = datasets.sparkSession.createDataFrame([("Kaggle",), ("Synthetic",), ("Other",)], "source string")
    return kinds.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def problem_registry_stats(registry: DataFrame) -> DataFrame:
    seen = F.coalesce("seen_count", F.lit(0))
    return registry.agg(
        F.count("*").alias("total_problems"), F.coalesce(F.sum(seen), F.lit(0)).alias("total_seen_count"),
        F.count_if(seen == 1).alias("unique_problems"), (F.count("*") - F.count_if(seen == 1)).alias("duplicate_problems"),
    )


def model_registry_stats(registry: DataFrame, max_trains: int = 2) -> DataFrame:
    n = F.coalesce("train_count", F.lit(0))
    return registry.agg(
        F.count("*").alias("total_entries"), F.coalesce(F.sum(n), F.lit(0)).alias("total_trainings"),
        F.count_if(n >= max_trains).alias("duplicate_models"),
    )


