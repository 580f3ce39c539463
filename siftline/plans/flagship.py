"""The whole way from posts to their catalog matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import similarity as S
from siftline.operators.triage import approved, triage
from siftline.plans import corpus
from siftline.session import cut, load


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog entries."""
    task = F.when(F.col("p_size") > 25, "regression").otherwise("classification")
    part = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dataset_id"), F.col("p_name").alias("title"),
        F.concat("p_type", F.lit(" dataset for "), task, F.lit(" of churn based on usage")).alias("description"),
        F.array("p_brand").alias("tags"))
    return part.select("dataset_id", X.dataset_text("title", "description", "tags").alias("match_text"))


def triage_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, title, task_type, dataset_id, similarity, rank) of the posts that may be trained on."""
    ok = approved(triage(corpus.posts(spark, sf_dir))).select(
        "seq", "title", F.col("definition.task_type").alias("task_type"),
        X.problem_text("title", "full_text", "definition.task_type", "definition.features").alias("match_text"))
    ok = cut(ok)
    m = S.match(ok.withColumnRenamed("seq", "problem_id"), catalog(spark, sf_dir))
    out = m.join(ok.withColumnRenamed("seq", "problem_id"), "problem_id")
    return out.select(
        F.col("problem_id").alias("seq"), "title", "task_type", "dataset_id", F.round("similarity", 6).alias("similarity"), "rank")
