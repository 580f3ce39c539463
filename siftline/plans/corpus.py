"""Posts derived from the documents table, in Spark and in SQL.

The raw documents hold no task words, so each is prefixed by one of sixteen
statements that between them reach every branch of triage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.sqltext import q
from siftline.session import load, spread

STATEMENTS = (
    "Predict price of houses based on rooms and area. The goal is to help with budgeting using csv data and learn from thousands of rows.",
    "Classify customers into churn category based on usage and tenure. The goal is to help with retention in a kaggle dataset.",
    "New arxiv paper on transfer learning.",
    "Scalability of an ML serving stack.",
    "Wondering about causation.",
    "Wondering how to predict churn.",
    "New feature launch announcement.",
    "A short story from my desk.",
    "Salary talk at my company.",
    "Visualize sales numbers.",
    "Hello world.",
    "Predict loan default to recommend treatment based on income. The goal is to help with credit data.",
    "Predict sales based on price. The goal is to help with bias in csv data.",
    "Predict demand with a simple threshold based on stock. The goal is to help with csv data.",
    "Predict churn with a reinforcement learning agent based on usage. The goal is to help with csv data.",
    "Predict churn and forecast sales based on usage. The goal is to help with csv data.",
)


def statement(key: str):
    out = F.lit(STATEMENTS[-1])
    for i, s in enumerate(STATEMENTS[:-1]):
        out = F.when(F.col(key) % len(STATEMENTS) == i, F.lit(s)).otherwise(out)
    return out


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_posts(spread(load(spark, sf_dir, "documents")))


def as_posts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("Item "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(statement("doc_id"), F.lit(" "), F.col("text")).alias("full_text"),
        F.col("text").alias("description"),
        "source",
        "lang",
    )


_CASE = "CASE doc_id % 16 " + " ".join(
    f"WHEN {i} THEN {q(s)}" for i, s in enumerate(STATEMENTS)
) + " END"

POSTS_SQL = f"""posts0 AS (
  SELECT doc_id AS seq, 'doc-' || doc_id AS id, 'Item ' || doc_id AS title,
         {_CASE} || ' ' || text AS full_text, text AS description, source, lang
  FROM documents),
posts AS (
  SELECT *, lower(title || ' ' || full_text) AS a, title || ' ' || full_text AS raw,
         lower(full_text) AS b, source = 'direct_input' AS direct
  FROM posts0)"""
