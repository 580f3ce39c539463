"""A training corpus from ``documents``: identify, deduplicate, decontaminate, mix, tokenise."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, language_id, mixing, near_dedup, token_output
from siftline.session import load, scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a known language; learnt from those not held out."""
    return language_id.keep_identified(docs, language_id.fit(docs.where(~language_id.held_out())))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 0.8)."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources until the mix has 0.9 of the largest entropy; none is lost."""
    return mixing.apply(docs, mixing.plan(docs, "whole", entropy=0.9), epoch="_epoch").drop("_epoch")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids in their file format and read the index of documents back."""
    folder = scratch(spark, "corpus-tokens")
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_output.write_tokens(docs, folder, path, 0, public_tokenizers.PATTERN)
    return token_output.read_tokens(spark, folder, digest=True)


STAGES = [
    ("language identification", identify),
    ("near-duplicate removal", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mix),
    ("token output", tokenise),
]

ORACLE_SQL = None  # language identification, MinHash and the tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written and read again."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
