"""Columns of the caller that are called like helper columns stay as they are."""

from pyspark.sql import functions as F

from siftline.llm import language_id, line_dedup, mixing, near_dedup

NAMES = ("_row", "_group", "_lang_pred", "_lang_score", "_kept", "_doc", "_hash", "_s", "_e", "_cut", "_closed", "doc", "line", "n", "root", "epochs")


def source(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (3, "other words stand here and go on for a while", "en", "b"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


def unchanged(out, docs, but=()):
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES if c not in but)
    return sorted(r["doc_id"] for r in rows)


def test_operators_keep_columns_with_clashing_names(spark):
    docs = source(spark)
    assert unchanged(near_dedup.drop_near_duplicates(docs), docs) == [1, 3, 4]
    assert unchanged(line_dedup.dedup_lines(docs), docs) == [1, 2, 3, 4]
    unchanged(language_id.keep_identified(docs, language_id.fit(docs)), docs)
    out = mixing.apply(docs.where("source IS NOT NULL"), mixing.plan(docs.where("source IS NOT NULL"), "whole", entropy=0.9))
    assert out.columns == [*docs.columns, "epoch"] and unchanged(out.drop("epoch"), docs)
    again = mixing.apply(out, mixing.plan(docs, "whole", entropy=0.9))
    assert again.columns == out.columns
