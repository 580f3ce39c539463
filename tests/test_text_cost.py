"""Texts are changed once per row, not once per word looked for, and searched by patterns only where these can match."""

from pyspark.sql import functions as F

from siftline.functions import answers as A
from siftline.functions import patterns as P
from siftline.functions import text as X
from siftline.operators import triage as T


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_looked_for_in_a_text_that_is_lowered_once(spark):
    posts = spark.createDataFrame([("t", "predict a feature x")], "title string, full_text string")
    plan = optimized(T.rule_classify(posts).select("rule.task_type", "rule.key_features"))
    assert not [x for x in plan.split("exists(")[1:] if "lower(" in x[:120]]
    plan = optimized(A.parse_sections(posts.withColumnRenamed("full_text", "response_text")))
    assert plan.count("trim(coalesce(response_text") <= 1


def test_trimmed_takes_every_blank_of_the_pattern(spark):
    texts = [c + "a" + c + "b" + c * 2 for c in (*P.SPACES, "​", "﻿", "x")] + ["", " \n\x85", "a \n", " a \r\n"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", X.trimmed("t").alias("got"), F.regexp_replace("t", P.TRIM, "").alias("want")).collect():
        assert r["got"] == r["want"], ascii(r["t"])


def test_heads_of_patterns_lose_no_match(spark):
    assert [X.head(r) for r in ("predictions?" + P.SPACE, "feature[s]?x", "help(?:with|to)", "a|b", "[ab]c")] == ["prediction", "feature", "help", "", ""]
    texts = ["PREDICT  sales, Inputs are a b. Variable: x", "nothing here", "Classify Spam; target : y", "based ON\tage. USING csv TO"]
    d = spark.createDataFrame([(t, t.lower()) for t in texts], "t string, low string")
    for regexes in (P.TARGET, P.FEATURE):
        for r in d.select(X.find_all("t", regexes).alias("want"), X.find_all("t", regexes, lower="low").alias("got")).collect():
            assert r["got"] == r["want"]


def test_next_words_as_by_tokens(spark):
    texts = ["Feature variable column x", "xfeature y", "feature", "feature　A" + "b" * 30 + " input\n\nz", "the input, a", "attribute \U0001f600" + "q" * 25, None, ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", X.next_words("t").alias("got")).collect():
        words = [w for w in X.re.split("[\\s　]+", (r["t"] or "").lower()) if w]
        want = [b[:20] for a, b in zip(words, words[1:]) if a in ("feature", "variable", "column", "attribute", "input")][:5]
        assert r["got"] == (want or ["features", "data"]), r["t"]
