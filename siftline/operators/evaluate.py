"""Metrics over prediction rows (label, prediction [, probability, model, fold])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.blocks import matrix, read_blocks, write_blocks
from siftline.operators.ranking import first_per_group


def confusion(preds: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(by…, label, prediction, n): all further metrics need only these counts."""
    return preds.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs; 0 where undefined."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = conf.select(*by, F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"), hit.alias("hit"))
    said = conf.select(*by, F.col("prediction").alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("hit"))
    c = actual.unionByName(said).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit")
    )
    p = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    c = c.withColumns({"precision": p, "recall": r})
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1_score", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def classification_metrics(preds: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    c = per_class(confusion(preds, by, label, prediction), by)
    n = F.sum("support")

    def weighted(name: str) -> Column:
        return (F.sum(F.col(name) * F.col("support")) / n).alias(name)

    return c.groupBy(*by).agg(
        (F.sum("hit") / n).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1_score"),
        n.alias("n"),
    )


def classification_report(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class, then accuracy, macro and weighted averages."""
    c = per_class(confusion(preds, (), label, prediction))
    rows = c.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1_score", "support")
    n = F.sum("support")
    weighted = [(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("precision", "recall", "f1_score")]
    macro = [F.avg(m).alias(m) for m in ("precision", "recall", "f1_score")]
    acc = F.sum("hit") / n
    return (
        rows.unionByName(c.agg(F.lit("macro avg").alias("class"), *macro, n.alias("support")))
        .unionByName(c.agg(F.lit("weighted avg").alias("class"), *weighted, n.alias("support")))
        .unionByName(c.agg(F.lit("accuracy").alias("class"), *[acc.alias(m) for m in ("precision", "recall", "f1_score")], n.alias("support")))
    )


def regression_metrics(preds: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2, MSE, RMSE, MAE in one pass; R2 is NULL for a constant label."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    spread = F.var_pop(y) * F.count(y)
    out = preds.groupBy(*by).agg(
        F.sum((y - p) * (y - p)).alias("_sse"), spread.alias("_sst"), F.avg(F.abs(y - p)).alias("mae"), F.count("*").alias("n"),
    )
    mse = F.col("_sse") / F.col("n")
    return out.withColumns(
        {"r2": F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")), "mse": mse, "rmse": F.sqrt(mse)}
    ).drop("_sse", "_sst")


def cv_summary(fold_scores: DataFrame, by: Sequence[str] = ("model",), score: str = "score") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return fold_scores.groupBy(*by).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))


def leaderboard(scores: DataFrame, score: str = "score", order: str = "seq", n: int | None = None) -> DataFrame:
    """Models by score; the earlier one wins a tie."""
    ranked = scores.orderBy(F.col(score).desc_nulls_last(), F.col(order))
    return ranked if n is None else ranked.limit(n)


def vote_hard(preds: DataFrame, key: str = "id", prediction: str = "prediction") -> DataFrame:
    """Most frequent prediction per row; the smallest wins a tie."""
    counts = preds.groupBy(key, prediction).agg(F.count("*").alias("_n"))
    best = counts.groupBy(key).agg(F.max(F.struct("_n", (-F.col(prediction)).alias("_p"))).alias("b"))
    return best.select(key, (-F.col("b._p")).alias(prediction))


def vote_soft(preds: DataFrame, key: str = "id", probability: str = "probability") -> DataFrame:
    """Class with the highest mean probability; the smallest wins a tie."""
    parts = preds.select(key, F.posexplode(probability).alias("class", "p"))
    mean = parts.groupBy(key, "class").agg(F.avg("p").alias("p"))
    best = mean.groupBy(key).agg(F.max(F.struct("p", (-F.col("class")).alias("c"))).alias("b"))
    return best.select(key, (-F.col("b.c")).cast("double").alias("prediction"), F.col("b.p").alias("confidence"))


def silhouette_squared(df: DataFrame, cluster: str = "prediction", vector: str = "vec") -> DataFrame:
    """Mean silhouette under squared Euclidean distance.

    The sum of squared distances to a cluster follows from its size, its vector sum and
    its sum of squares, so the pass is linear in the rows.
    """
    x = df.select(F.col(cluster).alias("c"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    sq = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    dims = x.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("s"))
    sums = dims.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("sums"))
    stats = x.groupBy("c").agg(F.count("*").alias("n"), F.sum(sq).alias("ss")).join(sums, "c")
    # One value for all rows, with one element per cluster; clusters are few.
    table = stats.agg(F.collect_list(F.struct("c", "n", "ss", "sums")).alias("t"))
    j = x.withColumns({"xx": sq, "t": table.scalar()})

    def total(e: Column) -> Column:
        dot = F.aggregate(F.zip_with("x", e["sums"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return e["n"] * F.col("xx") + e["ss"] - 2 * dot

    own = F.filter("t", lambda e: e["c"] == F.col("c"))[0]
    others = F.filter("t", lambda e: e["c"] != F.col("c"))
    j = j.withColumns(
        {
            "a": F.when(own["n"] > 1, total(own) / (own["n"] - 1)),
            "b": F.array_min(F.transform(others, lambda e: total(e) / e["n"])),
        }
    )
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return j.agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def silhouette(df: DataFrame, cluster: str = "prediction", vector: str = "vec", block: int = 4096) -> DataFrame:
    """Mean silhouette under Euclidean distance, over all rows.

    Quadratic by nature. Rows are written once, cluster by cluster, in files of about ``block`` rows;
    a task takes the rows of one file and reads all files one after the other. A row's summed distance
    to a cluster is complete when the cluster ends, so a task holds two numbers a row and one block.
    """
    import numpy as np
    import pandas as pd

    x = df.select(F.col(cluster).cast("int").alias("c"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    x = x.withColumn("rid", F.monotonically_increasing_id())
    files = write_blocks(x, ["c", "rid"], x.count(), block, "silhouette")

    def rows(uri: str):
        for b in read_blocks(uri, block):
            c, v = b.column("c"), b.column("x")
            if v.null_count or v.flatten().null_count:
                raise ValueError("a vector is missing or has a gap")
            yield c.to_numpy(zero_copy_only=False).astype(float), matrix(v, len(c))

    def sums(batches):
        for i in (i for pdf in batches for i in pdf["id"]):
            for own, a in rows(files[i]):
                within, other, total, at, n = np.full(len(a), np.nan), np.full(len(a), np.nan), np.zeros(len(a)), None, 0

                def close():
                    if at is not None:
                        if n > 1:
                            within[own == at] = total[own == at] / (n - 1)
                        other[own != at] = np.fmin(other[own != at], total[own != at] / n)

                for uri in files:
                    for c, b in rows(uri):
                        starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]) & ~np.isnan(c))
                        if not len(starts):
                            continue
                        ends, parts = np.append(starts[1:], len(c)), np.empty((len(a), len(starts)))
                        b2 = (b * b).sum(1)
                        for s in range(0, len(a), 256):
                            p = a[s:s + 256]
                            sq = (p * p).sum(1)[:, None] + b2[None, :] - 2 * p @ b.T
                            parts[s:s + 256] = np.add.reduceat(np.sqrt(np.maximum(sq, 0.0)), starts, axis=1)
                        for j, start in enumerate(starts):
                            if at != c[start]:
                                close()
                                total, at, n = np.zeros(len(a)), c[start], 0
                            total, n = total + parts[:, j], n + int(ends[j] - start)
                close()
                yield pd.DataFrame({"a": within, "b": other})

    spark = df.sparkSession
    ab = spark.range(0, len(files), 1, max(1, len(files))).mapInPandas(sums, "a double, b double")
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.avg(s).alias("silhouette"), F.count("*").alias("n"))


def best_of(scores: DataFrame, by: Sequence[str], score: str, order: str) -> DataFrame:
    """The best row of each group, the earlier one on a tie."""
    return first_per_group(scores, by, [F.col(score).desc(), order])
