"""Prepare a table for training: target, categories, gaps, split, selection, scale, balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import vocab as V
from siftline.operators.knn import knn_join
from siftline.operators.ranking import first_per_group, hash_order, mark_per_group

# Up to this many rows the built-in exact percentile holds its values in one aggregation buffer.
DIRECT_ROWS = 1_000_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# -- target -----------------------------------------------------------------


def distinct_counts(df: DataFrame, columns: Sequence[str], below: int | None = None) -> dict[str, int]:
    """Distinct non-NULL values per column, all columns in one or two passes.

    With ``below`` only counts under it need to be exact: columns whose estimate is far
    above it keep the estimate.
    """
    if not columns:
        return {}
    todo, out = list(columns), {}
    if below is not None:
        est = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
        out = {c: est[c] for c in columns}
        todo = [c for c in columns if est[c] < 3 * below + 10]
    if todo:
        row = df.agg(*[F.count_distinct(c).alias(c) for c in todo]).first()
        out.update({c: row[c] for c in todo})
    return out


def detect_target(df: DataFrame, task: str, names: Sequence[str] = V.TARGET_NAMES, levels: int = 20) -> str | None:
    """The target column: by name, else by task, else the last."""
    cols = df.columns
    if not cols:
        return None
    for c in cols:
        if c.lower() in names:
            return c
    if task == "classification":
        texts = set(text_columns(df))
        n = distinct_counts(df, cols, below=levels)
        for c in cols:
            if (c in texts or n[c] < levels) and n[c] > 1:
                return c
    if task == "regression":
        numeric = [c for c in numeric_columns(df) if not isinstance(df.schema[c].dataType, T.BooleanType)]
        if numeric:
            return numeric[-1]
    return cols[-1]


def evaluation_target(df: DataFrame, stored: str | None, task: str) -> str | None:
    """The stored target, else the first usual name, None when there is none."""
    if stored in df.columns:
        return stored
    return next((c for c in V.EVAL_TARGETS.get(task, V.EVAL_TARGETS["regression"]) if c in df.columns), None)


def features_and_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def align_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Exactly the wanted columns in order; missing ones and NULLs are 0."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)).alias(c) for c in wanted])


# -- categories -------------------------------------------------------------


def stacked(df: DataFrame, columns: Sequence[str], dtype: str = "string", keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value): several columns under each other."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(dtype).alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.column", "p.value")


def value_counts(df: DataFrame, columns: Sequence[str], n: int | None = 50) -> DataFrame:
    """(column, value, count): most frequent values per column, ties by value."""
    counts = stacked(df, columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    return counts if n is None else first_per_group(counts, ["column"], [F.col("count").desc(), "value"], n)


def top_categories(df: DataFrame, columns: Sequence[str], n: int = 50) -> dict[str, list[str]]:
    """Kept values of the columns with more than ``n`` levels (at most ``n`` values each)."""
    levels = distinct_counts(df, columns)
    wide = [c for c in columns if levels[c] > n]
    if not wide:
        return {}
    out: dict[str, list[str]] = {c: [] for c in wide}
    for r in value_counts(df, wide, n).collect():
        out[r["column"]].append(r["value"])
    return out


def cap_categories(df: DataFrame, kept: Mapping[str, Sequence[str]], other: str = "other") -> DataFrame:
    """Values outside the kept ones, NULL included, become 'other'."""
    return df.withColumns({
        c: F.when(F.col(c).isin(*vals), F.col(c)).otherwise(other) for c, vals in kept.items() if c in df.columns
    })


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): alphabetical codes from 0, NULL as the text 'nan'.

    Meant for capped columns, which have at most 51 levels.
    """
    levels = stacked(df, columns).select("column", F.coalesce("value", F.lit("nan")).alias("value")).distinct()
    return levels.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)


def ordinal_encode(df: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace text by its code."""
    codes = category_codes(df, columns) if codes is None else codes
    for c in columns:
        table = codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.withColumn("_v", F.coalesce(F.col(c), F.lit("nan"))).join(table, "_v", "left")
        df = df.withColumn(c, F.col("_c")).drop("_v", "_c")
    return df


def onehot_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Levels per column in order without the first; for columns capped to few levels."""
    rows = stacked(df, columns).where("value is not null").distinct().orderBy("column", "value").collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: v[1:] for c, v in out.items()}


def onehot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns ``column_value``; NULL and the dropped level are all zero."""
    new = [
        F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c, vals in levels.items() for v in vals
    ]
    return df.select(*[c for c in df.columns if c not in levels], *new)


# -- statistics -------------------------------------------------------------


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,), direct_rows: int = DIRECT_ROWS,
    accuracy: int = 10_000,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, NULL and NaN left out.

    Small tables use the built-in aggregate, which keeps all distinct values of a column
    in one buffer. Larger ones bracket each quantile by approximate ones, count what lies
    below the bracket, and order only the values inside it.
    """
    if not columns:
        return {}
    x = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    n = x.agg(*[F.count(c).alias(c) for c in columns]).first()
    if max(n[c] for c in columns) <= direct_rows:
        row = x.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}

    pad = 2.0 / accuracy
    wanted = [(c, p) for c in columns for p in probs if n[c] > 0]
    brackets = x.agg(*[
        F.approx_percentile(c, F.array(F.lit(max(0.0, p - pad)), F.lit(min(1.0, p + pad))), F.lit(accuracy)).alias(f"q{i}")
        for i, (c, p) in enumerate(wanted)
    ]).first()
    below = x.agg(*[F.count_if(F.col(c) < brackets[f"q{i}"][0]).alias(f"q{i}") for i, (c, _) in enumerate(wanted)]).first()
    inside = F.array(*[
        F.struct(F.lit(i).alias("q"), F.when(F.col(c).between(*brackets[f"q{i}"]), F.col(c)).alias("v"))
        for i, (c, _) in enumerate(wanted)
    ])
    vals = x.select(F.explode(inside).alias("e")).select("e.q", "e.v").where("v is not null").groupBy("q", "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("q").orderBy("v"))
    ranks = F.array(*[
        F.struct(F.lit(i).alias("q"), F.lit(floor(p * (n[c] - 1)) - below[f"q{i}"]).alias("lo"), F.lit(ceil(p * (n[c] - 1)) - below[f"q{i}"]).alias("hi"))
        for i, (c, p) in enumerate(wanted)
    ])
    rank = F.filter(ranks, lambda e: e["q"] == F.col("q"))[0]
    hit = vals.withColumn("end", upto).withColumn("r", rank)
    first, last = F.col("end") - F.col("m"), F.col("end")
    got = {
        r["q"]: (r["lo"], r["hi"])
        for r in hit.groupBy("q").agg(
            F.max(F.when((first <= F.col("r.lo")) & (F.col("r.lo") < last), F.col("v"))).alias("lo"),
            F.max(F.when((first <= F.col("r.hi")) & (F.col("r.hi") < last), F.col("v"))).alias("hi"),
        ).collect()
    }
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for i, (c, p) in enumerate(wanted):
        lo, hi = got[i]
        pos = p * (n[c] - 1)
        out[c].append(lo + (hi - lo) * (pos - floor(pos)))
    return {c: v or [None] * len(probs) for c, v in out.items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest on a tie."""
    if not columns:
        return {}
    top = value_counts(df, columns, 1).collect()
    got = {r["column"]: r["value"] for r in top}
    return {c: got.get(c) for c in columns}


def fill_values(df: DataFrame) -> dict[str, float | str]:
    """Median for numbers, mode for text, 0 where a column has no value."""
    num, txt = numeric_columns(df), text_columns(df)
    med = {c: v[0] for c, v in exact_quantiles(df, num).items()}
    return {**{c: 0.0 if v is None else v for c, v in med.items()}, **{c: "0" if v is None else v for c, v in modes(df, txt).items()}}


def impute(df: DataFrame, fills: Mapping[str, float | str] | None = None) -> DataFrame:
    fills = fill_values(df) if fills is None else fills
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double") if isinstance(v, float) else F.col(c), F.lit(v)) for c, v in fills.items() if c in df.columns
    })


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps by the column mean."""
    if not columns:
        return df
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[c] if row[c] is not None else 0.0)) for c in columns})


def robust_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(median, IQR) per column; a zero IQR counts as 1."""
    q = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    return {c: (v[1] or 0.0, ((v[2] or 0.0) - (v[0] or 0.0)) or 1.0) for c, v in q.items()}


def robust_scale(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, f_value): between-class over within-class variance, from per-class sums."""
    rows = stacked(df, columns, "double", keep=[label])
    # Moments per class merge in partial aggregation; the class table is small.
    g = rows.groupBy("column", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("w"))
    tot = g.groupBy("column").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("ssw"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("ssb"),
    )
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return tot.select(F.col("column").alias("feature"), F.when((F.col("ssw") > 0) & (F.col("k") > 1), f).alias("f_value"))


def select_features(df: DataFrame, columns: Sequence[str], label: str, n: int = 50) -> list[str]:
    """The ``n`` columns with the highest F, in table order; all when there are no more."""
    if len(columns) <= n:
        return list(columns)
    best = anova_f(df, columns, label).orderBy(F.col("f_value").desc_nulls_last(), "feature").limit(n)
    keep = {r["feature"] for r in best.collect()}
    return [c for c in columns if c in keep]


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Smallest and largest class and their ratio."""
    c = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return c.withColumn("ratio", F.when(F.col("smallest") > 0, F.col("largest") / F.col("smallest")).otherwise(1.0))


# -- split, folds, balance --------------------------------------------------


def split(df: DataFrame, key: str, label: str | None = None, test_size: float = 0.2, seed: int = 42,
          max_classes: int = 100, out: str = "is_test") -> DataFrame:
    """Mark the test rows: per class ceil(test_size · n), by hash order of the key.

    Stratified when the label has fewer than ``max_classes`` classes.
    """
    if label is not None:
        n = df.agg(F.approx_count_distinct(label)).first()[0]
        if n < 2 * max_classes and df.select(label).distinct().count() < max_classes:
            return mark_per_group(df, label, key, F.ceil(F.lit(test_size) * F.col("n") - 1e-9), seed, out)
    one = df.withColumn("_all", F.lit(0))
    return mark_per_group(one, "_all", key, F.ceil(F.lit(test_size) * F.col("n") - 1e-9), seed, out).drop("_all")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 7, out: str = "fold") -> DataFrame:
    """Fold number of each row from the hash of its key."""
    h = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (h % k).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 7, out: str = "fold") -> DataFrame:
    """Folds that hold each class in equal shares, to one row.

    Rows of a class are dealt out in hash order. Their places come from counts per class and
    leading hash digits, so no class is ordered as a whole.
    """
    numbered = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 4))
    counts = numbered.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_l").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    same = F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c"))
    dealt = numbered.withColumn("_p", place).join(counts, same).withColumn(out, ((F.col("_at") + F.col("_p") - 1) % k).cast("int"))
    return dealt.drop("_h", "_b", "_l", "_c", "_at", "_p")


def smote(df: DataFrame, key: str, label: str, vector: str = "vec", k: int = 5, seed: int = 42) -> DataFrame:
    """(label, vec, synthetic): every class grown to the size of the largest.

    A new row lies between a row and one of its ``k`` nearest rows of the same class. Each
    row of a class is used floor or ceil of its share of the missing rows, so counts are exact.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).collect()
    largest, smallest = max(r["n"] for r in sizes), min(r["n"] for r in sizes)
    k = min(k, smallest - 1)
    real = df.select(label, vector, F.lit(False).alias("synthetic"))
    short = {r[label]: r["n"] for r in sizes if r["n"] < largest}
    if not short or k < 1:
        return real
    rows = df.where(F.col(label).isin(*short)).select(
        F.col(key).alias("id"), F.col(label).alias("_y"), F.transform(vector, lambda x: x.cast("double")).alias("vec"))
    need = F.lit(largest) - F.col("n")
    extra = mark_per_group(rows, "_y", "id", need % F.col("n"), seed, "_one_more")
    whole = F.create_map(*[F.lit(x) for y, n in short.items() for x in (y, (largest - n) // n)])
    copies = extra.withColumn("_times", whole[F.col("_y")] + F.col("_one_more").cast("int"))
    copies = copies.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))

    class_text = F.col("_y").cast("string").alias("part")
    points = rows.select("id", "vec", class_text)
    near = knn_join(points, points, k, part="part", exclude_self=True)
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))).select("id", "_rank", "neighbour")

    def rnd(salt: str) -> Column:
        text = F.concat_ws("-", F.col("id").cast("string"), F.col("_copy").cast("string"), F.lit(f"{salt}{seed}"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(16**8)

    picked = copies.withColumns({"_rank": (F.floor(rnd("n") * k) + 1).cast("int"), "_u": rnd("u")}).join(near, ["id", "_rank"])
    other = rows.select(F.col("id").alias("neighbour"), F.col("vec").alias("_to"))
    made = picked.join(other, "neighbour").select(
        F.col("_y").alias(label), F.zip_with("vec", "_to", lambda a, b: a + F.col("_u") * (b - a)).alias(vector), F.lit(True).alias("synthetic"))
    return real.withColumn(vector, F.transform(vector, lambda x: x.cast("double"))).unionByName(made)
