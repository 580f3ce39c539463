"""Reading and writing tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.ranking import sample_exact


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None,
               multi_line: bool = False) -> DataFrame:
    """Read by extension: json, parquet, anything else as CSV with a header.

    JSON has a row per line; ``multi_line`` reads files that hold one document each, or one array.
    """
    fmt = fmt or next((e for e in ("json", "parquet") if path.lower().endswith("." + e)), "csv")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "json":
        return reader.option("multiLine", multi_line).json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    return reader.option("header", True).option("inferSchema", schema is None).csv(path)


def load_capped(spark: SparkSession, path: str, key: str, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Read a table, or a seeded sample of exactly ``max_rows`` of its rows, whatever its size."""
    df = load_table(spark, path)
    return df if max_rows is None else sample_exact(df, key, max_rows, seed)


def import_sampled(spark: SparkSession, path: str, out: str, key: str, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Land a table, or an exact sample of it, as CSV and read it back."""
    load_capped(spark, path, key, max_rows, seed).write.mode("overwrite").option("header", True).csv(out)
    return load_table(spark, out, "csv")


def csv_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the CSV files under a folder, in path order."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv").load(folder)
    )
    return files.select("path", "length").orderBy("path")


def first_csv(spark: SparkSession, folder: str) -> DataFrame | None:
    """The first CSV file under a folder, as a table."""
    first = csv_tables(spark, folder).first()
    return None if first is None else load_table(spark, first["path"], "csv")


def resource_format(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.when(F.lower(url).contains("json"), "json").otherwise("csv")


def land_resource(spark: SparkSession, path: str, out: str, multi_line: bool = False) -> DataFrame:
    """Convert a landed JSON or CSV resource to CSV and read it back."""
    fmt = "json" if "json" in path.lower() else "csv"
    load_table(spark, path, fmt, multi_line=multi_line).write.mode("overwrite").option("header", True).csv(out)
    return load_table(spark, out, "csv")


def with_target(features: DataFrame, targets: DataFrame | None, key: str) -> DataFrame:
    """Features with the first target column, named ``target``."""
    if targets is None:
        return features
    first = next(c for c in targets.columns if c != key)
    return features.join(targets.select(key, F.col(first).alias("target")), key)


INDICATOR = T.StructType(
    [
        T.StructField("country", T.StructType([T.StructField("value", T.StringType())])),
        T.StructField("date", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def flatten_indicator(df: DataFrame, response: str = "response") -> DataFrame:
    """``[meta, rows[]]`` responses to (country, year, value), rows without a value dropped."""
    rows = F.from_json(F.get_json_object(response, "$[1]"), T.ArrayType(INDICATOR))
    keep = [c for c in df.columns if c != response]
    return (
        df.select(*keep, F.explode(rows).alias("r"))
        .select(*keep, F.col("r.country.value").alias("country"), F.col("r.date").alias("year"), F.col("r.value").alias("value"))
        .na.drop(subset=["value"])
    )


def synthetic_table(spark: SparkSession, task: str = "classification", n: int = 1000, features: int = 10,
                    seed: int = 42) -> DataFrame:
    """Normal features with a known rule: y = x1 + x2 > 0, or y = 2 x1 + 1.5 x2 + 0.5 noise."""
    cols = [F.randn(seed + i).alias(f"feature_{i + 1}") for i in range(features)]
    df = spark.range(n).select("id", *cols, F.randn(seed + features).alias("_noise"))
    x1, x2 = F.col("feature_1"), F.col("feature_2")
    target = 2 * x1 + 1.5 * x2 + 0.5 * F.col("_noise") if task == "regression" else (x1 + x2 > 0).cast("int")
    return df.withColumn("target", target).drop("_noise")


def write_json(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "append") -> None:
    """Sink for posts, catalogs, metrics, run results and reports."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_predictions(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
