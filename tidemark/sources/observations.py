"""Observation trees: Parquet scan, path attributes, inventory checks, schema alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_COLUMNS = ["first_seen_at", "scraped_at", "timestamp"]

OBSERVATION = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("competitor_id", T.StringType()),
    T.StructField("competitor_product_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("list_price", T.DoubleType()),
    T.StructField("first_seen_at", T.TimestampType()),
    T.StructField("currency", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("product_name", T.StringType()),
])

# .../<country>/<segment>/<competitor>_<yyyy-mm-dd>.parquet[/part-...]
_LEAF = r"/([^/]+)/([^/]+)/([^/]+?)_(\d{4}-\d{2}-\d{2})[^/]*\.parquet(?:/[^/]*)?$"


def read_observations(
    spark: SparkSession, root: str, schema: T.StructType | None = None, keep_splits: bool = False
) -> DataFrame:
    """All Parquet below ``root`` with path attributes; split outputs are left out."""
    reader = spark.read.option("recursiveFileLookup", "true")
    df = reader.schema(schema).parquet(root) if schema else reader.parquet(root)
    df = df.withColumn("source_path", F.url_decode(F.col("_metadata.file_path")))
    if not keep_splits:
        df = df.filter(~F.col("source_path").rlike(r"_(train|test)[^/]*\.parquet"))
    return df.withColumns(path_attributes(F.col("source_path")))


def path_attributes(path: Column) -> dict[str, Column]:
    names = ["path_country", "path_segment", "path_competitor", "path_date"]
    return {n: F.nullif(F.regexp_extract(path, _LEAF, i), F.lit("")) for i, n in enumerate(names, 1)}


def time_column(df: DataFrame) -> str:
    for name in TIME_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError("no time column")


def align_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union in the first frame's schema: shared columns cast, missing ones null, extra ones dropped."""
    target = frames[0].schema
    out = frames[0]
    for frame in frames[1:]:
        shaped = frame.select(*[
            (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ])
        out = out.unionByName(shaped)
    return out


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """File name, size and SHA-256 of every Parquet file below ``root``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(root)
    )
    return files.select(
        F.substring_index("path", "/", -1).alias("file_name"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def file_rows(df: DataFrame) -> DataFrame:
    """Rows per file of a scan, from ``_metadata``."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))


def inventory_mismatches(actual: DataFrame, manifest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Files missing on either side or different in any of ``columns``; empty when the contract holds."""
    a, m = actual.alias("a"), manifest.alias("m")
    joined = a.join(m, F.col("a.file_name") == F.col("m.file_name"), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"m.{c}"))
    problem = (
        F.when(F.col("m.file_name").isNull(), "unexpected")
        .when(F.col("a.file_name").isNull(), "missing")
        .when(~same, "changed")
    )
    return joined.select(
        F.coalesce("a.file_name", "m.file_name").alias("file_name"), problem.alias("problem")
    ).filter(F.col("problem").isNotNull())


def assert_contract(actual: DataFrame, manifest: DataFrame, columns: Sequence[str]) -> None:
    bad = inventory_mismatches(actual, manifest, columns)
    if not bad.isEmpty():
        shown = [f"{r.file_name} {r.problem}" for r in bad.limit(5).collect()]
        raise ValueError(f"source contract broken: {shown}")
