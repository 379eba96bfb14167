"""Saved baseline states, keyed by a signature of their source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import baseline_states


def source_signature(df: DataFrame, columns: Sequence[str]) -> str:
    """Order-free signature of a frame: row count and sums of row hashes."""
    row = df.select(F.xxhash64(*columns).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
        F.bit_xor("h").alias("x"),
    ).first()
    return f"{row.n}-{row.s or 0}-{row.x or 0}"


def load_or_build(
    root: str, train: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, bool]:
    """Baselines for ``train`` from ``root`` when saved before, else built and saved.

    Returns the states and whether they were built.
    """
    spark = train.sparkSession
    signature = source_signature(train, [*keys, *order, "price"])
    path = f"{root}/signature={signature}"
    try:
        return spark.read.parquet(path), False
    except AnalysisException:
        baseline_states(train, keys, order).write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path), True
