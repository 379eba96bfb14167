"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
# Tables of parameters up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def shield(df: DataFrame, needed: Sequence[str] = DOCUMENT) -> DataFrame:
    """``df`` with every column that is not exactly one of ``needed`` under a neutral name.

    Extra columns may then have any name, also one that an operator uses inside
    or one that differs from a needed one only in case. ``toDF(*df.columns)``
    brings the names back.
    """
    return df.toDF(*[c if c in needed else f"extra_{i}_" for i, c in enumerate(df.columns)])


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas of the body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def key_of(*columns: str) -> Column:
    """One non-null text per combination of values, nulls included."""
    return F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})


def join_parameters(df: DataFrame, parameters: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per group; broadcast only after counting it."""
    if parameters.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        parameters = F.broadcast(parameters)
    return df.join(parameters, key, how)


def sum_before(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before this one, with no task holding a whole group.

    ``bucket`` never falls along ``order``. Buckets are summed first; a row gets
    the sum of the buckets before its own and of the rows before it in its own.
    """
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(base, [*by, bucket]).withColumn(name, F.col("_base") + F.col("_local")).drop("_base", "_local")
