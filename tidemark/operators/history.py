"""Filters and row choices by history depth."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.skew import bucketed_row_number, null_safe_join

DEFAULT_LEVELS = [5, 10, 15, 20, 25, 30]


def parse_levels(levels: Iterable[str | int] | None = None) -> list[int]:
    """Distinct minimum-history levels in order; accepts 5, '5' and 'mh5'."""
    if levels is None:
        return list(DEFAULT_LEVELS)
    found = set()
    for item in levels:
        match = re.fullmatch(r"(?:mh)?(-?\d+)", str(item).strip().lower())
        if not match or int(match.group(1)) < 1:
            raise ValueError(f"bad history level {item!r}")
        found.add(int(match.group(1)))
    return sorted(found)


def product_counts(df: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("series_rows"))


def with_counts(df: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Row count of each row's series. A partial aggregate and a join, not a window:
    a long series is counted on the map side and its rows are not gathered in one task."""
    return null_safe_join(df, product_counts(df, keys), keys)


def minimum_history(df: DataFrame, level: int, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    return with_counts(df, keys).filter(F.col("series_rows") >= level).drop("series_rows")


def history_levels(df: DataFrame, levels: Sequence[int], keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Rows and products kept at each level, from counts per product alone."""
    counts = product_counts(df, keys)
    kept = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("series_rows"))
    return counts.select("series_rows", F.explode(kept).alias("mh")).groupBy("mh").agg(
        F.sum("series_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_products")
    )


def expand_levels(df: DataFrame, levels: Sequence[int], keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Each row once per level its series reaches."""
    kept = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("series_rows"))
    return with_counts(df, keys).withColumn("mh", F.explode(kept)).drop("series_rows")


def valid_prices(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price") > 0)


def ok_status(column: str = "status") -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))).isin("", "ok", "success")


def series_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Position of each row in its series and the series' size.

    Months are the buckets, so a long series is numbered month by month.
    """
    month = F.year(order[0]) * 12 + F.month(order[0])
    numbered = bucketed_row_number(df, keys, month, [F.col(c) for c in order], "position")
    return with_counts(numbered, keys)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each series (a rank limit Spark pushes below the shuffle)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n).drop("_back")


def text_bucket(column: str, chars: int = 2) -> Column:
    """Integer that never falls along the binary order of ASCII text: its first characters."""
    out = F.lit(0).cast("long")
    for i in range(1, chars + 1):
        out = out * 256 + F.ascii(F.substring(column, i, 1))
    return out


def row_index(df: DataFrame, order: Sequence[str], bucket: Column, by: Sequence[str] = (),
              name: str = "evaluation_row_id") -> DataFrame:
    """Zero-based index over a total order; ``bucket`` must not fall along it."""
    numbered = bucketed_row_number(df, list(by), bucket, [F.col(c) for c in order], name)
    return numbered.withColumn(name, F.col(name) - 1)
