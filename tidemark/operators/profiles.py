"""Profiles of history depth, exclusions and detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import last_rows, product_counts
from tidemark.operators.metrics import guarded
from tidemark.plans.skew import exact_median


def history_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per series: mean, quartiles, extremes, deviation, skewness.

    Series are first counted by depth, so the percentiles see one weighted row
    per depth. Skewness is the mean cubed deviation over the cubed sample
    deviation.
    """
    depth = product_counts(df, keys).groupBy("series_rows").agg(F.count(F.lit(1)).alias("w"))
    c, w = F.col("series_rows"), F.col("w")
    moments = depth.agg(F.sum("w").alias("n"), (F.sum(c * w) / F.sum("w")).alias("mean"))
    with_mean = depth.join(F.broadcast(moments))
    gap = c - F.col("mean")
    out = with_mean.agg(
        F.max("n").alias("n_series"), F.max("mean").alias("mean_rows"),
        F.percentile("series_rows", F.lit(0.5), w).alias("median_rows"),
        F.percentile("series_rows", F.lit(0.25), w).alias("p25"),
        F.percentile("series_rows", F.lit(0.75), w).alias("p75"),
        F.min("series_rows").alias("min_rows"), F.max("series_rows").alias("max_rows"),
        F.sqrt(F.sum(gap * gap * w) / (F.max("n") - 1)).alias("std_rows"),
        (F.sum(gap * gap * gap * w) / F.max("n")).alias("_third"),
    )
    return out.withColumn("skewness", F.col("_third") / F.pow("std_rows", F.lit(3))).drop("_third")


def history_buckets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series per depth bucket. The bins are (0,5], (5,10], ..., under the labels 1-4, 5-9, ..."""
    c = F.col("series_rows")
    bucket = (
        F.when(c <= 5, "1-4").when(c <= 10, "5-9").when(c <= 20, "10-19").when(c <= 50, "20-49")
        .when(c <= 100, "50-99").otherwise("100+")
    )
    return product_counts(df, keys).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_series"))


def split_diagnostics(df: DataFrame, keys: Sequence[str], order: Sequence[str], minimum: int = 5, last_n: int = 2) -> DataFrame:
    """Hold-out size, span of the last rows, change rate and share of recently changed series."""
    keys, order = list(keys), list(order)
    w = Window.partitionBy(*keys).orderBy(*order)
    counts = product_counts(df, keys)
    c = F.col("series_rows")
    usable = c >= minimum
    sizes = counts.agg(
        guarded(F.sum(F.when(usable, F.greatest(c - last_n, F.lit(0)))), F.sum(F.when(usable, c))).alias("train_share"),
        guarded(F.sum(F.when(usable, F.least(c, F.lit(last_n)))), F.sum(F.when(usable, c))).alias("test_share"),
    )
    spans = last_rows(df, keys, order, last_n).groupBy(*keys).agg(
        F.date_diff(F.max(order[0]), F.min(order[0])).alias("span")
    ).join(counts, keys).filter(usable).agg(
        F.avg("span").alias("mean_span_days"), F.avg((F.col("span") < 28).cast("double")).alias("span_under_4_weeks")
    )
    before = df.withColumn("_p", F.lag("price").over(w)).filter("_p IS NOT NULL")
    changes = before.agg(F.avg((F.col("price") != F.col("_p")).cast("double")).alias("change_rate"))
    recent = last_rows(df, keys, order, last_n + 1).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("price").alias("prices")
    ).agg(F.avg(((F.col("rows") > last_n) & (F.col("prices") > 1)).cast("double")).alias("recent_change_share"))
    return sizes.join(F.broadcast(spans)).join(F.broadcast(changes)).join(F.broadcast(recent))


def exclusion_levels(df: DataFrame, keys: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """What each minimum history would exclude, from depth counts only."""
    depth = product_counts(df, keys).groupBy("series_rows").agg(F.count(F.lit(1)).alias("w"))
    wide = depth.withColumn("mh", F.explode(F.array(*[F.lit(x) for x in levels])))
    out = F.col("series_rows") < F.col("mh")
    return wide.groupBy("mh").agg(
        F.coalesce(F.sum(F.when(out, F.col("w"))), F.lit(0)).alias("excluded"),
        (F.coalesce(F.sum(F.when(out, F.col("w"))), F.lit(0)) * 100 / F.sum("w")).alias("excluded_pct"),
        F.coalesce(F.sum(F.when(~out, F.col("w") * F.col("series_rows"))), F.lit(0)).alias("kept_rows"),
    )


def excluded_series(df: DataFrame, keys: Sequence[str], by: str, minimum: int) -> DataFrame:
    """Excluded series per ``by``: share, median first sighting and price variation."""
    series = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("c"), F.min("seen_at").alias("first"),
        F.stddev_samp("price").alias("_std"), F.avg("price").alias("_mean"),
    )
    # The variation of a series of zeros is 0 / 0, not a number: it sorts above all others.
    share = F.when(F.col("_mean") != 0, F.col("_std") / F.nullif("_mean", F.lit(0.0)))
    share = share.when(F.col("_std") > 0, float("inf")).when(F.col("_std") == 0, float("nan"))
    series = series.withColumn("cv", share)
    out = F.col("c") < minimum
    base = series.groupBy(by).agg(
        F.count_if(out).alias("excluded"), F.count(F.lit(1)).alias("total"),
        (F.count_if(out) * 100 / F.count(F.lit(1))).alias("excluded_pct"),
    )
    first = exact_median(series.filter(out).withColumn("s", F.unix_timestamp("first")), [by], "s", "_first")
    day = F.date_diff(F.to_date(F.timestamp_seconds(F.col("_first"))), F.lit("1990-01-01"))
    gone = exact_median(series.filter(out), [by], "cv", "excluded_median_cv")
    kept = exact_median(series.filter(~out), [by], "cv", "included_median_cv")
    joined = base.join(first, by, "left").join(gone, by, "left").join(kept, by, "left")
    return joined.withColumn("excluded_first_day", F.coalesce(day, F.lit(-1)).cast("long")).drop("_first")


def detection_by_type(preds: DataFrame, product: str) -> DataFrame:
    """Share of products with a detected injection per type and detector, with 'any' and 'TOTAL'."""
    hits = preds.filter("truth").groupBy(product, "anomaly_type", "detector").agg(F.max("predicted").alias("hit"))
    types = F.array(F.col("anomaly_type"), F.lit("TOTAL"))
    names = F.array(F.col("detector"), F.lit("any"))
    wide = hits.withColumn("anomaly_type", F.explode(types)).withColumn("detector", F.explode(names))
    once = wide.groupBy(product, "anomaly_type", "detector").agg(F.max("hit").alias("hit"))
    return once.groupBy("anomaly_type", "detector").agg(
        F.count(F.lit(1)).alias("n_products"), (F.count_if("hit") * 100 / F.count(F.lit(1))).alias("rate")
    )
