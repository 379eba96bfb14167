"""Health of scrape runs and content drift between observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import cosine
from tidemark.operators.metrics import guarded
from tidemark.plans.skew import exact_median

# Score weights and warning thresholds.
WEIGHTS = {"parse": 0.30, "price": 0.20, "title": 0.20, "rows": 0.15, "price_drift": 0.15}
WARN = {"parse": 0.05, "price": 0.10, "title": 0.20, "image": 0.30, "ean": 0.50, "rows": 0.20, "price_drift": 0.30}
HEALTHY_FROM = 0.7


def run_metrics(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, missing rates, unique products and price statistics per run.

    ``parsed`` holds good and bad lines as from ``parse_scrapes``.
    """
    by = list(by)
    good = F.col("error_type").isNull()
    price = F.when(good & (F.col("price") > 0), F.col("price"))

    def blank(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) == ""

    stats = parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(good).alias("parsed_records"),
        F.count_if(~good).alias("parse_error_count"),
        F.count_if(good & ~F.coalesce(F.col("price") > 0, F.lit(False))).alias("missing_price_count"),
        F.count_if(good & blank("product_name")).alias("missing_title_count"),
        F.count_if(good & F.col("image_urls").isNull()).alias("missing_image_count"),
        F.count_if(good & blank("ean")).alias("missing_ean_count"),
        F.avg(price).alias("price_mean"),
        F.stddev_samp(price).alias("price_std"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
    )
    # Distinct products in two steps, so a large run is first reduced by product.
    products = parsed.filter(good).select(*by, "competitor_product_id").distinct().groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_products")
    )
    medians = exact_median(parsed.filter(good & (F.col("price") > 0)), by, "price", "price_median")
    out = stats.join(products, by, "left").join(medians, by, "left").na.fill(0, ["unique_products"])
    rates = {"parse_error_rate": guarded(F.col("parse_error_count"), F.col("total_records"))}
    for name in ("price", "title", "image", "ean"):
        rates[f"missing_{name}_rate"] = guarded(F.col(f"missing_{name}_count"), F.col("parsed_records"))
    return out.withColumns(rates)


def run_drift(metrics: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row-count and price drift against expected rows and historical price mean and std."""
    joined = metrics.join(expected, list(by), "left")
    rows = F.when(
        F.col("expected_rows") > 0, (F.col("parsed_records") - F.col("expected_rows")) / F.col("expected_rows")
    )
    price = F.when(
        (F.col("history_std") > 0) & (F.col("history_mean") != 0),
        F.abs(F.col("price_mean") - F.col("history_mean")) / F.col("history_std"),
    )

    def severity(value: Column, full: float) -> Column:
        return F.when(value >= full, 1.0).otherwise(value / full)

    return joined.withColumns({
        "row_count_drift": rows,
        "row_count_severity": severity(F.abs(rows), 0.5),
        "price_drift": price,
        "price_drift_severity": severity(price, 3.0),
    })


def run_health(drift: DataFrame) -> DataFrame:
    """Health score, healthy flag and warning flags; no baseline earns full credit."""
    def credit(column: str, weight: str) -> Column:
        return (F.lit(1.0) - F.coalesce(F.col(column), F.lit(0.0))) * F.lit(WEIGHTS[weight])

    score = (
        credit("parse_error_rate", "parse") + credit("missing_price_rate", "price")
        + credit("missing_title_rate", "title") + credit("row_count_severity", "rows")
        + credit("price_drift_severity", "price_drift")
    )
    drift_rows = F.col("row_count_drift")
    flags = F.array_compact(F.array(
        F.when(F.col("parse_error_rate") > WARN["parse"], "high_parse_errors"),
        F.when(F.col("missing_price_rate") > WARN["price"], "high_missing_price"),
        F.when(F.col("missing_title_rate") > WARN["title"], "high_missing_title"),
        F.when(F.col("missing_image_rate") > WARN["image"], "high_missing_image"),
        F.when(F.col("missing_ean_rate") > WARN["ean"], "high_missing_ean"),
        F.when(drift_rows < -WARN["rows"], "row_count_drop").when(drift_rows > WARN["rows"], "row_count_spike"),
        F.when(F.col("price_drift_severity") > WARN["price_drift"], "price_distribution_drift"),
        F.when((F.col("unique_products") < 10) & (F.col("total_records") > 100), "low_unique_products"),
    ))
    return drift.withColumns({
        "health_score": score,
        "warning_flags": F.when(F.col("total_records") == 0, F.array(F.lit("empty_run"))).otherwise(flags),
    }).withColumn("is_healthy", F.col("health_score") >= HEALTHY_FROM)


def content_drift(df: DataFrame, threshold: float = 0.2, shorter_than: float = 0.5) -> DataFrame:
    """Drift of title vectors and degradation of titles against the row before.

    Needs title, embedding and their ``previous_`` twins.
    """
    title, old = F.coalesce("title", F.lit("")), F.coalesce("previous_title", F.lit(""))
    both = (title != "") & (old != "")
    similarity = F.when(
        F.col("previous_embedding").isNotNull() & F.col("embedding").isNotNull() & (title != ""),
        cosine(F.col("embedding"), F.col("previous_embedding")),
    )
    return df.withColumns({
        "has_previous": F.col("previous_embedding").isNotNull(),
        "title_similarity": similarity,
        "title_length_ratio": F.when(both, F.length(title) / F.length(old)),
    }).withColumns({
        "title_drift": F.coalesce(1 - F.col("title_similarity") > threshold, F.lit(False)),
        "content_degraded": F.coalesce(F.col("title_length_ratio") < shorter_than, F.lit(False))
        | ((old != "") & (title == "")),
    })


def content_drift_summary(drift: DataFrame, by: Sequence[str]) -> DataFrame:
    out = drift.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if("has_previous").alias("with_previous"),
        F.count_if("title_drift").alias("with_title_drift"),
        F.count_if("content_degraded").alias("with_degradation"),
        F.avg("title_similarity").alias("mean_similarity"),
        F.min("title_similarity").alias("min_similarity"),
    )
    return out.withColumns({
        "title_drift_rate": guarded(F.col("with_title_drift"), F.col("with_previous")),
        "degradation_rate": guarded(F.col("with_degradation"), F.col("with_previous")),
    })


def problem_products(drift: DataFrame, by: Sequence[str], ident: str) -> DataFrame:
    """Drifted and degraded products as rows: a run's list may be long, so it is not an array."""
    kinds = F.array_compact(F.array(
        F.when(F.col("title_drift"), "drifted"), F.when(F.col("content_degraded"), "degraded")
    ))
    return drift.select(*by, ident, F.explode(kinds).alias("problem"))
