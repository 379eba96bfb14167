"""Scraper fault or market event: rules, agreement between competitors, learned model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.skew import join_small

INPUTS = [
    "price_changed", "price_change_pct", "title_changed", "title_similarity", "content_degraded",
    "change_persisted_runs", "cross_competitor_agreement", "price_anomaly_score", "is_price_anomaly",
    "run_health_score", "run_is_healthy",
]


def classify(df: DataFrame) -> DataFrame:
    """Five additive factors, three reductions floored at zero in order, and a band around .5."""
    agree, runs = F.col("cross_competitor_agreement"), F.col("change_persisted_runs")
    degraded, moved = F.col("content_degraded"), F.col("price_changed")
    unhealthy = F.coalesce(~F.col("run_is_healthy"), F.lit(False)) | F.coalesce(
        F.col("run_health_score") < 0.6, F.lit(False)
    )
    add = [
        ("CONTENT_DEGRADED_WITH_PRICE_CHANGE", degraded & moved, 0.40),
        ("RUN_UNHEALTHY", unhealthy, 0.25),
        ("NOT_PERSISTED", runs < 2, 0.15),
        ("NO_CROSS_COMPETITOR_AGREEMENT", F.coalesce(agree < 0.3, F.lit(False)), 0.10),
        ("HIGH_ANOMALY_SCORE", F.coalesce(F.col("price_anomaly_score") > 0.7, F.lit(False)), 0.10),
    ]
    cut = [
        ("CHANGE_WELL_PERSISTED", runs >= 4, 0.2),
        ("CROSS_COMPETITOR_CORROBORATED", F.coalesce(agree > 0.5, F.lit(False)), 0.15),
        ("CONTENT_INTACT", moved & ~degraded & ~F.col("title_changed"), 0.1),
    ]
    score = F.lit(0.0)
    for _, cond, weight in add:
        score = score + F.when(cond, weight).otherwise(0.0)
    for _, cond, weight in cut:
        score = F.when(cond, F.greatest(F.lit(0.0), score - weight)).otherwise(score)
    out = df.withColumns({
        "scrape_issue_probability": F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)),
        "reason_codes": F.array_compact(F.array(*[F.when(c, n) for n, c, _ in add + cut])),
    })
    p = F.col("scrape_issue_probability")
    out = out.withColumn(
        "classification",
        F.when(p > 0.65, "scrape_issue").when(p < 0.35, "real_event").otherwise("uncertain"),
    )
    kind = F.col("classification")
    return out.withColumns({
        "confidence": F.when(kind == "scrape_issue", F.least((p - 0.5) / 0.5, F.lit(1.0)))
        .when(kind == "real_event", F.least((0.5 - p) / 0.5, F.lit(1.0))).otherwise(0.5),
        "suppress_downstream": kind == "scrape_issue",
        "requires_persistence_check": (kind != "scrape_issue") & (runs < 2),
        "requires_manual_review": kind == "uncertain",
    })


def classifier_inputs(df: DataFrame) -> DataFrame:
    """The eleven inputs as numbers: nulls to 0, an unknown run counts as healthy."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(1.0 if c == "run_is_healthy" else 0.0)) for c in INPUTS
    })


def cross_competitor_agreement(
    changes: DataFrame, product: str = "ean", competitor: str = "competitor_id", change: str = "change_pct"
) -> DataFrame:
    """Share of a product's rows of other sellers whose change has the same sign and over half the size.

    Counted by a range window over the logarithm of the size, so no seller
    pairs are formed; a seller's own rows are counted by a second window and
    taken off. Sizes up to .0005 agree with nobody. A row without a product code
    (null or blank) has no agreement, and is not matched with other such rows.
    """
    named = F.trim(F.coalesce(F.col(product).cast("string"), F.lit(""))) != ""
    size = F.abs(F.col(change))
    live = F.coalesce(size > 0.0005, F.lit(False))
    # Rows without a code are dealt by hash: they are in no one's group.
    loose = F.when(named, F.lit(None)).otherwise(F.xxhash64(competitor, change))
    counted = changes.withColumns({
        "_size": size, "_sign": F.signum(change), "_live": live, "_named": named, "_loose": loose,
    })
    # Just under one octave either way: half the size itself does not agree.
    def near(*by: str) -> str:
        return (
            f"count(1) OVER (PARTITION BY {', '.join(by)}, _sign, _live ORDER BY log2(_size)"
            " RANGE BETWEEN 0.999999999D PRECEDING AND 0.999999999D FOLLOWING)"
        )

    own = counted.withColumn("_alike", F.expr(near(product, "_loose")) - F.expr(near(product, "_loose", competitor)))
    per_seller = changes.filter(named).groupBy(product, competitor).agg(F.count(F.lit(1)).alias("_own"))
    per_product = per_seller.groupBy(product).agg(F.sum("_own").alias("_rows"))
    sizes = join_small(per_seller, per_product, [product]).select(
        product, competitor, (F.col("_rows") - F.col("_own")).alias("_others")
    )
    out = join_small(own, sizes, [product, competitor], "left")
    return out.withColumn(
        "cross_competitor_agreement",
        F.when(F.col("_named") & (F.col("_others") > 0), F.when(F.col("_live"), F.col("_alike")).otherwise(0) / F.col("_others")),
    ).select(*changes.columns, "cross_competitor_agreement")


def train_classifier(df: DataFrame, label: str = "label", features: Sequence[str] = tuple(INPUTS)):
    """Logistic regression with classes weighted to balance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
    weights = join_small(sizes, total, []).select(
        label, (F.col("_total") / (F.col("_classes") * F.col("_n"))).alias("_weight")
    )
    rows = classifier_inputs(df).join(F.broadcast(weights), label)  # one row per class
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="_weight", maxIter=50),
    ]
    return Pipeline(stages=stages).fit(rows)
