"""Detector metrics as conditional sums with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["accuracy", "precision", "recall", "tnr", "f1", "g_mean"]
SPLIT_WEIGHTS = {"new_prices": 0.7, "new_products": 0.3}


def guarded(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(0.0)


def confusion(predicted: str | Column = "predicted", truth: str | Column = "truth") -> list[Column]:
    p = F.coalesce(F.col(predicted) if isinstance(predicted, str) else predicted, F.lit(False))
    t = F.coalesce(F.col(truth) if isinstance(truth, str) else truth, F.lit(False))
    return [
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"),
    ]


def weighted_confusion(rows: str, predicted: str = "predicted", truth: str = "truth") -> list[Column]:
    """``confusion`` of a table whose rows each stand for ``rows`` equal ones."""
    p, t = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(truth), F.lit(False))
    cells = {"tp": p & t, "fp": p & ~t, "fn": ~p & t, "tn": ~p & ~t}
    return [F.sum(F.when(c, F.col(rows)).otherwise(0)).alias(n) for n, c in cells.items()]


def with_rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, tnr, F1, G, fpr and fnr from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = df.withColumns({
        "accuracy": guarded(tp + tn, tp + fp + fn + tn),
        "precision": guarded(tp, tp + fp),
        "recall": guarded(tp, tp + fn),
        "tnr": guarded(tn, tn + fp),
        "fpr": guarded(fp, tn + fp),
        "fnr": guarded(fn, tp + fn),
    })
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumns({"f1": guarded(2 * p * r, p + r), "g_mean": F.sqrt(r * F.col("tnr"))})


def detector_metrics(
    df: DataFrame, by: Sequence[str], predicted: str | Column = "predicted", truth: str | Column = "truth"
) -> DataFrame:
    counts = df.groupBy(*by).agg(*confusion(predicted, truth))
    return with_rates(counts).withColumns({
        "n_rows": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"),
        "n_injected": F.col("tp") + F.col("fn"),
        "n_predicted": F.col("tp") + F.col("fp"),
    })


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a many-to-one join key repeats on its one side."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"join key {list(keys)} is not unique")


def join_truth(predictions: DataFrame, injected: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Predictions with their row's truth, many to one; 'right' keeps rows without a prediction as unflagged."""
    require_unique(injected, keys)
    joined = predictions.join(injected, list(keys), how)
    return joined.withColumn("predicted", F.coalesce("predicted", F.lit(False)))


def rate_by_type(df: DataFrame, by: Sequence[str], predicted: str = "predicted") -> DataFrame:
    """Any flagged injected row counts as detected."""
    rows = df.filter(F.col("anomaly_type").isNotNull())
    hit = F.coalesce(F.col(predicted), F.lit(False))
    return rows.groupBy(*by, "anomaly_type").agg(
        F.count(F.lit(1)).alias("injected_count"), F.count_if(hit).alias("detected_count")
    ).withColumn("detection_rate", guarded(F.col("detected_count"), F.col("injected_count")))


def one_vs_rest(df: DataFrame, by: Sequence[str], predicted: str = "predicted") -> DataFrame:
    """Metrics where only one type is positive, for every type seen in the group's data.

    Counts per (group, type, flag) come first; types meet that small table only.
    """
    counts = df.groupBy(*by, "anomaly_type").agg(
        F.count_if(F.col(predicted)).alias("_flag"), F.count_if(~F.col(predicted)).alias("_clear")
    )
    types = df.select(F.col("anomaly_type").alias("anomaly_case")).filter("anomaly_case IS NOT NULL").distinct()
    # A handful of names: the injected types.
    pairs = counts.join(F.broadcast(types))
    own = F.coalesce(F.col("anomaly_type") == F.col("anomaly_case"), F.lit(False))

    def total(column: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(column)).otherwise(0))

    return with_rates(pairs.groupBy(*by, "anomaly_case").agg(
        total("_flag", own).alias("tp"), total("_flag", ~own).alias("fp"),
        total("_clear", own).alias("fn"), total("_clear", ~own).alias("tn"),
    ))


def add_combined(df: DataFrame, split: str = "dataset_split") -> DataFrame:
    """Every row also under the pooled split 'combined'."""
    return df.withColumn(split, F.explode(F.array(F.col(split), F.lit("combined"))))


def weighted_combined(metrics: DataFrame, by: Sequence[str], split: str = "dataset_split") -> DataFrame:
    """Replace F1 and G of the pooled rows by the 0.7 / 0.3 mean of the splits' own values."""
    weight = F.lit(0.0)
    for name, w in SPLIT_WEIGHTS.items():
        weight = F.when(F.col(split) == name, w).otherwise(weight)
    scores = metrics.groupBy(*by).agg(
        F.sum(F.col("f1") * weight).alias("_f1"), F.sum(F.col("g_mean") * weight).alias("_g")
    )
    joined = metrics.join(scores, list(by))
    pooled = F.col(split) == "combined"
    return joined.withColumns({
        "f1": F.when(pooled, F.col("_f1")).otherwise(F.col("f1")),
        "g_mean": F.when(pooled, F.col("_g")).otherwise(F.col("g_mean")),
    }).drop("_f1", "_g")


def sweep_histogram(
    df: DataFrame, by: Sequence[str], families: dict[str, tuple[str | Column, Sequence[float]]],
    truth: str = "truth",
) -> DataFrame:
    """Rows counted by how many of a family's thresholds their score exceeds.

    One pass over the rows answers every threshold, and the result is small,
    so scopes and history levels can be expanded after it.
    """

    def passed(score: str | Column, thresholds: Sequence[float]) -> Column:
        value = F.coalesce(F.col(score) if isinstance(score, str) else score, F.lit(float("-inf")))
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t < value))

    entries = [
        F.struct(F.lit(name).alias("family"), passed(score, thresholds).alias("passed"))
        for name, (score, thresholds) in families.items()
    ]
    t = F.coalesce(F.col(truth), F.lit(False))
    rows = df.select(*by, t.alias("_t"), F.explode(F.array(*entries)).alias("_e"))
    return rows.groupBy(*by, "_e.family", "_e.passed").agg(
        F.count_if("_t").alias("pos"), F.count_if(~F.col("_t")).alias("neg")
    )


def sweep_metrics(
    histogram: DataFrame, by: Sequence[str], families: dict[str, tuple[str | Column, Sequence[float]]]
) -> DataFrame:
    """Metrics of ``score > threshold`` per family and threshold from a histogram."""
    levels = F.array(*[
        F.struct(F.lit(name).alias("family"), F.lit(i).alias("i"), F.lit(float(v)).alias("threshold"))
        for name, (_, thresholds) in families.items() for i, v in enumerate(sorted(thresholds))
    ])
    own = F.filter(levels, lambda x: x.family == F.col("family"))
    spread = histogram.withColumn("_l", F.explode(own))
    above = F.col("passed") > F.col("_l.i")

    def total(column: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(column)).otherwise(0))

    counts = spread.groupBy(*by, "family", F.col("_l.threshold").alias("threshold")).agg(
        total("pos", above).alias("tp"), total("neg", above).alias("fp"),
        total("pos", ~above).alias("fn"), total("neg", ~above).alias("tn"),
    )
    return with_rates(counts)


def threshold_sweep(
    df: DataFrame, by: Sequence[str], score: str, thresholds: Sequence[float], truth: str = "truth"
) -> DataFrame:
    """Metrics of one score at every threshold, from one pass over the rows."""
    families = {"score": (score, thresholds)}
    return sweep_metrics(sweep_histogram(df, by, families, truth), by, families).drop("family")
