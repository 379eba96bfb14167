"""Summaries, rankings and comparisons of metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import ok_status
from tidemark.operators.metrics import SPLIT_WEIGHTS


def trial_averages(df: DataFrame, by: Sequence[str], metrics: Sequence[str], minimum: int = 1) -> DataFrame:
    """Mean and population deviation of ``metrics`` per group with enough trials."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"), *aggs)
    return out.filter(F.col("attempts") >= minimum)


def candidate_averages(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per candidate: split means and deviations side by side, weighted scores, rank score."""
    aggs = []
    for split in SPLIT_WEIGHTS:
        for m in metrics:
            here = F.when(F.col("dataset_split") == split, F.col(m))
            aggs += [F.coalesce(F.avg(here), F.lit(0.0)).alias(f"{split}_{m}_mean"),
                     F.coalesce(F.stddev_pop(here), F.lit(0.0)).alias(f"{split}_{m}_std")]
    out = df.groupBy(*by).agg(F.count_distinct("attempt").alias("attempt_count"), *aggs)

    def weighted(m: str) -> Column:
        return sum((F.lit(w) * F.col(f"{s}_{m}_mean") for s, w in SPLIT_WEIGHTS.items()), F.lit(0.0))

    return out.withColumns({
        "combined_precision": weighted("precision"),
        "combined_recall": weighted("recall"),
        "combined_f1": weighted("f1"),
        "rank_score": weighted("g_mean"),
    })


def combine_splits(df: DataFrame, by: Sequence[str], metrics: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Weighted means over the splits a group has, weights scaled to sum to one."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("dataset_split") == name, F.lit(w)).otherwise(weight)
    rows = df.withColumn("_w", weight).filter(F.col("_w") > 0)
    return rows.groupBy(*by).agg(*[(F.sum(F.col(m) * F.col("_w")) / F.sum("_w")).alias(m) for m in metrics])


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "best") -> DataFrame:
    """The first row per group by (column, descending) pairs, as struct ``name``.

    Numbers sort by sign, the final text key ascending; an aggregate, so the
    groups are reduced before the shuffle.
    """
    key = F.struct(*[(-F.col(c) if desc else F.col(c)).alias(c) for c, desc in order])
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), key).alias(name))


CANDIDATE_ORDER = [("rank_score", True), ("combined_f1", True), ("default_distance", False), ("candidate_id", False)]


def best_candidate(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return best_row(df, by, CANDIDATE_ORDER).select("best.*")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]] = tuple(CANDIDATE_ORDER)) -> DataFrame:
    """Rank of every candidate in its group; a group is a candidate table, not data rows."""
    keys = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def promoted(df: DataFrame, by: Sequence[str], top: int = 2, ratio: float = 0.95) -> DataFrame:
    """The first ``top`` candidates and all within ``ratio`` of the best rank score."""
    usable = df.filter(F.col("rank_score").isNotNull())
    if "status" in df.columns:
        usable = usable.filter(ok_status())
    best = F.max("rank_score").over(Window.partitionBy(*by))
    return ranked(usable, by).withColumn("_best", best).filter(
        (F.col("rank") <= top) | (F.col("rank_score") >= F.col("_best") * ratio)
    ).drop("_best", "rank")


def best_threshold(
    df: DataFrame, by: Sequence[str], target: str, min_precision: float = 0.3
) -> DataFrame:
    """Threshold with the highest target metric, the smallest on ties.

    For recall only thresholds with enough precision compete; a group without
    one falls back to its best F1.
    """
    here = F.struct("threshold", "precision", "recall", "f1", "g_mean")
    ok = F.col("precision") >= min_precision if target == "recall" else F.lit(True)
    key = F.when(ok, F.struct(F.col(target).alias("m"), (-F.col("threshold")).alias("t")))
    spare = F.struct(F.col("f1").alias("m"), (-F.col("threshold")).alias("t"))
    out = df.groupBy(*by).agg(F.max_by(here, key).alias("_a"), F.max_by(here, spare).alias("_b"))
    return out.select(*by, F.coalesce("_a", "_b").alias("_x")).select(*by, "_x.*")


def nearest_to_default(df: DataFrame, by: Sequence[str], default: Column | float) -> DataFrame:
    """The row whose threshold is closest to the default."""
    gap = F.struct(F.abs(F.col("threshold") - default).alias("g"), F.col("threshold").alias("t"))
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), gap).alias("_r")).select("_r.*")


def top_configurations(df: DataFrame, by: Sequence[str], config: str, k: int) -> DataFrame:
    """First ``k`` distinct configurations by the rank of their best row."""
    order = [c for c in CANDIDATE_ORDER]
    firsts = ranked(df, by, order).groupBy(*by, config).agg(F.min("rank").alias("best_rank"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("best_rank"))
    return firsts.withColumn("place", place).filter(F.col("place") <= k)


def winner_counts(
    df: DataFrame, case: Sequence[str], level: Sequence[str], name: str, order: Sequence[tuple[str, bool]]
) -> DataFrame:
    """Cases won by each name per level, zero for names that never won."""
    best = best_row(df, [*level, *case], order).select(*level, F.col(f"best.{name}").alias(name))
    wins = best.groupBy(*level, name).agg(F.count(F.lit(1)).alias("wins"))
    return df.select(*level, name).distinct().join(wins, [*level, name], "left").na.fill(0, ["wins"])


def stability(df: DataFrame, name: str, scope: str, metric: str) -> DataFrame:
    """Spread of a metric over cases, and of its means per scope."""
    overall = df.groupBy(name).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(metric).alias(f"mean_{metric}"),
        F.stddev_samp(metric).alias(f"std_{metric}"), F.min(metric).alias(f"min_{metric}"),
        F.max(metric).alias(f"max_{metric}"),
    )
    means = df.groupBy(name, scope).agg(F.avg(metric).alias("_m"))
    return overall.join(means.groupBy(name).agg(F.stddev_samp("_m").alias("scope_mean_std")), name)


def spearman(df: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation with average ranks for ties, per group of candidates."""

    def average_rank(column: str) -> Column:
        w = Window.partitionBy(*by)
        low = F.rank().over(w.orderBy(column))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
        return low + (ties - 1) / 2

    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    both = pairs.withColumns({"_l": average_rank(left), "_r": average_rank(right)})
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("_l", "_r").alias("spearman"))


def support_aggregate(df: DataFrame, by: Sequence[str], metrics: Sequence[str], level: str = "mh") -> DataFrame:
    """Candidate means over history levels, with the number and list of levels."""
    usable = df.filter(F.col("rank_score").isNotNull())
    if "status" in df.columns:
        usable = usable.filter(ok_status())
    # collect_set holds the history levels of one candidate: a handful of integers.
    return usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("support_count"),
        F.array_join(F.array_sort(F.collect_set(level)).cast("array<string>"), ",").alias("levels"),
        *[F.avg(m).alias(m) for m in metrics],
    )


def subset_regret(df: DataFrame, by: Sequence[str], subset: Sequence[int], equal_support: bool = False,
                  level: str = "mh") -> DataFrame:
    """What the choice made on a subset of levels loses when measured on all of them."""
    metrics = ["rank_score", "combined_f1", "default_distance"]
    keys = [*by, "candidate_id"]
    full = support_aggregate(df, keys, metrics, level)
    part = support_aggregate(df.filter(F.col(level).isin(list(subset))), keys, metrics, level)

    def pick(table: DataFrame, prefix: str) -> DataFrame:
        if equal_support:
            top = table.groupBy(*by).agg(F.max("support_count").alias("_s"))
            table = table.join(top, list(by)).filter(F.col("support_count") == F.col("_s")).drop("_s")
        best = best_row(table, by, CANDIDATE_ORDER)
        return best.select(*by, F.col("best.candidate_id").alias(f"{prefix}_best"),
                           F.col("best.rank_score").alias(f"{prefix}_rank_score"),
                           F.col("best.combined_f1").alias(f"{prefix}_f1"))

    a, b = pick(full, "full"), pick(part, "subset").select(*by, "subset_best")
    on_full = full.select(*by, F.col("candidate_id").alias("subset_best"),
                          F.col("rank_score").alias("_r"), F.col("combined_f1").alias("_f"))
    return a.join(b, list(by)).join(on_full, [*by, "subset_best"]).select(
        *by, "full_best", "subset_best", (F.col("full_best") == F.col("subset_best")).alias("config_match"),
        (F.col("full_rank_score") - F.col("_r")).alias("rank_score_regret"),
        (F.col("full_f1") - F.col("_f")).alias("f1_regret"),
    )


def dominance(df: DataFrame, level: str, family: str, baseline: str) -> DataFrame:
    """Every other family against the baseline family on the same level."""
    base = df.filter(F.col(family) == baseline).select(
        level, *[F.col(c).alias(f"base_{c}") for c in ("g_mean", "f1", "seconds")]
    )
    other = df.filter(F.col(family) != baseline)
    joined = other.join(base, level)
    better_g, better_f1 = F.col("base_g_mean") > F.col("g_mean"), F.col("base_f1") > F.col("f1")
    faster = F.col("base_seconds") < F.col("seconds")
    return joined.select(
        level, F.col(family).alias("challenger"),
        (F.col("base_g_mean") - F.col("g_mean")).alias("g_mean_advantage"),
        (F.col("base_f1") - F.col("f1")).alias("f1_advantage"),
        (F.col("seconds") / F.col("base_seconds")).alias("time_ratio"),
        (better_g & better_f1 & faster).alias("dominates"),
    )
