"""Candidate tables, rankings, summaries and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import OBS, ORDER, SERIES, observations, query, r6, r6_sql, rounded, stored, with_sql
from tidemark.catalog.evaluation import (
    COMB, DS, SCORED, conf_sql, inject_sql, injected_base, long_predictions, observation_table, raw_rates, scored_base,
)
from tidemark.catalog.scoring import fold_sql
from tidemark.operators import history as H
from tidemark.operators import metrics as M
from tidemark.operators import reports as P
from tidemark.operators import sweeps as W
from tidemark.operators.candidates import count_many
from tidemark.plans.preparation import expand_scopes

MH = [5, 25, 30]
KINDS = ["competitor", "country", "global"]
SCORES = {"standard_zscore": "abs_z9", "iqr": "iqr_ratio", "threshold": "abs_change"}
GRID = {f: (c, W.FAMILIES[f][W.single_parameter(f)]["coarse"]) for f, c in SCORES.items()}
KEYS = ["scope_kind", "scope_id", "mh"]


def sweep_rows(spark, d):
    """Scored rows with their product's depth; attempts are the two market segments."""
    wide = H.with_counts(scored_base(spark, d)).withColumns({
        "abs_z9": F.round("abs_z", 9), "attempt": F.col("segment"),
    })
    return wide


def candidate_table(spark, d):
    """Metrics per scope, level, attempt, split and candidate.

    Rows are counted once per shop, country and level band; scopes and levels
    are expanded on those counts.
    """
    def build(s, p):
        rows = sweep_rows(s, p)
        band = F.size(F.filter(F.array(*[F.lit(m) for m in MH]), lambda m: m <= F.col("series_rows")))
        base = ["competitor_id", "country", "segment", "attempt", "dataset_split", "band"]
        hist = M.sweep_histogram(rows.withColumn("band", band), base, GRID)
        levels = F.filter(
            F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("mh")) for i, m in enumerate(MH)]),
            lambda x: x.i < F.col("band"),
        )
        wide = expand_scopes(hist.withColumn("_l", F.explode(levels)).withColumn("mh", F.col("_l.mh")).drop("_l"), KINDS)
        by = [*KEYS, "attempt", "dataset_split"]
        return W.label_candidates(M.sweep_metrics(wide, by, GRID))

    return stored(spark, d, "candidate_metrics", build)


def averaged_table(spark, d):
    keys = [*KEYS, "family", "candidate_id", "threshold", "default_distance"]
    return P.candidate_averages(candidate_table(spark, d), keys, M.METRICS)


def _grid_values() -> str:
    rows = []
    for f, (c, values) in GRID.items():
        s = W.FAMILIES[f][W.single_parameter(f)]
        for v in values:
            rows.append(f"('{f}', {v}::DOUBLE, '{W.candidate_id(f, {W.single_parameter(f): v})}', abs({v}::DOUBLE - {s['default']}::DOUBLE) / ({s['bounds'][1]}::DOUBLE - {s['bounds'][0]}::DOUBLE))")
    return "gr AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(family, threshold, candidate_id, default_distance))"


CM = (*SCORED, _grid_values(), f"""dp AS (SELECT *, round(abs_z, 9) AS abs_z9, count(*) OVER (PARTITION BY product_id) AS series_rows FROM scored),
sr AS (SELECT k AS scope_kind, CASE k WHEN 'competitor' THEN competitor_id WHEN 'country' THEN country ELSE 'global' END AS scope_id, mh, segment AS attempt, dataset_split, truth,
  abs_z9, iqr_ratio, abs_change FROM dp, (SELECT unnest({KINDS!r}) AS k), (SELECT unnest({MH}) AS mh) WHERE series_rows >= mh),
cp AS (SELECT sr.*, gr.*, coalesce(CASE family WHEN 'standard_zscore' THEN abs_z9 WHEN 'iqr' THEN iqr_ratio ELSE abs_change END > threshold, false) AS predicted FROM sr, gr),
cc0 AS (SELECT scope_kind, scope_id, mh, attempt, dataset_split, family, threshold, candidate_id, default_distance, {conf_sql()} FROM cp GROUP BY ALL),
cm AS (SELECT *, {raw_rates()} FROM cc0)""")
_AVG = ", ".join(
    f"coalesce(avg({m}) FILTER (dataset_split = '{s}'), 0) AS {s}_{m}_mean, coalesce(stddev_pop({m}) FILTER (dataset_split = '{s}'), 0) AS {s}_{m}_std"
    for s in M.SPLIT_WEIGHTS for m in M.METRICS)
CA = (*CM, f"""ca0 AS (SELECT scope_kind, scope_id, mh, family, candidate_id, threshold, default_distance, count(DISTINCT attempt) AS attempt_count, {_AVG} FROM cm GROUP BY ALL),
ca AS (SELECT *, 0.7 * new_prices_precision_mean + 0.3 * new_products_precision_mean AS combined_precision, 0.7 * new_prices_recall_mean + 0.3 * new_products_recall_mean AS combined_recall,
  0.7 * new_prices_f1_mean + 0.3 * new_products_f1_mean AS combined_f1, 0.7 * new_prices_g_mean_mean + 0.3 * new_products_g_mean_mean AS rank_score FROM ca0)""")
# Rank scores of equal candidates may differ in the last bit between engines, so ranking reports use nine decimals.
CR = (*CA, """cr9 AS (SELECT * REPLACE (round(rank_score, 9) AS rank_score, round(combined_f1, 9) AS combined_f1, round(default_distance, 9) AS default_distance) FROM ca),
rk AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_id, mh, family ORDER BY rank_score DESC, combined_f1 DESC, default_distance, candidate_id) AS place FROM cr9)""")


def ranking_table(spark, d):
    return averaged_table(spark, d).withColumns({
        c: F.round(c, 9) for c in ("rank_score", "combined_f1", "default_distance")
    })


@query("candidate_metrics", with_sql(*CM, body=f"""SELECT scope_kind, scope_id, mh, attempt, dataset_split, family, candidate_id, threshold, tp, fp, fn, tn,
  {', '.join(r6_sql(m, m) for m in M.METRICS)}, {r6_sql('default_distance', 'default_distance')} FROM cm"""))
def candidate_metrics(spark, d):
    out = rounded(candidate_table(spark, d), *M.METRICS, "default_distance")
    return out.select(*KEYS, "attempt", "dataset_split", "family", "candidate_id", "threshold", "tp", "fp", "fn", "tn",
                      *M.METRICS, "default_distance")


_CA_NAMES = ["combined_precision", "combined_recall", "combined_f1", "rank_score", "new_prices_f1_mean", "new_prices_f1_std",
             "new_products_g_mean_mean", "new_products_g_mean_std"]


@query("candidate_averages", with_sql(*CA, body=f"SELECT scope_kind, scope_id, mh, candidate_id, attempt_count, {', '.join(r6_sql(n, n) for n in _CA_NAMES)} FROM ca"))
def candidate_averages(spark, d):
    return rounded(averaged_table(spark, d), *_CA_NAMES).select(*KEYS, "candidate_id", "attempt_count", *_CA_NAMES)


@query("split_combination", with_sql(*CM, f"""sw0 AS (SELECT *, CASE dataset_split WHEN 'new_prices' THEN 0.7 ELSE 0.3 END AS w FROM cm WHERE scope_id <> 'COUNTRY_2' OR dataset_split = 'new_products')""",
    body=f"""SELECT scope_kind, scope_id, mh, attempt, candidate_id, {r6_sql('sum(w * f1) / sum(w)', 'f1')}, {r6_sql('sum(w * g_mean) / sum(w)', 'g_mean')} FROM sw0 GROUP BY ALL"""))
def split_combination(spark, d):
    """Weights scaled over the splits present: one country lacks its new prices here."""
    rows = candidate_table(spark, d).filter((F.col("scope_id") != "COUNTRY_2") | (F.col("dataset_split") == "new_products"))
    out = P.combine_splits(rows, [*KEYS, "attempt", "candidate_id"], ["f1", "g_mean"], M.SPLIT_WEIGHTS)
    return rounded(out, "f1", "g_mean")


@query("best_candidates", with_sql(*CR, body=f"SELECT scope_kind, scope_id, mh, family, candidate_id, {r6_sql('rank_score', 'rank_score')} FROM rk WHERE place = 1"))
def best_candidates(spark, d):
    out = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    return rounded(out, "rank_score").select(*KEYS, "family", "candidate_id", "rank_score")


@query("promoted_candidates", with_sql(*CR, body="""SELECT scope_kind, scope_id, mh, family, candidate_id FROM
  (SELECT *, max(rank_score) OVER (PARTITION BY scope_kind, scope_id, mh, family) AS top FROM rk) WHERE place <= 2 OR rank_score >= top * 0.95::DOUBLE"""))
def promoted_candidates(spark, d):
    return P.promoted(ranking_table(spark, d), [*KEYS, "family"]).select(*KEYS, "family", "candidate_id")


_BT = (*CM, """b9 AS (SELECT scope_kind, scope_id, mh, attempt, dataset_split, family, threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(g_mean, 9) AS g_mean FROM cm)""")
_BT_KEY = "scope_kind, scope_id, mh, attempt, dataset_split, family"


def _best_threshold(target: str, floor: float) -> None:
    inner = f"""bb AS (SELECT *, row_number() OVER (PARTITION BY {_BT_KEY} ORDER BY CASE WHEN {f'precision >= {floor}' if target == 'recall' else 'true'} THEN 0 ELSE 1 END,
  CASE WHEN {f'precision >= {floor}' if target == 'recall' else 'true'} THEN {target} ELSE f1 END DESC, threshold) AS place FROM b9)"""

    @query(f"best_threshold_by_{target}", with_sql(*_BT, inner, body=f"SELECT {_BT_KEY}, threshold, {r6_sql('f1', 'f1')}, {r6_sql('recall', 'recall')} FROM bb WHERE place = 1"))
    def run(spark, d):
        table = candidate_table(spark, d).withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1", "g_mean")})
        by = [*KEYS, "attempt", "dataset_split", "family"]
        return rounded(P.best_threshold(table, by, target, floor), "f1", "recall").select(*by, "threshold", "f1", "recall")


for _target, _floor in (("f1", 0.3), ("recall", 0.3), ("g_mean", 0.3)):
    _best_threshold(_target, _floor)


@query("top_configurations", with_sql(*CR, """tf AS (SELECT scope_kind, scope_id, mh, family, min(place2) AS best_rank FROM (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_id, mh
  ORDER BY rank_score DESC, combined_f1 DESC, default_distance, candidate_id) AS place2 FROM rk) GROUP BY ALL)""",
    body="""SELECT scope_kind, scope_id, mh, family, best_rank, place FROM (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_id, mh ORDER BY best_rank) AS place FROM tf) WHERE place <= 2"""))
def top_configurations(spark, d):
    """First two distinct families by the rank of their best candidate."""
    out = P.top_configurations(ranking_table(spark, d), KEYS, "family", 2)
    return out.withColumns({c: F.col(c).cast("long") for c in ("best_rank", "place")})


@query("nearest_to_default", with_sql(*CA, body=f"""SELECT scope_kind, scope_id, mh, family, threshold, {r6_sql('rank_score', 'rank_score')} FROM ca WHERE
  threshold = CASE family WHEN 'standard_zscore' THEN 3.0 WHEN 'iqr' THEN 1.5 ELSE 0.2 END"""))
def nearest_to_default(spark, d):
    default = F.when(F.col("family") == "standard_zscore", 3.1).when(F.col("family") == "iqr", 1.6).otherwise(0.21)
    out = P.nearest_to_default(averaged_table(spark, d), [*KEYS, "family"], default)
    return rounded(out, "rank_score").select(*KEYS, "family", "threshold", "rank_score")


@query("best_level_per_granularity", with_sql(*CR, """gm AS (SELECT scope_kind, mh, round(avg(combined_f1), 9) AS f1, round(avg(rank_score), 9) AS g FROM rk WHERE place = 1 GROUP BY ALL)""",
    body=f"""SELECT scope_kind, max(f1) FILTER (pf = 1) IS NOT NULL AS found, min(mh) FILTER (pf = 1) AS best_f1_mh, min(mh) FILTER (pg = 1) AS best_g_mh, {r6_sql('max(f1)', 'best_f1')}, {r6_sql('avg(f1)', 'mean_f1')}
  FROM (SELECT *, row_number() OVER (PARTITION BY scope_kind ORDER BY f1 DESC, mh) AS pf, row_number() OVER (PARTITION BY scope_kind ORDER BY g DESC, mh) AS pg FROM gm) GROUP BY scope_kind"""))
def best_level_per_granularity(spark, d):
    """Means per level, the best F1 and best G rows, and their join (three-way)."""
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    means = best.groupBy("scope_kind", "mh").agg(F.round(F.avg("combined_f1"), 9).alias("f1"), F.round(F.avg("rank_score"), 9).alias("g"))
    by_f1 = P.best_row(means, ["scope_kind"], [("f1", True), ("mh", False)]).select("scope_kind", F.col("best.mh").alias("best_f1_mh"), F.col("best.f1").alias("best_f1"))
    by_g = P.best_row(means, ["scope_kind"], [("g", True), ("mh", False)]).select("scope_kind", F.col("best.mh").alias("best_g_mh"))
    overall = means.groupBy("scope_kind").agg(F.avg("f1").alias("mean_f1"))
    out = by_f1.join(by_g, "scope_kind").join(overall, "scope_kind").withColumn("found", F.col("best_f1").isNotNull())
    return rounded(out, "best_f1", "mean_f1")


@query("scope_level_summary", with_sql(*CR, body=f"""SELECT scope_kind, mh, count(DISTINCT scope_id) AS scope_count, {r6_sql('avg(combined_f1)', 'mean_f1')}, {r6_sql('avg(rank_score)', 'mean_g')},
  {r6_sql('median(combined_f1)', 'median_f1')}, {r6_sql('min(combined_f1)', 'min_f1')}, {r6_sql('max(combined_f1)', 'max_f1')} FROM rk WHERE place = 1 GROUP BY scope_kind, mh"""))
def scope_level_summary(spark, d):
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    out = best.groupBy("scope_kind", "mh").agg(
        F.count_distinct("scope_id").alias("scope_count"), F.avg("combined_f1").alias("mean_f1"), F.avg("rank_score").alias("mean_g"),
        F.median("combined_f1").alias("median_f1"), F.min("combined_f1").alias("min_f1"), F.max("combined_f1").alias("max_f1"),
    )
    return rounded(out, "mean_f1", "mean_g", "median_f1", "min_f1", "max_f1")


@query("scope_weighted_means", with_sql(*CR, "ws AS (SELECT scope_kind, family, count(DISTINCT scope_id) AS n, avg(combined_f1) AS f FROM rk WHERE place = 1 GROUP BY ALL)",
    body=f"SELECT family, CAST(sum(n) AS BIGINT) AS scopes, {r6_sql('sum(f * n) / sum(n)', 'weighted_f1')} FROM ws GROUP BY family"))
def scope_weighted_means(spark, d):
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    per = best.groupBy("scope_kind", "family").agg(F.count_distinct("scope_id").alias("n"), F.avg("combined_f1").alias("f"))
    return per.groupBy("family").agg(F.sum("n").alias("scopes"), r6(F.sum(F.col("f") * F.col("n")) / F.sum("n"), "weighted_f1"))


@query("layered_summaries", with_sql(*CR, body=f"""SELECT family, coalesce(CAST(mh AS VARCHAR), 'all') AS level, count(*) AS cases, count(DISTINCT scope_id) AS scopes, {r6_sql('avg(combined_precision)', 'precision')},
  {r6_sql('avg(combined_recall)', 'recall')}, {r6_sql('avg(combined_f1)', 'f1')}, {r6_sql('avg(rank_score)', 'g_mean')} FROM rk WHERE place = 1 GROUP BY ROLLUP (family, mh) HAVING family IS NOT NULL"""))
def layered_summaries(spark, d):
    """Overall and per level by one rollup."""
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    out = best.rollup("family", "mh").agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("scope_id").alias("scopes"), r6(F.avg("combined_precision"), "precision"),
        r6(F.avg("combined_recall"), "recall"), r6(F.avg("combined_f1"), "f1"), r6(F.avg("rank_score"), "g_mean"),
    )
    return out.filter("family IS NOT NULL").withColumn("level", F.coalesce(F.col("mh").cast("string"), F.lit("all"))).drop("mh")


@query("recall_stability", with_sql(*CR, "w1 AS (SELECT * FROM rk WHERE place = 1), sm AS (SELECT family, stddev_samp(m) AS s FROM (SELECT family, scope_id, avg(combined_recall) AS m FROM w1 GROUP BY ALL) GROUP BY family)",
    body=f"""SELECT family, count(*) AS cases, {r6_sql('avg(combined_recall)', 'mean_recall')}, {r6_sql('stddev_samp(combined_recall)', 'std_recall')}, {r6_sql('min(combined_recall)', 'min_recall')},
  {r6_sql('max(combined_recall)', 'max_recall')}, {r6_sql('max(s)', 'scope_mean_std')} FROM w1 JOIN sm USING (family) GROUP BY family"""))
def recall_stability(spark, d):
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"]).withColumn("recall", F.col("combined_recall"))
    return rounded(P.stability(best, "family", "scope_id", "recall"), "mean_recall", "std_recall", "min_recall", "max_recall", "scope_mean_std")


def _winners(metric: str, second: str | None) -> None:
    tie = f", {second} DESC" if second else ""
    order = [(metric, True)] + ([(second, True)] if second else []) + [("family", False)]

    @query(f"winner_counts_{metric}", with_sql(*CR, f"""wb AS (SELECT * REPLACE (round({metric}, 9) AS {metric}) FROM rk WHERE place = 1),
wp AS (SELECT *, row_number() OVER (PARTITION BY mh, scope_kind, scope_id ORDER BY {metric} DESC{tie}, family) AS p FROM wb)""",
        body="SELECT mh, family, count(*) FILTER (p = 1) AS wins FROM wp GROUP BY mh, family"))
    def run(spark, d):
        best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"]).withColumn(metric, F.round(metric, 9))
        return P.winner_counts(best, ["scope_kind", "scope_id"], ["mh"], "family", order)


_winners("combined_f1", None)
_winners("rank_score", None)
_winners("combined_recall", "combined_precision")


@query("type_summary_of_chosen", with_sql(*SCORED, """tw AS (SELECT detector, anomaly_type, dataset_split, count(*) AS n, count(*) FILTER (predicted) AS hit FROM preds
  WHERE anomaly_type IN ('price_spike', 'decimal_shift') AND detector IN ('zscore', 'iqr') GROUP BY ALL)""",
    body=f"SELECT anomaly_type, detector, {r6_sql('avg(hit / n)', 'mean_recall')} FROM tw GROUP BY anomaly_type, detector"))
def type_summary_of_chosen(spark, d):
    preds = long_predictions(scored_base(spark, d), ["dataset_split", "anomaly_type"]).filter(
        F.col("anomaly_type").isin("price_spike", "decimal_shift") & F.col("detector").isin("zscore", "iqr"))
    rates = M.rate_by_type(preds, ["dataset_split", "detector"])
    return rates.groupBy("anomaly_type", "detector").agg(r6(F.avg("detection_rate"), "mean_recall"))


# ------------------------------------------------------------------ profiles

PC = "pc AS (SELECT product_id, competitor_id, count(*) AS c FROM obs GROUP BY ALL)"


@query("history_profile", with_sql(OBS, PC, body=f"""SELECT count(*) AS n_series, {r6_sql('avg(c)', 'mean_rows')}, {r6_sql('median(c)', 'median_rows')}, {r6_sql('quantile_cont(c, 0.25)', 'p25')},
  {r6_sql('quantile_cont(c, 0.75)', 'p75')}, min(c) AS min_rows, max(c) AS max_rows, {r6_sql('stddev_samp(c)', 'std_rows')},
  {r6_sql('(SELECT avg(power(c - m, 3)) / power(max(s), 3) FROM pc, (SELECT avg(c) AS m, stddev_samp(c) AS s FROM pc))', 'skewness')} FROM pc"""))
def history_profile(spark, d):
    from tidemark.operators.profiles import history_profile as profile

    names = ["mean_rows", "median_rows", "p25", "p75", "std_rows", "skewness"]
    return rounded(profile(observation_table(spark, d), SERIES), *names)


@query("history_buckets", with_sql(OBS, PC, body="""SELECT CASE WHEN c <= 5 THEN '1-4' WHEN c <= 10 THEN '5-9' WHEN c <= 20 THEN '10-19' WHEN c <= 50 THEN '20-49' WHEN c <= 100 THEN '50-99' ELSE '100+' END AS bucket,
  count(*) AS n_series FROM pc GROUP BY 1"""))
def history_buckets(spark, d):
    from tidemark.operators.profiles import history_buckets as buckets

    return buckets(observation_table(spark, d), SERIES)


@query("split_diagnostics", with_sql(OBS, f"""v AS (SELECT *, count(*) OVER (PARTITION BY product_id, competitor_id) AS c, row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY seen_at DESC, obs_id DESC) AS b,
  lag(price) OVER (PARTITION BY product_id, competitor_id ORDER BY seen_at, obs_id) AS prev, row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY seen_at, obs_id) AS f FROM obs WHERE price IS NOT NULL),
g AS (SELECT product_id, competitor_id, max(c) AS c, date_diff('day', min(seen_at) FILTER (b <= 2), max(seen_at)) AS span, count(DISTINCT price) FILTER (b <= 3) AS recent FROM v GROUP BY ALL)""",
    body=f"""SELECT {r6_sql('sum(greatest(c - 2, 0)) FILTER (c >= 5) / sum(c) FILTER (c >= 5)', 'train_share')}, {r6_sql('sum(least(c, 2)) FILTER (c >= 5) / sum(c) FILTER (c >= 5)', 'test_share')},
  {r6_sql('avg(span) FILTER (c >= 5)', 'mean_span_days')}, {r6_sql('avg(CASE WHEN span < 28 THEN 1.0 ELSE 0 END) FILTER (c >= 5)', 'span_under_4_weeks')},
  {r6_sql('(SELECT avg(CASE WHEN price <> prev THEN 1.0 ELSE 0 END) FROM v WHERE f > 1)', 'change_rate')},
  {r6_sql('avg(CASE WHEN c >= 3 AND recent > 1 THEN 1.0 ELSE 0 END)', 'recent_change_share')} FROM g"""))
def split_diagnostics(spark, d):
    from tidemark.operators.profiles import split_diagnostics as diagnostics

    obs = observation_table(spark, d).filter("price IS NOT NULL")
    out = diagnostics(obs, SERIES, ORDER, minimum=5, last_n=2)
    return rounded(out, *out.columns)


@query("exclusion_profile", with_sql(OBS, PC, body=f"""SELECT mh, count(*) FILTER (c < mh) AS excluded, {r6_sql('count(*) FILTER (c < mh) * 100 / count(*)', 'excluded_pct')},
  CAST(coalesce(sum(c) FILTER (c >= mh), 0) AS BIGINT) AS kept_rows FROM pc, (SELECT unnest([3, 4, 5, 6, 7, 10]) AS mh) GROUP BY mh"""))
def exclusion_profile(spark, d):
    from tidemark.operators.profiles import exclusion_levels

    return rounded(exclusion_levels(observation_table(spark, d), SERIES, [3, 4, 5, 6, 7, 10]), "excluded_pct")


@query("excluded_series_by_competitor", with_sql(OBS, f"""xs AS (SELECT product_id, competitor_id, count(*) AS c, min(seen_at) AS first_seen, stddev_samp(price) / avg(price) AS cv FROM obs GROUP BY ALL)""",
    body=f"""SELECT competitor_id, count(*) FILTER (c < 5) AS excluded, count(*) AS total, {r6_sql('count(*) FILTER (c < 5) * 100 / count(*)', 'excluded_pct')},
  coalesce(date_diff('day', DATE '1990-01-01', CAST(to_timestamp(median(epoch(first_seen)) FILTER (c < 5)) AS DATE)), -1) AS excluded_first_day,
  {r6_sql('median(cv) FILTER (c < 5)', 'excluded_median_cv')}, {r6_sql('median(cv) FILTER (c >= 5)', 'included_median_cv')} FROM xs GROUP BY competitor_id"""))
def excluded_series_by_competitor(spark, d):
    from tidemark.operators.profiles import excluded_series

    out = excluded_series(observation_table(spark, d), SERIES, "competitor_id", 5)
    return rounded(out, "excluded_pct", "excluded_median_cv", "included_median_cv")


@query("detection_by_type_with_total", with_sql(*SCORED, """tt AS (SELECT product_id, anomaly_type, detector, bool_or(predicted) AS hit FROM preds WHERE truth GROUP BY ALL),
ta AS (SELECT product_id, anomaly_type, bool_or(hit) AS hit FROM tt GROUP BY ALL), tp0 AS (SELECT product_id, detector, bool_or(hit) AS hit FROM tt GROUP BY ALL), tpa AS (SELECT product_id, bool_or(hit) AS hit FROM ta GROUP BY ALL)""",
    body=f"""SELECT anomaly_type, detector, count(*) AS n_products, {r6_sql('count(*) FILTER (hit) * 100 / count(*)', 'rate')} FROM (
  SELECT * FROM tt UNION ALL SELECT product_id, anomaly_type, 'any', hit FROM ta UNION ALL SELECT product_id, 'TOTAL', detector, hit FROM tp0 UNION ALL SELECT product_id, 'TOTAL', 'any', hit FROM tpa) GROUP BY anomaly_type, detector"""))
def detection_by_type_with_total(spark, d):
    from tidemark.operators.profiles import detection_by_type

    preds = long_predictions(scored_base(spark, d), ["product_id", "anomaly_type", "truth"])
    return rounded(detection_by_type(preds, "product_id"), "rate")


@query("comparison_means", with_sql(*SCORED, f"cd AS (SELECT competitor_id, dataset_split, detector, {conf_sql()} FROM preds GROUP BY ALL), ce AS (SELECT *, {raw_rates()} FROM cd)",
    body=f"SELECT detector, count(*) AS datasets, {r6_sql('avg(f1)', 'mean_f1')}, {r6_sql('avg(precision)', 'mean_precision')}, {r6_sql('avg(recall)', 'mean_recall')} FROM ce WHERE f1 > 0 GROUP BY detector"))
def comparison_means(spark, d):
    preds = long_predictions(scored_base(spark, d), ["competitor_id", "dataset_split", "truth"])
    per = M.detector_metrics(preds, ["competitor_id", "dataset_split", "detector"]).filter("f1 > 0")
    return per.groupBy("detector").agg(F.count(F.lit(1)).alias("datasets"), r6(F.avg("f1"), "mean_f1"),
                                       r6(F.avg("precision"), "mean_precision"), r6(F.avg("recall"), "mean_recall"))


@query("pooled_dataset_metrics", with_sql(*SCORED, f"pl AS (SELECT competitor_id, dataset_split, detector, predicted AND NOT (detector = 'iqr' AND competitor_id = 'SHOP_XX') AS predicted, truth FROM preds), pm AS (SELECT dataset_split, detector, {conf_sql()} FROM pl GROUP BY ALL)",
    body=f"SELECT dataset_split, detector, tp, fp, fn, tn, {r6_sql(raw_rates('f1').split(' AS ')[0], 'f1')} FROM pm"))
def pooled_dataset_metrics(spark, d):
    """Datasets pooled before scoring; a detector missing in one counts as all clear there."""
    wide = scored_base(spark, d)
    preds = long_predictions(wide, ["obs_id", "competitor_id", "dataset_split"]).filter(
        ~((F.col("detector") == "iqr") & (F.col("competitor_id") == "SHOP_XX")))
    names = preds.select("detector").distinct()
    # Every row meets every detector name: four names, then a many-to-one join.
    rows = wide.select("obs_id", "dataset_split", "truth").join(F.broadcast(names))
    joined = M.join_truth(preds.select("obs_id", "detector", "predicted"), rows, ["obs_id", "detector"], "right")
    out = M.with_rates(joined.groupBy("dataset_split", "detector").agg(*M.confusion()))
    return rounded(out, "f1").select("dataset_split", "detector", "tp", "fp", "fn", "tn", "f1")


@query("split_summary", with_sql(*SCORED, COMB, body=f"""SELECT dataset_split, max_by(detector, f1) AS best_detector, {r6_sql('max(f1)', 'best_f1')}, count(*) AS n_metric_rows,
  max(tp + fp + fn + tn) AS total_rows, max(tp + fn) AS total_injected FROM cr GROUP BY dataset_split"""))
def split_summary(spark, d):
    preds = M.add_combined(long_predictions(scored_base(spark, d), ["dataset_split", "truth"]))
    metrics = M.detector_metrics(preds, ["dataset_split", "detector"])
    scopes = metrics.select("dataset_split", "n_rows", "n_injected").dropDuplicates(["dataset_split"])
    best = metrics.groupBy("dataset_split").agg(F.max_by("detector", "f1").alias("best_detector"), r6(F.max("f1"), "best_f1"),
                                                F.count(F.lit(1)).alias("n_metric_rows"))
    return best.join(scopes, "dataset_split").withColumnsRenamed({"n_rows": "total_rows", "n_injected": "total_injected"})


# ---------------------------------------------------- support, regret, trends

SUP = (*CA, """sp9 AS (SELECT scope_kind, scope_id, family, candidate_id, count(*) AS support_count, array_to_string(list_sort(list(DISTINCT mh)), ',') AS levels, avg(rank_score) AS rank_score,
  avg(combined_f1) AS combined_f1, avg(default_distance) AS default_distance FROM ca GROUP BY ALL)""")


@query("candidate_support", with_sql(*SUP, body=f"SELECT scope_kind, scope_id, candidate_id, support_count, levels, {r6_sql('rank_score', 'rank_score')}, {r6_sql('combined_f1', 'combined_f1')} FROM sp9"))
def candidate_support(spark, d):
    keys = ["scope_kind", "scope_id", "family", "candidate_id"]
    out = P.support_aggregate(averaged_table(spark, d), keys, ["rank_score", "combined_f1", "default_distance"])
    return rounded(out, "rank_score", "combined_f1").select("scope_kind", "scope_id", "candidate_id", "support_count", "levels", "rank_score", "combined_f1")


def _regret_sql(equal: bool) -> str:
    pick = lambda t: (f"(SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_id, family ORDER BY rank_score DESC, combined_f1 DESC, default_distance, candidate_id) AS p FROM "
                      f"(SELECT *, max(support_count) OVER (PARTITION BY scope_kind, scope_id, family) AS ms FROM {t}) {'WHERE support_count = ms' if equal else ''})")
    agg = "count(*) AS support_count, round(avg(rank_score), 9) AS rank_score, round(avg(combined_f1), 9) AS combined_f1, round(avg(default_distance), 9) AS default_distance"
    return with_sql(*CR, f"""fu AS (SELECT scope_kind, scope_id, family, candidate_id, {agg} FROM cr9 GROUP BY ALL),
su AS (SELECT scope_kind, scope_id, family, candidate_id, {agg} FROM cr9 WHERE mh IN (5, 30) GROUP BY ALL),
fb AS (SELECT * FROM {pick('fu')} WHERE p = 1), sb AS (SELECT * FROM {pick('su')} WHERE p = 1)""",
        body=f"""SELECT scope_kind, scope_id, family, fb.candidate_id AS full_best, sb.candidate_id AS subset_best, fb.candidate_id = sb.candidate_id AS config_match,
  {r6_sql('fb.rank_score - fu.rank_score', 'rank_score_regret')}, {r6_sql('fb.combined_f1 - fu.combined_f1', 'f1_regret')} FROM fb JOIN sb USING (scope_kind, scope_id, family)
  JOIN fu ON fu.scope_kind = fb.scope_kind AND fu.scope_id = fb.scope_id AND fu.family = fb.family AND fu.candidate_id = sb.candidate_id""")


CASE = ["scope_kind", "scope_id", "family"]


def regret_rows(spark, d, equal: bool):
    return P.subset_regret(ranking_table(spark, d), CASE, [5, 30], equal)


@query("subset_regret", _regret_sql(False))
def subset_regret(spark, d):
    return rounded(regret_rows(spark, d, False), "rank_score_regret", "f1_regret")


@query("subset_regret_equal_support", _regret_sql(True))
def subset_regret_equal_support(spark, d):
    return rounded(regret_rows(spark, d, True), "rank_score_regret", "f1_regret")


SPEAR = (*CR, """f1r AS (SELECT scope_kind, scope_id, family, candidate_id, round(avg(rank_score), 8) AS a FROM cr9 GROUP BY ALL),
s1r AS (SELECT scope_kind, scope_id, family, candidate_id, round(avg(rank_score), 8) AS b FROM cr9 WHERE mh IN (5, 30) GROUP BY ALL),
pr2 AS (SELECT *, rank() OVER (PARTITION BY scope_kind, scope_id, family ORDER BY a) + (count(*) OVER (PARTITION BY scope_kind, scope_id, family, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY scope_kind, scope_id, family ORDER BY b) + (count(*) OVER (PARTITION BY scope_kind, scope_id, family, b) - 1) / 2.0 AS rb FROM f1r JOIN s1r USING (scope_kind, scope_id, family, candidate_id)),
spc AS (SELECT scope_kind, scope_id, family, count(*) AS n_pairs, corr(ra, rb) AS spearman FROM pr2 GROUP BY ALL)""")


def spearman_rows(spark, d):
    keys = [*CASE, "candidate_id"]
    table = ranking_table(spark, d)
    full = table.groupBy(*keys).agg(F.round(F.avg("rank_score"), 8).alias("a"))
    part = table.filter(F.col("mh").isin(5, 30)).groupBy(*keys).agg(F.round(F.avg("rank_score"), 8).alias("b"))
    return P.spearman(full.join(part, keys), CASE, "a", "b")


@query("ranking_agreement", with_sql(*SPEAR, body=f"SELECT scope_kind, scope_id, family, n_pairs, {r6_sql('spearman', 'spearman')} FROM spc"))
def ranking_agreement(spark, d):
    return rounded(spearman_rows(spark, d), "spearman")


@query("subsampling_adequacy", with_sql(*SPEAR, body=f"""SELECT coalesce(scope_kind, 'all') AS granularity, count(*) AS cases, {r6_sql('avg(spearman)', 'mean_spearman')}, {r6_sql('median(spearman)', 'median_spearman')},
  count(*) FILTER (spearman < 0.999) AS imperfect FROM spc GROUP BY ROLLUP (scope_kind)"""))
def subsampling_adequacy(spark, d):
    out = spearman_rows(spark, d).rollup("scope_kind").agg(
        F.count(F.lit(1)).alias("cases"), r6(F.avg("spearman"), "mean_spearman"), r6(F.median("spearman"), "median_spearman"),
        F.count_if(F.col("spearman") < 0.999).alias("imperfect"))
    return out.withColumn("granularity", F.coalesce("scope_kind", F.lit("all"))).drop("scope_kind")


@query("best_configuration_distribution", with_sql(*CR, body="SELECT family, mh, candidate_id, count(*) AS case_count FROM rk WHERE place = 1 GROUP BY ALL"))
def best_configuration_distribution(spark, d):
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    return best.groupBy("family", "mh", "candidate_id").agg(F.count(F.lit(1)).alias("case_count"))


@query("threshold_trends", with_sql(*CR, body=f"""SELECT family, threshold, {r6_sql('avg(combined_f1)', 'mean_f1')}, {r6_sql('median(combined_f1)', 'median_f1')}, {r6_sql('avg(rank_score)', 'mean_g')},
  {r6_sql('median(rank_score)', 'median_g')}, {r6_sql('count(*) FILTER (place = 1) / count(*)', 'winner_share')} FROM rk GROUP BY family, threshold"""))
def threshold_trends(spark, d):
    table = P.ranked(ranking_table(spark, d), [*KEYS, "family"])
    return table.groupBy("family", "threshold").agg(
        r6(F.avg("combined_f1"), "mean_f1"), r6(F.median("combined_f1"), "median_f1"), r6(F.avg("rank_score"), "mean_g"),
        r6(F.median("rank_score"), "median_g"), r6(F.count_if(F.col("rank") == 1) / F.count(F.lit(1)), "winner_share"))


@query("boundary_shares", with_sql(*CR, body=f"""SELECT scope_kind, {r6_sql('count(*) FILTER (place = 1 AND threshold = 3.0) / count(*) FILTER (place = 1)', 'share_at_3')},
  {r6_sql('avg(combined_f1) FILTER (threshold = 2.0)', 'f1_at_2')}, {r6_sql('avg(combined_f1) FILTER (threshold = 3.0)', 'f1_at_3')} FROM rk WHERE family = 'standard_zscore' GROUP BY scope_kind"""))
def boundary_shares(spark, d):
    table = P.ranked(ranking_table(spark, d), [*KEYS, "family"]).filter("family = 'standard_zscore'")
    won, at = F.col("rank") == 1, lambda t: F.avg(F.when(F.col("threshold") == t, F.col("combined_f1")))
    return table.groupBy("scope_kind").agg(r6(F.count_if(won & (F.col("threshold") == 3.0)) / F.count_if(won), "share_at_3"),
                                           r6(at(2.0), "f1_at_2"), r6(at(3.0), "f1_at_3"))


@query("optimal_threshold_by_level", with_sql(*CR, body=f"SELECT family, mh, split_part(scope_id, '_', 1) AS scope_prefix, {r6_sql('avg(threshold)', 'mean_threshold')}, count(*) AS n FROM rk WHERE place = 1 GROUP BY ALL"))
def optimal_threshold_by_level(spark, d):
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    return best.groupBy("family", "mh", F.split("scope_id", "_")[0].alias("scope_prefix")).agg(
        r6(F.avg("threshold"), "mean_threshold"), F.count(F.lit(1)).alias("n"))


@query("family_dominance", with_sql(*CR, """fm AS (SELECT scope_kind, family, avg(rank_score) AS g, avg(combined_f1) AS f, avg(threshold) AS s FROM rk WHERE place = 1 GROUP BY ALL)""",
    body=f"""SELECT a.scope_kind, a.family AS challenger, {r6_sql('b.g - a.g', 'g_mean_advantage')}, {r6_sql('b.f - a.f', 'f1_advantage')}, {r6_sql('a.s / b.s', 'time_ratio')},
  b.g > a.g AND b.f > a.f AND b.s < a.s AS dominates FROM fm a JOIN fm b ON a.scope_kind = b.scope_kind AND b.family = 'iqr' AND a.family <> 'iqr'"""))
def family_dominance(spark, d):
    """Other families against a baseline family; the mean threshold stands in for the time column."""
    best = P.best_candidate(ranking_table(spark, d), [*KEYS, "family"])
    means = best.groupBy("scope_kind", "family").agg(F.avg("rank_score").alias("g_mean"), F.avg("combined_f1").alias("f1"), F.avg("threshold").alias("seconds"))
    return rounded(P.dominance(means, "scope_kind", "family", "iqr"), "g_mean_advantage", "f1_advantage", "time_ratio")


@query("staged_sweep")
def staged_sweep(spark, d):
    rows = sweep_rows(spark, d)
    out = W.staged_sweep(rows, ["competitor_id"], SCORES, first_attempt="B2B")
    return rounded(out, "rank_score", "combined_f1").select("competitor_id", "family", "candidate_id", "threshold", "stage", "rank_score", "combined_f1")


def attempt_rows(spark, d):
    """Injected rows of both splits; attempts are the two market segments."""
    return injected_base(spark, d).withColumns({"attempt": F.col("segment"), "truth": F.col("is_injected")})


@query("refitted_sweep")
def refitted_sweep(spark, d):
    """All eight families, coarse and refined, every candidate on baselines of its own; by competitor."""
    out = W.refitted_sweep(attempt_rows(spark, d), SERIES, ORDER, ["competitor_id"], first_attempt="B2B")
    return rounded(out, "rank_score", "combined_f1").select(
        "competitor_id", "family", "candidate_id", "params", "stage", "rank_score", "combined_f1", "status", "message", "best")


# Between the grid's values, at which many rows sit exactly.
_REFITTED = {W.candidate_id("standard_zscore", {"threshold": t}): t for t in (1.87, 2.37, 2.9, 3.41, 4.13)}


@query("refitted_zscore_counts", with_sql(OBS, DS, inject_sql("ds", "dataset_split"), fold_sql(
    "product_id, competitor_id, segment, dataset_split, cand", "obs_id", f"""SELECT inj.*, cand, t FROM inj,
      (SELECT unnest({list(_REFITTED.values())}::DOUBLE[]) AS t, unnest({list(_REFITTED)}) AS cand)""", "n >= 3 AND abs(z) > t", "0.0", "NULL"),
    body="""SELECT dataset_split, cand AS candidate_id, count(*) FILTER (flagged AND anomaly_type IS NOT NULL) AS tp,
  count(*) FILTER (flagged AND anomaly_type IS NULL) AS fp, count(*) FILTER (NOT flagged AND anomaly_type IS NOT NULL) AS fn,
  count(*) FILTER (NOT flagged AND anomaly_type IS NULL) AS tn FROM walk JOIN (SELECT obs_id, anomaly_type FROM inj) i ON ident = i.obs_id
  WHERE rn > 0 GROUP BY ALL""", recursive=True))
def refitted_zscore_counts(spark, d):
    """Confusion counts of the z-score candidates, one pass, a baseline for each."""
    rules = {i: W.rule_of("standard_zscore", {"threshold": t}) for i, t in _REFITTED.items()}
    out = count_many(attempt_rows(spark, d), [*SERIES, "segment", "dataset_split"], ORDER, rules, ["dataset_split"])
    return out.select("dataset_split", "candidate_id", "tp", "fp", "fn", "tn")


@query("tuning_sweep_round_trip", with_sql(*CR, body="SELECT scope_kind, scope_id, mh, family, candidate_id FROM rk WHERE place = 1"))
def tuning_sweep_round_trip(spark, d):
    from tidemark.session import scratch_path
    from tidemark.sources import artifacts as A

    table = ranking_table(spark, d)
    best = P.best_candidate(table, [*KEYS, "family"])
    paths = A.write_tuning_sweep(scratch_path(spark, "sweep"), table, best, {"sweep_id": "s1"})
    return spark.read.json(paths["best_candidate"]).select("scope_kind", "scope_id", F.col("mh").cast("int").alias("mh"), "family", "candidate_id")
