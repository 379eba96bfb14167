"""Run health, drift, content drift and run trackers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import OBS, query, r6_sql, rounded, stored, table, with_sql
from tidemark.catalog.intake import PARSED, raw_lines
from tidemark.operators import features as X
from tidemark.operators import quality as Q
from tidemark.sources import scrapes as J

RM = """rm AS (SELECT run_id, count(*) AS total_records, count(*) FILTER (error_type IS NULL) AS parsed_records,
  count(*) FILTER (error_type IS NOT NULL) AS parse_error_count,
  count(*) FILTER (error_type IS NULL AND NOT coalesce(price > 0, false)) AS missing_price_count,
  count(*) FILTER (error_type IS NULL AND product_name IS NULL) AS missing_title_count,
  count(*) FILTER (error_type IS NULL AND images IS NULL) AS missing_image_count,
  count(*) FILTER (error_type IS NULL AND ean IS NULL) AS missing_ean_count,
  count(DISTINCT product_id) FILTER (error_type IS NULL) AS unique_products,
  avg(price) FILTER (error_type IS NULL AND price > 0) AS price_mean, stddev_samp(price) FILTER (error_type IS NULL AND price > 0) AS price_std,
  min(price) FILTER (error_type IS NULL AND price > 0) AS price_min, max(price) FILTER (error_type IS NULL AND price > 0) AS price_max,
  median(price) FILTER (error_type IS NULL AND price > 0) AS price_median FROM parsed GROUP BY run_id),
rr AS (SELECT *, parse_error_count / total_records AS parse_error_rate, """ + ", ".join(
    f"coalesce(missing_{n}_count / nullif(parsed_records, 0), 0) AS missing_{n}_rate" for n in ("price", "title", "image", "ean")
) + """, left(run_id, 7) AS shop FROM rm)"""
EXPECT = """ex AS (SELECT shop, floor(avg(parsed_records)) AS expected_rows, avg(price_mean) AS history_mean, avg(price_std) AS history_std FROM rr GROUP BY shop),
dr0 AS (SELECT rr.*, (parsed_records - expected_rows) / expected_rows AS row_count_drift, abs(price_mean - history_mean) / history_std AS price_drift FROM rr JOIN ex USING (shop)),
dr AS (SELECT *, least(abs(row_count_drift) / 0.5, 1) AS row_count_severity, CASE WHEN price_drift >= 3 THEN 1 ELSE price_drift / 3 END AS price_drift_severity FROM dr0)"""
_COUNTS = ["total_records", "parsed_records", "parse_error_count", "missing_price_count", "missing_title_count",
           "missing_image_count", "missing_ean_count", "unique_products"]
_STATS = ["parse_error_rate", "missing_price_rate", "missing_title_rate", "missing_image_rate", "missing_ean_rate",
          "price_mean", "price_std", "price_min", "price_max", "price_median"]


def metrics_by_run(spark, d):
    parsed = stored(spark, d, "parsed_scrapes", lambda s, p: J.parse_scrapes(raw_lines(s, p)).drop("raw_data"))
    return Q.run_metrics(parsed, ["run_id"])


def drifted_runs(spark, d):
    metrics = metrics_by_run(spark, d).withColumn("shop", F.substring("run_id", 1, 7))
    expected = metrics.groupBy("shop").agg(
        F.floor(F.avg("parsed_records")).alias("expected_rows"), F.avg("price_mean").alias("history_mean"),
        F.avg("price_std").alias("history_std"),
    )
    return Q.run_drift(metrics, expected, ["shop"])


@query("run_metrics", with_sql(OBS, PARSED, RM, body=f"SELECT run_id, {', '.join(_COUNTS)}, {', '.join(r6_sql(s, s) for s in _STATS)} FROM rr"))
def run_metrics(spark, d):
    return rounded(metrics_by_run(spark, d), *_STATS).select("run_id", *_COUNTS, *_STATS)


_DRIFT = ["row_count_drift", "row_count_severity", "price_drift", "price_drift_severity"]


@query("run_drift", with_sql(OBS, PARSED, RM, EXPECT, body=f"SELECT run_id, {', '.join(r6_sql(s, s) for s in _DRIFT)} FROM dr"))
def run_drift(spark, d):
    return rounded(drifted_runs(spark, d), *_DRIFT).select("run_id", *_DRIFT)


HEALTH = """rh AS (SELECT *, (1 - parse_error_rate) * 0.3::DOUBLE + (1 - missing_price_rate) * 0.2::DOUBLE + (1 - missing_title_rate) * 0.2::DOUBLE
  + (1 - coalesce(row_count_severity, 0)) * 0.15::DOUBLE + (1 - coalesce(price_drift_severity, 0)) * 0.15::DOUBLE AS health_score FROM dr)"""


@query("run_health", with_sql(OBS, PARSED, RM, EXPECT, HEALTH, body=f"""SELECT run_id, {r6_sql('health_score', 'health_score')}, health_score >= 0.7 AS is_healthy,
  concat_ws(',', CASE WHEN parse_error_rate > 0.05 THEN 'high_parse_errors' END, CASE WHEN missing_price_rate > 0.1 THEN 'high_missing_price' END,
  CASE WHEN missing_title_rate > 0.2 THEN 'high_missing_title' END, CASE WHEN missing_image_rate > 0.3 THEN 'high_missing_image' END,
  CASE WHEN missing_ean_rate > 0.5 THEN 'high_missing_ean' END, CASE WHEN row_count_drift < -0.2 THEN 'row_count_drop' WHEN row_count_drift > 0.2 THEN 'row_count_spike' END,
  CASE WHEN price_drift_severity > 0.3 THEN 'price_distribution_drift' END,
  CASE WHEN unique_products < 10 AND total_records > 100 THEN 'low_unique_products' END) AS warnings FROM rh"""))
def run_health(spark, d):
    out = rounded(Q.run_health(drifted_runs(spark, d)), "health_score")
    return out.select("run_id", "health_score", "is_healthy", F.array_join("warning_flags", ",").alias("warnings"))


@query("rows_with_run_health", with_sql(OBS, PARSED, RM, EXPECT, HEALTH, body="""SELECT health_score >= 0.7 AS run_is_healthy, count(*) AS n_rows,
  count(DISTINCT product_id) AS n_products FROM obs JOIN rh USING (run_id) GROUP BY 1"""))
def rows_with_run_health(spark, d):
    """Run-level features attached to product rows."""
    from tidemark.catalog.base import observations

    health = Q.run_health(drifted_runs(spark, d)).select("run_id", F.col("is_healthy").alias("run_is_healthy"))
    return observations(spark, d).join(health, "run_id").groupBy("run_is_healthy").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("product_id").alias("n_products")
    )


CD = """cd0 AS (SELECT vec_id, vec_id % 4 AS run, label, embedding AS a, CASE WHEN vec_id % 37 = 0 THEN '' ELSE text END AS title FROM embeddings JOIN documents ON doc_id = vec_id),
cd1 AS (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY vec_id) AS b, coalesce(lag(title) OVER (PARTITION BY label ORDER BY vec_id), '') AS old FROM cd0),
cd2 AS (SELECT *, CASE WHEN b IS NOT NULL AND title <> '' THEN list_sum([a[i]::DOUBLE * b[i]::DOUBLE FOR i IN range(1, len(a) + 1)])
  / (sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN a])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN b]))) END AS sim,
  CASE WHEN title <> '' AND old <> '' THEN len(title) / len(old)::DOUBLE END AS length_ratio FROM cd1),
cd AS (SELECT *, coalesce(1 - sim > 0.2, false) AS drift, coalesce(length_ratio < 0.5, false) OR (old <> '' AND title = '') AS degraded FROM cd2)"""


def drift_rows(spark, d):
    titles = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"))
    rows = table(spark, d, "embeddings").join(titles, F.col("doc_id") == F.col("vec_id"))
    rows = rows.withColumns({
        "title": F.when(F.col("vec_id") % 37 == 0, "").otherwise(F.col("title")), "run": F.col("vec_id") % 4,
    })
    before = X.with_previous(rows, ["label"], ["vec_id"], ["embedding", "title"], F.col("vec_id"))
    return Q.content_drift(before)


@query("content_drift", with_sql(CD, body=f"""SELECT vec_id, b IS NOT NULL AS has_previous, {r6_sql('sim', 'title_similarity')},
  {r6_sql('length_ratio', 'title_length_ratio')}, drift AS title_drift, degraded AS content_degraded FROM cd"""))
def content_drift(spark, d):
    return rounded(drift_rows(spark, d), "title_similarity", "title_length_ratio").select(
        "vec_id", "has_previous", "title_similarity", "title_length_ratio", "title_drift", "content_degraded"
    )


@query("content_drift_summary", with_sql(CD, body=f"""SELECT run, count(*) AS total_products, count(b) AS with_previous, count(*) FILTER (drift) AS with_title_drift,
  count(*) FILTER (degraded) AS with_degradation, {r6_sql('avg(sim)', 'mean_similarity')}, {r6_sql('min(sim)', 'min_similarity')},
  {r6_sql('count(*) FILTER (drift) / count(b)', 'title_drift_rate')}, {r6_sql('count(*) FILTER (degraded) / count(b)', 'degradation_rate')} FROM cd GROUP BY run"""))
def content_drift_summary(spark, d):
    out = Q.content_drift_summary(drift_rows(spark, d), ["run"])
    return rounded(out, "mean_similarity", "min_similarity", "title_drift_rate", "degradation_rate")


@query("content_problem_products", with_sql(CD, body="""SELECT run, vec_id, 'drifted' AS problem FROM cd WHERE drift
  UNION ALL SELECT run, vec_id, 'degraded' FROM cd WHERE degraded"""))
def content_problem_products(spark, d):
    return Q.problem_products(drift_rows(spark, d), ["run"], "vec_id")


# A run may see a product twice; the tracker ignores the repeat.
TRACK = """tk0 AS (SELECT *, date_trunc('day', seen_at) AS day, CAST(date_trunc('day', seen_at) AS VARCHAR) AS run FROM (SELECT event_id, user_id, seen_at, round(price / 10) AS price FROM
  (SELECT event_id, user_id, ts AS seen_at, value AS price FROM events))),
tk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen_at, event_id) AS rn FROM tk0),
tw AS (SELECT user_id, event_id, rn, price AS cur, NULL::DOUBLE AS prev, 1::BIGINT AS runs, run, seen_at AS since, false AS changed, false AS fresh, false AS stable FROM tk WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, CASE WHEN NOT same AND moved THEN price ELSE cur END, CASE WHEN NOT same AND moved THEN cur ELSE prev END,
    CASE WHEN same THEN runs WHEN moved THEN 1 ELSE runs + 1 END, run2, CASE WHEN NOT same AND moved THEN at2 ELSE since END,
    NOT same AND moved, NOT same AND moved, CASE WHEN same THEN runs >= 2 WHEN moved THEN false ELSE runs + 1 >= 2 END FROM (
    SELECT w.user_id, k.event_id, k.rn, k.price, w.cur, w.prev, w.runs, w.since, k.run AS run2, k.seen_at AS at2, k.run = w.run AS same,
      CASE WHEN w.cur = 0 THEN k.price <> 0 ELSE abs(k.price - w.cur) / w.cur > 0.01 END AS moved
    FROM tw w JOIN tk k ON k.user_id = w.user_id AND k.rn = w.rn + 1))"""


def tracked(spark, d):
    from tidemark.catalog.base import event_observations
    from tidemark.operators.tracker import track_changes

    events = event_observations(spark, d).withColumns({
        "price": F.round(F.col("price") / 10), "run": F.date_format("seen_at", "yyyy-MM-dd"),
    })
    return track_changes(events, ["user_id"], ["seen_at", "event_id"], "run", keep=["event_id"])


@query("change_persistence", with_sql(TRACK, body=f"""SELECT event_id, {r6_sql('prev', 'previous_price')}, changed AS price_changed, runs AS persisted_runs,
  fresh AS is_new_change, stable AS is_stable FROM tw""", recursive=True))
def change_persistence(spark, d):
    return rounded(tracked(spark, d), "previous_price").select(
        "event_id", "previous_price", "price_changed", "persisted_runs", "is_new_change", "is_stable"
    )


@query("unstable_series", with_sql(TRACK, body=f"""SELECT user_id, {r6_sql('max_by(cur, rn)', 'current_price')}, max_by(runs, rn) AS persisted_runs
  FROM tw GROUP BY user_id HAVING max_by(runs, rn) < 2""", recursive=True))
def unstable_series(spark, d):
    from tidemark.operators.tracker import latest_states, unstable

    states = unstable(latest_states(tracked(spark, d), ["user_id"]))
    return rounded(states, "current_price").select("user_id", "current_price", "persisted_runs")


@query("tracker_statistics", with_sql(TRACK, body="""SELECT count(*) AS total_tracked, count(*) FILTER (r >= 2) AS stable, count(*) FILTER (r < 2) AS unstable
  FROM (SELECT max_by(runs, rn) AS r FROM tw GROUP BY user_id)""", recursive=True))
def tracker_statistics(spark, d):
    from tidemark.operators.tracker import latest_states, tracker_statistics as stats

    return stats(latest_states(tracked(spark, d), ["user_id"]))
