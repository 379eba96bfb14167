"""Cascades, ensembles, votes, order analysis and the scrape-issue classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EV, OBS, ORDER, SERIES, event_observations, observations, query, r6, r6_sql, rounded, table, with_sql,
)
from tidemark.catalog.evaluation import (
    DETECTORS, SCORED, conf_sql, long_predictions, rates_sql, raw_rates, scored_base,
)
from tidemark.catalog.features import TALK, talk_features
from tidemark.catalog.scoring import RANK, cap, fold_select, fold_sql, folded, z_parts
from tidemark.functions import scalar as S
from tidemark.operators import cascade as C
from tidemark.operators import classify as K
from tidemark.operators import detectors as D
from tidemark.operators import fold as G
from tidemark.operators import metrics as M
from tidemark.operators import rules as R

# Severities and types of the four members, as SQL over ``scored``.
MEMBERS = """mb AS (SELECT *, CASE WHEN abs_z > 5.8 THEN 4 WHEN abs_z > 4.35 THEN 3 WHEN abs_z > 2.9 THEN 2 ELSE 0 END AS zscore_v,
  CASE WHEN iqr AND spread > 0 THEN CASE WHEN dist / spread > 3 THEN 4 WHEN dist / spread > 2 THEN 3 ELSE 2 END ELSE 0 END AS iqr_v,
  CASE WHEN abs_change > 0.2 THEN CASE WHEN abs_change > 0.2::DOUBLE * 3 THEN 4 WHEN abs_change > 0.2::DOUBLE * 2 THEN 3 ELSE 2 END ELSE 0 END AS threshold_v,
  CASE WHEN NOT ok THEN 4 WHEN mismatch OR ratio > 1 THEN 3 ELSE 0 END AS sanity_v,
  list_filter([CASE WHEN NOT ok THEN 'data_quality' END, CASE WHEN ratio > 1 THEN 'price_sanity' END, CASE WHEN mismatch THEN 'currency_mismatch' END], lambda x: x IS NOT NULL) AS sanity_t,
  CASE WHEN zscore THEN ['price_zscore'] ELSE [] END AS zscore_t, CASE WHEN iqr THEN ['price_iqr'] ELSE [] END AS iqr_t,
  CASE WHEN threshold THEN ['price_change'] ELSE [] END AS threshold_t FROM scored)"""


def cascade_sql(stat_members: list[str]) -> str:
    """Sanity gate, then members that need three observations."""
    live = "(NOT sanity AND n >= 3)"
    k = len(stat_members)
    types = "list_concat(sanity_t, " + ", ".join(f"CASE WHEN {live} THEN {m}_t ELSE [] END" for m in stat_members) + ")"
    flags = " + ".join(f"CASE WHEN {live} AND {m} THEN 1 ELSE 0 END" for m in stat_members)
    score = ", ".join(f"CASE WHEN {live} THEN {m}_s ELSE 0 END" for m in stat_members)
    sev = ", ".join(f"CASE WHEN {live} THEN {m}_v ELSE 0 END" for m in stat_members)
    return with_sql(*SCORED, MEMBERS, body=f"""SELECT obs_id, len({types}) > 0 AS flagged, {r6_sql(f'greatest(sanity_s, {score})', 'score')},
  [NULL, 'low', 'medium', 'high', 'critical'][1 + greatest(sanity_v, {sev})] AS severity,
  array_to_string(list_sort(list_distinct({types})), ',') AS types, CAST(1 + CASE WHEN {live} THEN {k} ELSE 0 END AS BIGINT) AS votes,
  {r6_sql(f'(CASE WHEN sanity THEN 1 ELSE 0 END + {flags}) / (1 + CASE WHEN {live} THEN {k} ELSE 0 END)::DOUBLE', 'confidence')},
  CASE WHEN n < 3 THEN 'cold_start' WHEN n < 5 THEN 'limited' ELSE 'full' END AS route, sanity AS short_circuited FROM mb""")


def _cascade(name: str, preset: str, members: list[str]) -> None:
    @query(name, cascade_sql(members))
    def run(spark, d):
        out = scored_base(spark, d).withColumn("r", C.cascade(C.PRESETS[preset], DETECTORS)).select("obs_id", "r.*")
        return rounded(out, "score", "confidence").withColumn("types", F.array_join("types", ","))


_cascade("cascade_minimal", "minimal", ["zscore"])
_cascade("cascade_statistical_only", "statistical_only", ["zscore", "iqr", "threshold"])
_cascade("cascade_default_without_model", "default", ["zscore", "iqr", "threshold"])


@query("layer_history_bounds", with_sql(*SCORED, body="""SELECT n BETWEEN 3 AND 9 AS in_bounds, count(*) AS n_rows,
  count(*) FILTER (zscore AND n BETWEEN 3 AND 9) AS n_flagged FROM scored GROUP BY 1"""))
def layer_history_bounds(spark, d):
    bounded = [C.layer("z", ["zscore"], least=3, most=9)]
    out = scored_base(spark, d).withColumn("r", C.cascade(bounded, DETECTORS))
    return out.groupBy((F.col("r.votes") > 0).alias("in_bounds")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("r.flagged").alias("n_flagged")
    )


@query("weighted_score_ensemble", with_sql(*SCORED, """we AS (SELECT obs_id, CASE WHEN n >= 3 THEN 0.5 ELSE 0 END AS w1, zscore_s AS s1, CASE WHEN n >= 4 THEN 0.3 ELSE 0 END AS w2, iqr_s AS s2,
  0.2 AS w3, threshold_s AS s3 FROM scored), wf AS (SELECT obs_id, (w1 * s1 + w2 * s2 + w3 * s3) / (w1 + w2 + w3) AS score FROM we)""",
    body=f"""SELECT obs_id, {r6_sql('score', 'score')}, score >= 0.55 AS flagged, CASE WHEN score >= 0.55 THEN CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.8 THEN 'high'
  WHEN score >= 0.7 THEN 'medium' ELSE 'low' END END AS severity FROM wf"""))
def weighted_score_ensemble(spark, d):
    ensemble = C.weighted_ensemble({"zscore": 0.5, "iqr": 0.3, "threshold": 0.2, "sanity": 0.0}, decide_at=0.55)
    out = scored_base(spark, d).withColumn("r", ensemble).select("obs_id", "r.score", "r.flagged", "r.severity")
    return rounded(out, "score")


@query("gated_cascade_minimal", with_sql(OBS, """so AS (SELECT *, coalesce(price, 0.0) <= 0 OR currency IS NULL AS bad,
  coalesce(currency <> replace(country, 'COUNTRY', 'CURRENCY'), false) AS mismatch, coalesce(CASE WHEN list_price > 0 THEN coalesce(price, 0.0) / list_price END > 1, false) AS over FROM obs)""",
    fold_sql(", ".join(SERIES), "obs_id", "SELECT *, bad OR mismatch OR over AS sane_flag, CASE WHEN bad THEN 1.0 WHEN mismatch THEN 0.95 WHEN over THEN 0.9 ELSE 0 END AS sane_score, CASE WHEN bad THEN 'critical' WHEN mismatch OR over THEN 'high' END AS sane_sev FROM so",
             "sane_flag OR (n >= 3 AND abs(z) > 2.9)", f"CASE WHEN sane_flag OR n < 3 THEN sane_score ELSE {cap('abs(z)', 5.8)} END",
             "CASE WHEN sane_flag THEN sane_sev WHEN abs(z) > 5.8 THEN 'critical' WHEN abs(z) > 4.35 THEN 'high' ELSE 'medium' END"),
    body=fold_select("obs_id"), recursive=True))
def gated_cascade_minimal(spark, d):
    """Sanity gate, then z-score, with the baseline gated by the cascade's own decision."""
    checked = D.evaluation_features(observations(spark, d)).withColumn("s", D.sanity())
    rows = checked.withColumns({
        "s_flagged": F.col("s.flagged"), "s_score": F.col("s.score"), "s_severity": F.col("s.severity"),
        "s_types": F.array_join("s.types", ","),
    })
    rule = R.cascade_rule([
        {"rules": {"sanity": R.row_rule("s")}, "gate": True}, {"rules": {"z": R.zscore_rule(2.9)}, "min": 3},
    ])
    out = G.gated_fold(rows, SERIES, ORDER, rule, keep=["obs_id"],
                       extra=["s_flagged", "s_score", "s_severity", "s_types"])
    return folded(out, "obs_id")


@query("gated_weighted_ensemble", with_sql(EV, fold_sql("user_id", "event_id", "SELECT * FROM ev",
    f"CASE WHEN n >= 3 THEN (0.6 * {cap('abs(z)', 4.0)} + 0.4 * {cap('abs(c)', 0.4)}) ELSE {cap('abs(c)', 0.4)} END >= 0.5001",
    f"CASE WHEN n >= 3 THEN (0.6 * {cap('abs(z)', 4.0)} + 0.4 * {cap('abs(c)', 0.4)}) ELSE {cap('abs(c)', 0.4)} END",
    "NULL"), body="SELECT ident AS event_id, n AS observation_count, flagged, round(score + 1.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS score FROM walk WHERE rn > 0", recursive=True))
def gated_weighted_ensemble(spark, d):
    rule = R.weighted_rule([(R.zscore_rule(2.0), 0.6), (R.change_rule(0.2), 0.4)], decide_at=0.5001)
    out = G.gated_fold(event_observations(spark, d), ["user_id"], ["seen_at", "event_id"], rule, keep=["event_id"])
    return rounded(out, "score").select("event_id", "observation_count", "flagged", "score")


@query("vote_confidence", with_sql(*SCORED, body=f"""SELECT obs_id, count(*) AS total_detectors, count(*) FILTER (predicted) AS flagged_count,
  {r6_sql('avg(CAST(predicted AS INTEGER))', 'confidence')}, {r6_sql("max(score) FILTER (detector = 'zscore')", 'zscore_score')}, {r6_sql('sum(score)', 'score_sum')} FROM preds GROUP BY obs_id"""))
def vote_confidence(spark, d):
    votes = long_predictions(scored_base(spark, d), ["obs_id"]).withColumnRenamed("predicted", "flagged")
    out = C.votes_confidence(votes, ["obs_id"]).withColumns({
        "zscore_score": F.col("scores")["zscore"],
        "score_sum": F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x),
    }).drop("scores")
    return rounded(out, "confidence", "zscore_score", "score_sum")


@query("weighted_confidence", with_sql(*SCORED, "wv AS (SELECT obs_id, predicted, CASE detector WHEN 'zscore' THEN 2.0 WHEN 'sanity' THEN 0.5 ELSE 1.0 END AS w FROM preds)",
    body=f"SELECT obs_id, {r6_sql('coalesce(sum(w) FILTER (predicted), 0) / sum(w)', 'weighted_confidence')} FROM wv GROUP BY obs_id"))
def weighted_confidence(spark, d):
    votes = long_predictions(scored_base(spark, d), ["obs_id"]).withColumnRenamed("predicted", "flagged")
    return rounded(C.weighted_confidence(votes, ["obs_id"], {"zscore": 2.0, "sanity": 0.5}), "weighted_confidence")


def patterns(spark, d):
    return C.flag_patterns(scored_base(spark, d), DETECTORS)


_PAIR = "pa AS (SELECT a.detector AS first, b.detector AS second, a.predicted AS pa, b.predicted AS pb, a.truth FROM preds a JOIN preds b USING (obs_id))"


@query("detector_overlap", with_sql(*SCORED, _PAIR, body=f"""SELECT first, second, {r6_sql('coalesce(count(*) FILTER (pa AND pb AND truth) / nullif(count(*) FILTER ((pa OR pb) AND truth), 0), 0)', 'jaccard')}
  FROM pa GROUP BY first, second"""))
def detector_overlap(spark, d):
    return rounded(C.overlap(patterns(spark, d), DETECTORS), "jaccard").select("first", "second", "jaccard")


@query("conditional_catch_rates", with_sql(*SCORED, _PAIR, body=f"""SELECT first, second, count(*) FILTER (NOT pa AND truth) AS missed, count(*) FILTER (NOT pa AND pb AND truth) AS caught,
  {r6_sql('count(*) FILTER (NOT pa AND pb AND truth) / nullif(count(*) FILTER (NOT pa AND truth), 0)', 'catch_rate')} FROM pa WHERE first <> second GROUP BY first, second"""))
def conditional_catch_rates(spark, d):
    out = C.overlap(patterns(spark, d), DETECTORS).filter("first <> second")
    return rounded(out, "catch_rate").select("first", "second", "missed", "caught", "catch_rate")


_ORD = ["sanity", "zscore", "threshold", "iqr"]


def _order_sql() -> str:
    parts = []
    for i, name in enumerate(_ORD):
        before = " OR ".join(_ORD[:i]) or "false"
        later = " OR ".join(_ORD[i + 1:]) or "false"
        now = " OR ".join(_ORD[:i + 1])
        parts.append(f"""SELECT {i + 1} AS position, '{name}' AS detector, count(*) FILTER ({name} AND truth AND NOT ({before})) AS unique_catches,
  count(*) FILTER ({name}) AS flags, count(*) FILTER ({name} AND ({later})) AS again, count(*) FILTER (({now}) AND truth) AS tp,
  count(*) FILTER (({now}) AND NOT truth) AS fp, count(*) FILTER (truth) AS pos FROM scored""")
    return f"oa AS ({' UNION ALL '.join(parts)}), ob AS (SELECT *, 2 * tp / (tp + fp + pos)::DOUBLE AS f1 FROM oa)"


@query("cascade_order_analysis", with_sql(*SCORED, _order_sql(), body=f"""SELECT position, detector, unique_catches, {r6_sql('unique_catches / pos', 'unique_catch_rate')},
  {r6_sql('tp / pos', 'cumulative_recall')}, {r6_sql('f1', 'cumulative_f1')}, {r6_sql('f1 - coalesce(lag(f1) OVER (ORDER BY position), 0)', 'marginal_f1')},
  {r6_sql('coalesce(again / nullif(flags, 0), 0)', 'short_circuit_rate')} FROM ob"""))
def cascade_order_analysis(spark, d):
    out = C.order_analysis(patterns(spark, d), _ORD)
    return rounded(out, "unique_catch_rate", "cumulative_recall", "cumulative_f1", "marginal_f1", "short_circuit_rate")


@query("greedy_order_by_f1")
def greedy_order_by_f1(spark, d):
    return rounded(C.greedy_by_f1(spark, patterns(spark, d), DETECTORS), "cumulative_f1", "marginal_gain")


@query("greedy_order_by_catches", with_sql(*SCORED, """pos AS (SELECT * FROM scored WHERE truth), alltrue AS (SELECT count(*) AS total FROM pos),
s1 AS (SELECT detector AS d1, count(*) AS c FROM preds WHERE truth AND predicted GROUP BY detector ORDER BY c DESC, detector LIMIT 1),
l1 AS (SELECT p.obs_id FROM pos p WHERE p.obs_id NOT IN (SELECT obs_id FROM preds, s1 WHERE predicted AND detector = d1)),
s2 AS (SELECT detector AS d2, count(*) AS c FROM preds WHERE predicted AND obs_id IN (SELECT obs_id FROM l1) GROUP BY detector ORDER BY c DESC, detector LIMIT 1),
l2 AS (SELECT obs_id FROM l1 WHERE obs_id NOT IN (SELECT obs_id FROM preds, s2 WHERE predicted AND detector = d2)),
s3 AS (SELECT detector AS d3, count(*) AS c FROM preds WHERE predicted AND obs_id IN (SELECT obs_id FROM l2) GROUP BY detector ORDER BY c DESC, detector LIMIT 1),
l3 AS (SELECT obs_id FROM l2 WHERE obs_id NOT IN (SELECT obs_id FROM preds, s3 WHERE predicted AND detector = d3)),
s4 AS (SELECT detector AS d4, count(*) AS c FROM preds WHERE predicted AND obs_id IN (SELECT obs_id FROM l3) GROUP BY detector ORDER BY c DESC, detector LIMIT 1),
al AS (SELECT 1 AS position, d1 AS detector, c FROM s1 UNION ALL SELECT 2, d2, c FROM s2 UNION ALL SELECT 3, d3, c FROM s3 UNION ALL SELECT 4, d4, c FROM s4)""",
    body=f"SELECT position, detector, c AS new_catches, {r6_sql('sum(c) OVER (ORDER BY position) / total', 'cumulative_recall')} FROM al, alltrue"))
def greedy_order_by_catches(spark, d):
    return rounded(C.greedy_by_catches(spark, patterns(spark, d), DETECTORS), "cumulative_recall")


_BUCKET = "CASE WHEN n < 3 THEN '0-3' WHEN n < 5 THEN '3-5' WHEN n < 10 THEN '5-10' WHEN n < 30 THEN '10-30' ELSE '30-+' END"


@query("metrics_by_history_bucket", with_sql(*SCORED, f"hb AS (SELECT {_BUCKET} AS bucket, detector, {conf_sql()} FROM preds GROUP BY ALL)",
    body=f"SELECT bucket, detector, tp + fp + fn + tn AS n_samples, tp + fn AS n_anomalies, {rates_sql('precision', 'recall', 'f1')} FROM hb"))
def metrics_by_history_bucket(spark, d):
    preds = long_predictions(scored_base(spark, d), ["observation_count", "truth"])
    out = M.detector_metrics(preds.withColumn("bucket", C.history_bucket(F.col("observation_count"))), ["bucket", "detector"])
    out = out.withColumnsRenamed({"n_rows": "n_samples", "n_injected": "n_anomalies"})
    names = ["precision", "recall", "f1"]
    return rounded(out, *names).select("bucket", "detector", "n_samples", "n_anomalies", *names)


@query("anomaly_matrix", with_sql(*SCORED, body="""SELECT obs_id, anomaly_type, zscore, iqr, threshold, sanity,
  CAST(zscore AS INTEGER) + CAST(iqr AS INTEGER) + CAST(threshold AS INTEGER) + CAST(sanity AS INTEGER) AS n_detectors,
  zscore OR iqr OR threshold OR sanity AS any_detector, zscore AND iqr AND threshold AND sanity AS all_detectors FROM scored WHERE truth"""))
def anomaly_matrix(spark, d):
    return C.anomaly_matrix(scored_base(spark, d), ["obs_id", "anomaly_type"], DETECTORS)


# --------------------------------------------------------- scrape-issue rules

CLS = TALK + """,
cl0 AS (SELECT conv_id, turn, coalesce(abs(pct) > 0.01, false) AS moved, coalesce(similarity < 0.8, false) AS title_changed,
  coalesce(previous_title <> '' AND (title = '' OR len(title) < len(previous_title) * 0.5), false) AS degraded, turn % 5 AS runs,
  CASE WHEN conv_id % 11 = 10 THEN NULL ELSE (conv_id % 11) / 10.0::DOUBLE END AS agree, (conv_id * 7 + turn * 3) % 10 / 10.0::DOUBLE AS anomaly, (conv_id * 3) % 10 / 10.0::DOUBLE AS health FROM coherent),
cl1 AS (SELECT *, 0.0::DOUBLE + CASE WHEN degraded AND moved THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN health < 0.6 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN runs < 2 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN agree < 0.3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN anomaly > 0.7 THEN 0.1::DOUBLE ELSE 0 END AS s0 FROM cl0),
cl2 AS (SELECT *, CASE WHEN runs >= 4 THEN greatest(0, s0 - 0.2::DOUBLE) ELSE s0 END AS s1 FROM cl1),
cl3 AS (SELECT *, CASE WHEN agree > 0.5 THEN greatest(0, s1 - 0.15::DOUBLE) ELSE s1 END AS s2 FROM cl2),
cl4 AS (SELECT *, CASE WHEN moved AND NOT degraded AND NOT title_changed THEN greatest(0, s2 - 0.1::DOUBLE) ELSE s2 END AS p FROM cl3),
cls AS (SELECT *, CASE WHEN p > 0.65::DOUBLE THEN 'scrape_issue' WHEN p < 0.35::DOUBLE THEN 'real_event' ELSE 'uncertain' END AS kind FROM cl4)"""


def classifier_rows(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    return talk_features(spark, d).withColumns({
        "change_persisted_runs": turn % 5,
        "cross_competitor_agreement": F.when(conv % 11 != 10, (conv % 11) / 10.0),
        "price_anomaly_score": (conv * 7 + turn * 3) % 10 / 10.0,
        "run_health_score": (conv * 3) % 10 / 10.0,
        "run_is_healthy": (conv * 3) % 10 / 10.0 >= 0.6,
        "is_price_anomaly": (conv * 7 + turn * 3) % 10 / 10.0 > 0.7,
    })


@query("scrape_issue_classes", with_sql(CLS, body=f"""SELECT conv_id, turn, {r6_sql('p', 'probability')}, kind AS classification,
  {r6_sql("CASE kind WHEN 'scrape_issue' THEN least((p - 0.5) / 0.5, 1) WHEN 'real_event' THEN least((0.5 - p) / 0.5, 1) ELSE 0.5 END", 'confidence')},
  concat_ws(',', CASE WHEN degraded AND moved THEN 'CONTENT_DEGRADED_WITH_PRICE_CHANGE' END, CASE WHEN health < 0.6 THEN 'RUN_UNHEALTHY' END,
  CASE WHEN runs < 2 THEN 'NOT_PERSISTED' END, CASE WHEN agree < 0.3 THEN 'NO_CROSS_COMPETITOR_AGREEMENT' END, CASE WHEN anomaly > 0.7 THEN 'HIGH_ANOMALY_SCORE' END,
  CASE WHEN runs >= 4 THEN 'CHANGE_WELL_PERSISTED' END, CASE WHEN agree > 0.5 THEN 'CROSS_COMPETITOR_CORROBORATED' END,
  CASE WHEN moved AND NOT degraded AND NOT title_changed THEN 'CONTENT_INTACT' END) AS reasons,
  kind = 'scrape_issue' AS suppress, kind <> 'scrape_issue' AND runs < 2 AS wait, kind = 'uncertain' AS review FROM cls"""))
def scrape_issue_classes(spark, d):
    out = rounded(K.classify(classifier_rows(spark, d)), "scrape_issue_probability", "confidence")
    return out.select(
        "conv_id", "turn", F.col("scrape_issue_probability").alias("probability"), "classification", "confidence",
        F.array_join("reason_codes", ",").alias("reasons"), F.col("suppress_downstream").alias("suppress"),
        F.col("requires_persistence_check").alias("wait"), F.col("requires_manual_review").alias("review"),
    )


@query("classifier_inputs", with_sql(CLS, body=f"""SELECT conv_id, turn, {r6_sql('CAST(moved AS INTEGER)', 'price_changed')}, {r6_sql('coalesce(agree, 0)', 'cross_competitor_agreement')},
  {r6_sql('CASE WHEN health >= 0.6 THEN 1 ELSE 0 END', 'run_is_healthy')}, {r6_sql('runs', 'change_persisted_runs')} FROM cls"""))
def classifier_inputs(spark, d):
    names = ["price_changed", "cross_competitor_agreement", "run_is_healthy", "change_persisted_runs"]
    return rounded(K.classifier_inputs(classifier_rows(spark, d)), *names).select("conv_id", "turn", *names)


@query("classifier_evaluation", with_sql(CLS, f"ce AS (SELECT {conf_sql(chr(40) + 'kind = ' + chr(39) + 'scrape_issue' + chr(39) + chr(41), '(turn % 3 = 0)')} FROM cls)",
    body=f"SELECT tp, fp, fn, tn, {rates_sql('accuracy', 'precision', 'recall', 'f1')} FROM ce"))
def classifier_evaluation(spark, d):
    """The suppress flag against known scraper faults (every third turn stands for one)."""
    out = K.classify(classifier_rows(spark, d)).withColumn("fault", F.col("turn") % 3 == 0)
    names = ["accuracy", "precision", "recall", "f1"]
    metrics = M.with_rates(out.agg(*M.confusion("suppress_downstream", "fault")))
    return rounded(metrics, *names).select("tp", "fp", "fn", "tn", *names)


@query("classifier_accuracy_by_type", with_sql(CLS, body=f"""SELECT ['title_collapse', 'zero_price', 'price_spike'][1 + CAST(turn % 3 AS INTEGER)] AS anomaly_type, count(*) AS n,
  count(*) FILTER ((kind = 'scrape_issue') = (turn % 3 < 2)) AS correct, {r6_sql("count(*) FILTER ((kind = 'scrape_issue') = (turn % 3 < 2)) / count(*)", 'accuracy')} FROM cls GROUP BY 1"""))
def classifier_accuracy_by_type(spark, d):
    kind = F.get(F.array(F.lit("title_collapse"), F.lit("zero_price"), F.lit("price_spike")), (F.col("turn") % 3).cast("int"))
    # The injected types that stand for scraper faults.
    faults = ["zero_price", "negative_price", "title_collapse", "decimal_shift", "currency_swap"]
    out = K.classify(classifier_rows(spark, d)).withColumn("anomaly_type", kind)
    right = F.col("suppress_downstream") == F.col("anomaly_type").isin(faults)
    res = out.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"))
    return rounded(res.withColumn("accuracy", F.col("correct") / F.col("n")), "accuracy")


@query("learned_classifier")
def learned_classifier(spark, d):
    """Balanced logistic regression on the eleven inputs, scored back on its rows."""
    rows = classifier_rows(spark, d).withColumn("label", F.col("content_degraded").cast("double"))
    model = K.train_classifier(rows)
    scored = model.transform(K.classifier_inputs(rows))
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


AGREE = f"""ag0 AS (SELECT product_id AS ean, competitor_id, price, lag(price) OVER (PARTITION BY product_id, competitor_id ORDER BY seen_at, obs_id) AS prev,
  row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY seen_at DESC, obs_id DESC) AS back FROM obs WHERE price > 0),
ag AS (SELECT ean, competitor_id, (price - prev) / prev AS c FROM ag0 WHERE back = 1 AND prev IS NOT NULL),
aj AS (SELECT a.ean, a.competitor_id, b.competitor_id AS other, a.c * b.c > 0 AND least(abs(a.c), abs(b.c)) / greatest(abs(a.c), abs(b.c), 0.001) > 0.5000000001 AS alike
  FROM ag a LEFT JOIN ag b ON a.ean = b.ean AND a.competitor_id <> b.competitor_id)"""


@query("cross_competitor_agreement", with_sql(OBS, AGREE, body=f"""SELECT ean, competitor_id, {r6_sql('count(*) FILTER (alike) / nullif(count(other), 0)', 'agreement')}
  FROM aj GROUP BY ean, competitor_id"""))
def cross_competitor_agreement(spark, d):
    from tidemark.operators.features import micros, with_previous

    valid = observations(spark, d).filter(F.col("price") > 0)
    before = with_previous(valid, SERIES, ORDER, ["price"], micros())
    latest = before.groupBy(*SERIES).agg(F.max_by(F.struct("price", "previous_price"), F.struct(*ORDER)).alias("x"))
    changes = latest.filter("x.previous_price IS NOT NULL").select(
        F.col("product_id").alias("ean"), "competitor_id",
        ((F.col("x.price") - F.col("x.previous_price")) / F.col("x.previous_price")).alias("change_pct"),
    )
    out = K.cross_competitor_agreement(changes)
    return out.select("ean", "competitor_id", r6("cross_competitor_agreement", "agreement"))
