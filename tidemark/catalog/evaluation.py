"""Injection, detector metrics, sweeps and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EV, OBS, ORDER, SERIES, event_observations, is_stored, observation_table, observations, query, r6, r6_sql, rounded, stored,
    uniform_sql, with_sql,
)
from tidemark.catalog.scoring import cap, fold_sql
from tidemark.operators import detectors as D
from tidemark.operators import features as X
from tidemark.operators import fold as G
from tidemark.operators import inject as I
from tidemark.operators import metrics as M
from tidemark.operators import rules as R

DS = """ds AS (SELECT *, CASE WHEN product_id % 10 < 3 THEN 'new_products' ELSE 'new_prices' END AS dataset_split FROM obs)"""


def with_split(obs):
    """A fixed three-in-ten product split, for metric queries."""
    return obs.withColumn("dataset_split", F.when(F.col("product_id") % 10 < 3, "new_products").otherwise("new_prices"))


def _u(seed: str, tag: str) -> str:
    if seed.isdigit():
        return uniform_sql(seed, tag, "obs_id")
    return f"(('0x' || substr(md5({seed} || '|{tag}|' || obs_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_CHANGE = {
    "price_spike": "price * (2 + us * 3)",
    "price_drop": "greatest(1, price * (0.1::DOUBLE + us * 0.4::DOUBLE))",
    "price_noise": "greatest(1, price * (1 + (-0.3::DOUBLE + us * 0.6::DOUBLE)))",
    "list_price_violation": "CASE WHEN list_price > 0 THEN list_price * (1.1::DOUBLE + us * (1.5::DOUBLE - 1.1::DOUBLE)) ELSE price * (1.3::DOUBLE + us * 0.5::DOUBLE) END",
    "zero_price": "0.0",
    "negative_price": "-abs(price * (0.1::DOUBLE + us * 0.4::DOUBLE))",
    "extreme_outlier": "greatest(1, mean + CASE WHEN ud < 0.5 THEN -1 ELSE 1 END * (4 + us * 4) * std)",
    "title_collapse": "price * (0.5 + us)",
    "decimal_shift": "greatest(1, price * CASE WHEN ud < 0.5 THEN 100.0::DOUBLE ELSE 0.01::DOUBLE END)",
    "currency_swap": "greatest(1, price * CASE currency WHEN 'CURRENCY_2' THEN 0.1::DOUBLE WHEN 'CURRENCY_3' THEN 1.4::DOUBLE WHEN 'CURRENCY_4' THEN 0.7::DOUBLE WHEN 'CURRENCY_5' THEN 0.1::DOUBLE ELSE 10.0::DOUBLE END)",
    "transient_spike": "price * (1.5 + us * 1.5)",
    "persistent_change": "greatest(1, price * (0.7::DOUBLE + us * (1.3::DOUBLE - 0.7::DOUBLE)))",
}


def inject_sql(source: str, by: str = "", rate: float = 0.1, types=tuple(I.DEFAULT_TYPES), seed: str = "42") -> str:
    """Injection over ``source`` as CTEs ending in ``inj``."""
    types = list(types)
    others = [t for t in types if t != "list_price_violation"]
    lead = f"{by}, " if by else ""
    has_first = "list_price_violation" in types
    first = f"least(nl, floor(budget / {len(types)}))" if has_first else "0"
    join = f"USING ({by})" if by else "ON true"
    return f"""iv AS (SELECT *, coalesce(price > 0, false) AS valid, coalesce(price > 0 AND list_price > 0, false) AS listed,
  {_u(seed, 'phase1')} AS u1, {_u(seed, 'phase2')} AS u2, {_u(seed, 'type')} AS ut, {_u(seed, 'size')} AS us, {_u(seed, 'side')} AS ud FROM {source}),
tot0 AS (SELECT {lead} count(*) AS n, count(*) FILTER (valid) AS nv, count(*) FILTER (listed) AS nl,
  avg(price) FILTER (valid) AS mean, stddev_samp(price) FILTER (valid) AS std FROM iv {'GROUP BY ' + by if by else ''}),
tot1 AS (SELECT *, least(greatest(1, floor(n * {rate}::DOUBLE)), nv) AS budget FROM tot0),
tot AS (SELECT *, {first} AS first FROM tot1),
p1 AS (SELECT iv.*, mean, std, budget, first, listed AND row_number() OVER (PARTITION BY {lead} listed ORDER BY u1, obs_id) <= first AS is1
  FROM iv JOIN tot {join}),
p2 AS (SELECT *, valid AND NOT is1 AND row_number() OVER (PARTITION BY {lead} (valid AND NOT is1) ORDER BY u2, obs_id) <= budget - first AS is2 FROM p1),
p3 AS (SELECT *, CASE WHEN is1 THEN 'list_price_violation' WHEN is2 THEN {others!r}[1 + CAST(floor(ut * {len(others)}) AS INTEGER)] END AS anomaly_type FROM p2),
p4 AS (SELECT *, CASE anomaly_type {' '.join(f"WHEN '{t}' THEN {_CHANGE[t]}" for t in types)} ELSE price END AS new_price FROM p3),
p5 AS (SELECT *, new_price / price AS scale, list_price * (new_price / price) AS scaled,
  anomaly_type IN ({', '.join(repr(t) for t in I.CO_SCALED)}) AND list_price > 0 AND price > 0 AS coscale FROM p4),
inj AS (SELECT * EXCLUDE (price, list_price, currency, product_name, new_price, scale, scaled, coscale), price AS original_price, new_price AS price,
  CASE WHEN coscale THEN CASE WHEN scale < 1 THEN greatest(1, scaled) ELSE scaled END ELSE list_price END AS list_price,
  CASE WHEN anomaly_type IS NOT NULL THEN (new_price - price) / price END AS change_pct,
  CASE WHEN anomaly_type = 'currency_swap' THEN CASE WHEN currency = 'CURRENCY_5' THEN 'CURRENCY_1' ELSE 'CURRENCY_5' END ELSE currency END AS currency,
  CASE WHEN anomaly_type = 'title_collapse' AND len(product_name) > 5 THEN substr(product_name, 1, greatest(5, len(product_name) // 5)) ELSE product_name END AS product_name,
  CASE WHEN is1 THEN 1 WHEN is2 THEN 2 ELSE 0 END AS injection_phase, anomaly_type IS NOT NULL AS is_injected FROM p5)"""


_INJ_OUT = f"""SELECT obs_id, coalesce(anomaly_type, '') AS anomaly_type, injection_phase, {r6_sql('original_price', 'original_price')},
  {r6_sql('price', 'price')}, {r6_sql('list_price', 'list_price')}, {r6_sql('change_pct', 'change_pct')}, currency, product_name FROM inj"""


def injected_output(df):
    names = ["original_price", "price", "list_price", "change_pct"]
    return rounded(df, *names).select(
        "obs_id", F.coalesce("anomaly_type", F.lit("")).alias("anomaly_type"),
        F.coalesce("injection_phase", F.lit(0)).alias("injection_phase"), *names, "currency", "product_name",
    )


@query("injected_rows", with_sql(OBS, DS, inject_sql("ds", "dataset_split"), body=_INJ_OUT))
def injected_rows(spark, d):
    return injected_output(injected_base(spark, d))


@query("injected_rows_all_types", with_sql(OBS, inject_sql("obs", rate=0.3, types=I.ALL_TYPES), body=_INJ_OUT))
def injected_rows_all_types(spark, d):
    return injected_output(I.inject(observation_table(spark, d), rate=0.3, types=I.ALL_TYPES))


_cum, _case = 0.0, []
for _t, _w in I.RECORD_WEIGHTS.items():
    _cum = round(_cum + _w, 10)
    _case.append(f"WHEN ut < {_cum} THEN '{_t}'")
_REC_CHANGE = {**_CHANGE, "price_spike": "price * 2", "price_drop": "greatest(1, price * 0.3::DOUBLE)"}


@query("record_injection", with_sql(OBS, f"""ri0 AS (SELECT *, {_u('42', 'type')} AS ut, {_u('42', 'pick')} AS up, {_u('42', 'size')} AS us,
  {_u('42', 'side')} AS ud FROM obs), st AS (SELECT avg(price) AS mean, stddev_samp(price) AS std FROM obs WHERE price > 0),
ri AS (SELECT *, CASE WHEN up < 0.05 AND price > 0 THEN CASE {' '.join(_case)} END END AS anomaly_type FROM ri0, st)""",
    body=f"""SELECT obs_id, anomaly_type, {r6_sql("CASE anomaly_type " + ' '.join(f"WHEN '{t}' THEN {_REC_CHANGE[t]}" for t in I.ALL_TYPES) + " END", 'price')}
  FROM ri WHERE anomaly_type IS NOT NULL"""))
def record_injection(spark, d):
    out = I.inject_records(observations(spark, d)).filter("is_injected")
    return rounded(out, "price").select("obs_id", "anomaly_type", "price")


@query("injection_variants", with_sql(OBS, f"""v0 AS (SELECT *, {_u('42', 'size')} AS us, {_u('42', 'side')} AS ud FROM obs
  JOIN (SELECT unnest([NULL, {', '.join(repr(t) for t in I.DEFAULT_TYPES)}]) AS anomaly_type) ON price > 0)""",
    body=f"""SELECT obs_id, coalesce(anomaly_type, 'original') AS anomaly_type,
  {r6_sql("CASE anomaly_type " + ' '.join(f"WHEN '{t}' THEN {_CHANGE[t]}" for t in I.DEFAULT_TYPES) + " ELSE price END", 'price')} FROM v0"""))
def injection_variants(spark, d):
    out = I.all_variants(observations(spark, d))
    return rounded(out, "price").select("obs_id", F.coalesce("anomaly_type", F.lit("original")).alias("anomaly_type"), "price")


# ------------------------------------------------------- scored injected rows

DETECTORS = ["zscore", "iqr", "threshold", "sanity"]


def scored(injected, keys=tuple(SERIES), order=tuple(ORDER)):
    """Ungated detector scores of injected rows, one wide row each."""
    hist = X.history_arrays(injected, list(keys), list(order))
    base = X.scoring_features(X.baseline_statistics(hist))
    base = D.evaluation_features(base).withColumns({
        "zscore": D.zscore(2.9), "iqr": D.iqr(), "threshold": D.price_change(), "sanity": D.sanity(),
    })
    ordered = F.array_sort("history")
    n = F.size("history")
    q1 = F.try_element_at(ordered, F.floor(n / 4).cast("int") + 1)
    q3 = F.try_element_at(ordered, F.floor(n * 3 / 4).cast("int") + 1)
    p = F.col("checked_price")
    return base.withColumns({
        "abs_z": F.when(F.col("observation_count") >= 3, F.abs("price_zscore")),
        "iqr_ratio": F.when((n >= 4) & (q3 > q1), F.greatest(q1 - p, p - q3) / (q3 - q1)),
        "abs_change": F.abs("price_change_pct"),
        "truth": F.col("is_injected"),
    })


def injected_base(spark, d):
    """Injected rows of both splits, stored once."""
    return stored(spark, d, "injected", lambda s, p: I.inject(
        with_split(observation_table(s, p)), by=["dataset_split"]))


# What an injection reads and what readers of scored rows use: names, arrays and statistics behind the scores are not kept.
INJECTION_COLUMNS = ["obs_id", *SERIES, "seen_at", "country", "segment", "currency", "price", "list_price"]
SCORED_COLUMNS = [
    "obs_id", *SERIES, "country", "segment", "dataset_split", "is_injected", "truth", "anomaly_type", "original_price", "price",
    "list_price", "previous_price", "observation_count", "rolling_mean", "rolling_std", "rolling_min", "rolling_max",
    *DETECTORS, "abs_z", "iqr_ratio", "abs_change",
]


def scored_base(spark, d):
    """Scored injected rows, stored once; their injection is not written for this alone."""
    def build(s, p):
        if is_stored(s, p, "injected"):
            injected = injected_base(s, p)
        else:
            injected = I.inject(with_split(observation_table(s, p).select(*INJECTION_COLUMNS)), by=["dataset_split"])
        used = [*INJECTION_COLUMNS, "dataset_split", "is_injected", "anomaly_type", "original_price"]
        return scored(injected.select(*used)).select(*SCORED_COLUMNS)

    return stored(spark, d, "scored", build)


def long_predictions(wide, keep):
    """One row per detector."""
    entries = F.array(*[
        F.struct(F.lit(n).alias("detector"), F.col(f"{n}.flagged").alias("predicted"),
                 F.col(f"{n}.score").alias("score"), F.col(f"{n}.insufficient").alias("insufficient"))
        for n in DETECTORS
    ])
    return wide.select(*keep, F.explode(entries).alias("_d")).select(*keep, "_d.*")


def scored_sql(source: str = "inj", keys: str = "product_id, competitor_id") -> str:
    w = f"PARTITION BY {keys} ORDER BY seen_at, obs_id"
    past = f"{w} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING"
    return f"""sw AS (SELECT *, coalesce(price, 0.0) AS p, lag(price) OVER ({w}) AS prev, count(price) OVER ({past}) AS n,
  avg(price) OVER ({past}) AS m, stddev_samp(price) OVER ({past}) AS sd,
  list_sort(coalesce(list(price) FILTER (price IS NOT NULL) OVER ({past}), []::DOUBLE[])) AS h FROM {source}),
sx AS (SELECT *, CASE WHEN n >= 3 AND sd > 0 THEN abs((p - m) / sd) END AS abs_z, h[len(h) // 4 + 1] AS q1, h[(3 * len(h)) // 4 + 1] AS q3,
  abs(CASE WHEN prev <> p AND prev > 0 THEN (p - prev) / prev END) AS abs_change, CASE WHEN list_price > 0 THEN p / list_price ELSE 1 END AS ratio,
  p > 0 AND currency IS NOT NULL AS ok, coalesce(currency <> replace(country, 'COUNTRY', 'CURRENCY'), false) AS mismatch FROM sw),
sy AS (SELECT *, CASE WHEN n >= 4 AND q3 > q1 THEN greatest(q1 - p, p - q3) / (q3 - q1) END AS iqr_ratio, q3 - q1 AS spread,
  greatest(q1 - 1.5 * (q3 - q1) - p, p - (q3 + 1.5 * (q3 - q1))) AS dist FROM sx),
scored AS (SELECT *, is_injected AS truth, coalesce(abs_z > 2.9, false) AS zscore, {cap('abs_z', 5.8)} AS zscore_s,
  coalesce(n >= 4 AND dist > 0, false) AS iqr, CASE WHEN n >= 4 AND dist > 0 THEN CASE WHEN spread > 0 THEN least(dist / (spread * 2), 1) ELSE 0.5 END ELSE 0 END AS iqr_s,
  coalesce(abs_change > 0.2, false) AS threshold, {cap('abs_change', 0.4)} AS threshold_s,
  NOT ok OR ratio > 1 OR mismatch AS sanity, CASE WHEN NOT ok THEN 1.0 WHEN mismatch THEN 0.95 WHEN ratio > 1 THEN 0.9 ELSE 0 END AS sanity_s FROM sy),
preds AS (""" + " UNION ALL ".join(
        f"SELECT * EXCLUDE (zscore, iqr, threshold, sanity, zscore_s, iqr_s, threshold_s, sanity_s), '{n}' AS detector, {n} AS predicted, {n}_s AS score, "
        + {"zscore": "n < 3", "iqr": "n < 4"}.get(n, "false") + " AS insufficient FROM scored"
        for n in DETECTORS) + ")"


SCORED = (OBS, DS, inject_sql("ds", "dataset_split"), scored_sql())


def conf_sql(pred: str = "predicted", truth: str = "truth") -> str:
    return (f"count(*) FILTER ({pred} AND {truth}) AS tp, count(*) FILTER ({pred} AND NOT {truth}) AS fp, "
            f"count(*) FILTER (NOT {pred} AND {truth}) AS fn, count(*) FILTER (NOT {pred} AND NOT {truth}) AS tn")


_RATE = {
    "accuracy": "coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0)",
    "precision": "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)",
    "tnr": "coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)",
    "g_mean": "sqrt(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) * coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0))",
    "fpr": "coalesce(fp / nullif(tn + fp, 0)::DOUBLE, 0)",
    "fnr": "coalesce(fn / nullif(tp + fn, 0)::DOUBLE, 0)",
}


def rates_sql(*names: str) -> str:
    return ", ".join(r6_sql(_RATE[n], n) for n in (names or M.METRICS))


def raw_rates(*names: str) -> str:
    return ", ".join(f"{_RATE[n]} AS {n}" for n in (names or M.METRICS))


@query("detector_metrics", with_sql(*SCORED, f"c AS (SELECT dataset_split, detector, {conf_sql()} FROM preds GROUP BY ALL)",
    body=f"SELECT dataset_split, detector, tp, fp, fn, tn, {rates_sql()}, tp + fp + fn + tn AS n_rows, tp + fn AS n_injected, tp + fp AS n_predicted FROM c"))
def detector_metrics(spark, d):
    preds = long_predictions(scored_base(spark, d), ["dataset_split", "truth"])
    out = M.detector_metrics(preds, ["dataset_split", "detector"]).drop("fpr", "fnr")
    return rounded(out, *M.METRICS)


@query("binary_metrics_by_country", with_sql(*SCORED, f"c AS (SELECT country, detector, {conf_sql()} FROM preds GROUP BY ALL)",
    body=f"SELECT country, detector, tp, fp, fn, tn, {rates_sql(*_RATE)} FROM c"))
def binary_metrics_by_country(spark, d):
    preds = long_predictions(scored_base(spark, d), ["country", "truth"])
    out = M.with_rates(preds.groupBy("country", "detector").agg(*M.confusion()))
    return rounded(out, *_RATE)


@query("joined_truth_metrics", with_sql(*SCORED, f"c AS (SELECT detector, {conf_sql()} FROM preds GROUP BY ALL)",
    body=f"SELECT detector, tp, fp, fn, tn, {rates_sql('f1', 'g_mean')} FROM c"))
def joined_truth_metrics(spark, d):
    """Predictions joined many to one to the injected rows on their four-column key."""
    injected = injected_base(spark, d)
    run = {"run_id": F.lit("r1"), "candidate_id": F.lit("default")}
    keys = ["run_id", "candidate_id", "dataset_split", "obs_id"]
    truth = injected.withColumns(run).select(*keys, F.col("is_injected").alias("truth"))
    preds = long_predictions(scored_base(spark, d).withColumns(run), keys).select(*keys, "detector", "predicted")
    out = M.with_rates(M.join_truth(preds, truth, keys).groupBy("detector").agg(*M.confusion()))
    return rounded(out, "f1", "g_mean").select("detector", "tp", "fp", "fn", "tn", "f1", "g_mean")


@query("aligned_rows_without_predictions", with_sql(*SCORED, f"""al AS (SELECT dataset_split, truth, zscore AND n >= 5 AS predicted FROM scored),
c AS (SELECT dataset_split, {conf_sql()} FROM al GROUP BY ALL)""", body=f"SELECT dataset_split, tp, fp, fn, tn, {rates_sql('recall')} FROM c"))
def aligned_rows_without_predictions(spark, d):
    """Right join: a row the detector never saw counts as unflagged."""
    wide = scored_base(spark, d)
    truth = wide.select("obs_id", "dataset_split", "truth")
    seen = wide.filter(F.col("observation_count") >= 5).select("obs_id", F.col("zscore.flagged").alias("predicted"))
    out = M.with_rates(M.join_truth(seen, truth, ["obs_id"], "right").groupBy("dataset_split").agg(*M.confusion()))
    return rounded(out, "recall").select("dataset_split", "tp", "fp", "fn", "tn", "recall")


@query("detection_rate_by_type", with_sql(*SCORED, body=f"""SELECT dataset_split, detector, anomaly_type, count(*) AS injected_count,
  count(*) FILTER (predicted) AS detected_count, {r6_sql('count(*) FILTER (predicted) / count(*)', 'detection_rate')}
  FROM preds WHERE anomaly_type IS NOT NULL GROUP BY ALL"""))
def detection_rate_by_type(spark, d):
    preds = long_predictions(scored_base(spark, d), ["dataset_split", "anomaly_type"])
    return rounded(M.rate_by_type(preds, ["dataset_split", "detector"]), "detection_rate")


_TYPES = ", ".join(repr(t) for t in I.DEFAULT_TYPES)


@query("one_vs_rest_type_metrics", with_sql(*SCORED, f"""c AS (SELECT dataset_split, detector, anomaly_case,
  {conf_sql(truth="coalesce(anomaly_type = anomaly_case, false)")} FROM preds, (SELECT unnest([{_TYPES}]) AS anomaly_case) GROUP BY ALL)""",
    body=f"SELECT dataset_split, detector, anomaly_case, tp, fp, fn, tn, {rates_sql('precision', 'recall', 'f1', 'g_mean')} FROM c"))
def one_vs_rest_type_metrics(spark, d):
    preds = long_predictions(scored_base(spark, d), ["dataset_split", "anomaly_type"])
    out = rounded(M.one_vs_rest(preds, ["dataset_split", "detector"]), "precision", "recall", "f1", "g_mean")
    return out.select("dataset_split", "detector", "anomaly_case", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "g_mean")


COMB = f"""pc AS (SELECT * FROM preds UNION ALL SELECT * REPLACE ('combined' AS dataset_split) FROM preds),
cc AS (SELECT dataset_split, detector, {conf_sql()} FROM pc GROUP BY ALL), cr AS (SELECT *, {raw_rates()} FROM cc),
cw AS (SELECT detector, sum(CASE dataset_split WHEN 'new_prices' THEN 0.7 WHEN 'new_products' THEN 0.3 ELSE 0 END * f1) AS wf1,
  sum(CASE dataset_split WHEN 'new_prices' THEN 0.7 WHEN 'new_products' THEN 0.3 ELSE 0 END * g_mean) AS wg FROM cr GROUP BY detector)"""


@query("combined_case_metrics", with_sql(*SCORED, COMB, body=f"""SELECT dataset_split, detector, tp, fp, fn, tn, {r6_sql('precision', 'precision')},
  {r6_sql('recall', 'recall')}, {r6_sql("CASE WHEN dataset_split = 'combined' THEN wf1 ELSE f1 END", 'f1')},
  {r6_sql("CASE WHEN dataset_split = 'combined' THEN wg ELSE g_mean END", 'g_mean')} FROM cr JOIN cw USING (detector)"""))
def combined_case_metrics(spark, d):
    """Both splits and their pool; the pool's F1 and G are 0.7 / 0.3 means, its other columns pooled."""
    preds = M.add_combined(long_predictions(scored_base(spark, d), ["dataset_split", "truth"]))
    metrics = M.with_rates(preds.groupBy("dataset_split", "detector").agg(*M.confusion()))
    out = M.weighted_combined(metrics, ["detector"])
    names = ["precision", "recall", "f1", "g_mean"]
    return rounded(out, *names).select("dataset_split", "detector", "tp", "fp", "fn", "tn", *names)


@query("score_cut_evaluation", with_sql(*SCORED, f"""c AS (SELECT detector, {conf_sql("(predicted AND score >= 0.5)")},
  count(*) FILTER (predicted AND truth) AS detected_any FROM preds GROUP BY ALL)""",
    body=f"SELECT detector, tp, fp, fn, tn, detected_any, {rates_sql('precision', 'recall', 'f1')} FROM c"))
def score_cut_evaluation(spark, d):
    """Flagged with a score of at least one half; the rate by type ignores the cut."""
    preds = long_predictions(scored_base(spark, d), ["truth"])
    cut = F.col("predicted") & (F.col("score") >= 0.5)
    out = M.with_rates(preds.groupBy("detector").agg(
        *M.confusion(cut), F.count_if(F.col("predicted") & F.col("truth")).alias("detected_any")
    ))
    return rounded(out, "precision", "recall", "f1").select(
        "detector", "tp", "fp", "fn", "tn", "detected_any", "precision", "recall", "f1"
    )


_CUTS = [0.13, 0.27, 0.41, 0.53, 0.67, 0.83]


@query("threshold_sweep", with_sql(*SCORED, f"""c AS (SELECT dataset_split, detector, t AS threshold, {conf_sql("(score > t)")}
  FROM preds, (SELECT unnest({_CUTS}::DOUBLE[]) AS t) GROUP BY ALL)""",
    body=f"SELECT dataset_split, detector, threshold, tp, fp, fn, tn, {rates_sql()} FROM c"))
def threshold_sweep(spark, d):
    preds = long_predictions(scored_base(spark, d), ["dataset_split", "truth"])
    out = M.threshold_sweep(preds, ["dataset_split", "detector"], "score", _CUTS).drop("fpr", "fnr")
    return rounded(out, *M.METRICS)


_REFIT = {"t1": 1.0, "t15": 1.5, "t2": 2.0}


@query("threshold_sweep_refit", with_sql(EV, fold_sql("user_id, cand", "event_id",
    "SELECT ev.*, cand, t FROM ev, (SELECT unnest([1.0, 1.5, 2.0]::DOUBLE[]) AS t, unnest(['t1', 't15', 't2']) AS cand)",
    "n >= 3 AND abs(z) > t", "0.0", "NULL"),
    body="SELECT cand, count(*) AS n_rows, count(*) FILTER (flagged) AS n_flagged, CAST(sum(n) AS BIGINT) AS depth_sum FROM walk WHERE rn > 0 GROUP BY cand",
    recursive=True))
def threshold_sweep_refit(spark, d):
    """The fold run again per threshold, since each threshold admits other prices."""
    events = event_observations(spark, d).withColumn("cand", F.explode(F.array(*[F.lit(c) for c in _REFIT])))
    rules = {c: R.zscore_rule(t) for c, t in _REFIT.items()}
    out = G.gated_fold(events, ["user_id", "cand"], ["seen_at", "event_id"], rules, keep=["cand"])
    return out.groupBy("cand").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("flagged").alias("n_flagged"),
        F.sum("observation_count").alias("depth_sum"),
    )


SEEDS = [1000, 1017, 1034]
TRIALS = (OBS, f"sd AS (SELECT obs.*, CAST(s AS VARCHAR) AS seed FROM obs, (SELECT unnest({SEEDS}) AS s))",
          inject_sql("sd", "seed", seed="seed"), scored_sql(keys="seed, product_id, competitor_id"),
          f"tc AS (SELECT seed, detector, {conf_sql()} FROM preds GROUP BY ALL)",
          f"tr AS (SELECT *, {raw_rates()} FROM tc)")


def trial_metrics(spark, d):
    """Detector metrics per seed: the rows are injected and scored once per seed."""
    needed = [*SERIES, *ORDER, "price", "list_price", "currency", "country"]
    obs = observation_table(spark, d).select(*needed).withColumn("seed", F.explode(F.array(*[F.lit(str(s)) for s in SEEDS])))
    wide = scored(I.inject(obs, by=["seed"], seed=F.col("seed")), keys=["seed", *SERIES])
    return M.detector_metrics(long_predictions(wide, ["seed", "truth"]), ["seed", "detector"])


@query("multi_seed_trials", with_sql(*TRIALS, body=f"""SELECT detector, count(*) AS attempts, {', '.join(
    r6_sql(f'avg({m})', f'{m}_mean') + ', ' + r6_sql(f'stddev_pop({m})', f'{m}_std') for m in M.METRICS)} FROM tr GROUP BY detector HAVING count(*) >= 3"""))
def multi_seed_trials(spark, d):
    """Mean and population deviation of each metric over seeds, where at least three succeeded."""
    from tidemark.operators.reports import trial_averages

    out = trial_averages(trial_metrics(spark, d), ["detector"], M.METRICS, minimum=3)
    return rounded(out, *[f"{m}_{k}" for m in M.METRICS for k in ("mean", "std")])


@query("evaluation_run_round_trip", with_sql(*SCORED, f"""c AS (SELECT dataset_split, detector, {conf_sql()} FROM preds GROUP BY ALL)""",
    body="SELECT dataset_split, detector, tp, (SELECT count(*) FROM preds) AS prediction_rows, 'run-1' AS run_id FROM c"))
def evaluation_run_round_trip(spark, d):
    """Row tables, metric tables and metadata written as one run and read back."""
    from tidemark.session import scratch_path
    from tidemark.sources import artifacts as A

    wide = scored_base(spark, d)
    preds = long_predictions(wide, ["obs_id", "dataset_split", "truth"]).withColumnRenamed("detector", "detector_name")
    injected = wide.select("dataset_split", "product_id", "competitor_id", "original_price",
                           F.col("price").alias("evaluated_price"), "is_injected", "anomaly_type")
    metrics = M.detector_metrics(preds, ["dataset_split", "detector_name"])
    types = M.rate_by_type(long_predictions(wide, ["dataset_split", "anomaly_type"]), ["dataset_split", "detector"])
    summary = metrics.groupBy("dataset_split").agg(F.max_by("detector_name", "f1").alias("best_detector"))
    paths = A.write_evaluation_run(scratch_path(spark, "run"), injected, preds, metrics, types, summary, {"run_id": "run-1"})
    back = spark.read.option("header", "true").csv(paths["detector_metrics"])
    rows = spark.read.parquet(paths["predictions"]).agg(F.count(F.lit(1)).alias("prediction_rows"))
    meta = spark.read.json(paths["run_metadata"]).select("run_id")
    return back.select("dataset_split", F.col("detector_name").alias("detector"), F.col("tp").cast("long").alias("tp")) \
        .join(F.broadcast(rows)).join(F.broadcast(meta))
