"""Detectors over ungated windows and over the gated baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EV, OBS, ORDER, SERIES, event_observations, observations, query, r6, r6_sql, rounded, with_sql,
)
from tidemark.catalog.features import HIST, ROBUST, TALK, W, talk_features
from tidemark.functions import scalar as S
from tidemark.operators import detectors as D
from tidemark.operators import features as X
from tidemark.operators import fold as G
from tidemark.operators import rules as R

# ---------------------------------------------------------------- ungated


def windowed(spark, d):
    """Observations with history, baseline statistics and scoring features."""
    return X.scoring_features(
        X.baseline_statistics(X.history_arrays(observations(spark, d), SERIES, ORDER))
    )


def unpack(df, column, *keep):
    out = df.select(*keep, F.col(f"{column}.*"))
    return rounded(out.withColumn("types", F.array_join("types", ",")), "score")


def sev_dev(value: str, t: float) -> str:
    return (f"CASE WHEN {value} > {t * 2} THEN 'critical' WHEN {value} > {t * 1.5} THEN 'high' "
            f"WHEN {value} > {t} THEN 'medium' END")


def cap(value: str, top: float | str) -> str:
    """Capped share of ``top``, 0 for a missing value (least() would skip the null)."""
    return f"coalesce(CASE WHEN {value} >= {top} THEN 1.0 ELSE {value} / {top} END, 0)"


def result_sql(z: str, t: float, kind: str, short: str) -> str:
    return f"""coalesce({z} > {t}, false) AS flagged, {r6_sql(cap(f'({z})', t * 2), 'score')},
  {sev_dev(z, t)} AS severity, CASE WHEN coalesce({z} > {t}, false) THEN '{kind}' ELSE '' END AS types, {short} AS insufficient"""


ZWIN = """zw AS (SELECT *, CASE WHEN observation_count >= 3 AND rolling_std > 0
  THEN abs((coalesce(price, 0.0) - rolling_mean) / rolling_std) END AS z FROM robust)"""


@query("detect_zscore", with_sql(OBS, ROBUST, ZWIN, body=f"""SELECT obs_id,
  {result_sql('z', 2.9, 'price_zscore', 'observation_count < 3')} FROM zw"""))
def detect_zscore(spark, d):
    # Many series put z at exactly 3, where the last bit of the mean would decide.
    return unpack(windowed(spark, d).withColumn("r", D.zscore(2.9)), "r", "obs_id")


MODZ = """mz0 AS (SELECT obs_id, len(history) AS n, coalesce(price, 0.0) AS p, history, list_median(history) AS c FROM hist),
mz1 AS (SELECT obs_id, n, abs(p - c) AS gap,
  nullif(1.4826 * list_mad(history), 0) AS md,
  nullif(list_median([list_median([abs(x - y) FOR y IN history]) FOR x IN history]) * CASE WHEN n % 2 = 1 THEN n / (n - 0.9) ELSE 1 END, 0) AS sn
  FROM mz0)"""
_MODES = {
    "mad": "gap / md",
    "sn": "gap / sn",
    "weighted": "0.5 * (gap / md) + 0.5 * (gap / sn)",
    "max": "CASE WHEN md IS NOT NULL AND sn IS NOT NULL THEN greatest(gap / md, gap / sn) END",
    "mean": "0.5 * (gap / md + gap / sn)",
}


def _modified(mode: str) -> None:
    @query(f"detect_modified_{mode}", with_sql(OBS, HIST, MODZ,
        f"mz AS (SELECT obs_id, n, CASE WHEN n >= 3 THEN {_MODES[mode]} END AS z FROM mz1)",
        body=f"SELECT obs_id, {result_sql('z', 2.0, 'price_zscore', 'n < 3')} FROM mz"))
    def run(spark, d):
        hist = X.history_arrays(observations(spark, d), SERIES, ORDER)
        return unpack(hist.withColumn("r", D.modified_zscore(mode)), "r", "obs_id")


for _mode in _MODES:
    _modified(_mode)

IQR = """iq0 AS (SELECT obs_id, coalesce(price, 0.0) AS p, len(history) AS n, list_sort(history) AS s FROM hist),
iq1 AS (SELECT *, s[n // 4 + 1] AS q1, s[(3 * n) // 4 + 1] AS q3 FROM iq0),
iq2 AS (SELECT *, q3 - q1 AS spread, q1 - 1.5 * (q3 - q1) - p AS below, p - (q3 + 1.5 * (q3 - q1)) AS above FROM iq1),
iq AS (SELECT *, CASE WHEN n >= 4 AND below > 0 THEN below WHEN n >= 4 AND above > 0 THEN above END AS distance FROM iq2)"""


@query("detect_iqr", with_sql(OBS, HIST, IQR, body=f"""SELECT obs_id, distance IS NOT NULL AS flagged,
  {r6_sql('CASE WHEN distance IS NULL THEN 0 WHEN spread > 0 THEN least(distance / (spread * 2), 1) ELSE 0.5 END', 'score')},
  CASE WHEN distance IS NOT NULL AND spread > 0 THEN CASE WHEN distance / spread > 3 THEN 'critical' WHEN distance / spread > 2 THEN 'high' ELSE 'medium' END END AS severity,
  CASE WHEN distance IS NOT NULL THEN 'price_iqr' ELSE '' END AS types, n < 4 AS insufficient FROM iq"""))
def detect_iqr(spark, d):
    hist = X.history_arrays(observations(spark, d), SERIES, ORDER)
    return unpack(hist.withColumn("r", D.iqr()), "r", "obs_id")


CHG = f"""ch AS (SELECT obs_id, abs(CASE WHEN prev <> p AND prev > 0 THEN (p - prev) / prev END) AS c FROM
  (SELECT obs_id, coalesce(price, 0.0) AS p, lag(price) OVER ({W}) AS prev FROM obs))"""


@query("detect_price_change", with_sql(OBS, CHG, body=f"""SELECT obs_id, coalesce(c > 0.2, false) AS flagged,
  {r6_sql(cap('c', 0.4), 'score')},
  CASE WHEN c > 0.2 THEN CASE WHEN c > 0.2::DOUBLE * 3 THEN 'critical' WHEN c > 0.2::DOUBLE * 2 THEN 'high' ELSE 'medium' END END AS severity,
  CASE WHEN c > 0.2 THEN 'price_change' ELSE '' END AS types, false AS insufficient FROM ch"""))
def detect_price_change(spark, d):
    before = X.with_previous(observations(spark, d), SERIES, ORDER, ["price"], X.micros())
    price, last = F.coalesce(F.col("price"), F.lit(0.0)), F.col("previous_price")
    change = F.when((last != price) & (last > 0), (price - last) / last)
    return unpack(before.withColumn("price_change_pct", change).withColumn("r", D.price_change()), "r", "obs_id")


SANITY = """sa0 AS (SELECT *, coalesce(price, 0.0) AS p FROM obs),
sa1 AS (SELECT *, CASE WHEN list_price > 0 THEN p / list_price ELSE 1 END AS ratio, p > 0 AND currency IS NOT NULL AS ok,
  coalesce(currency <> replace(country, 'COUNTRY', 'CURRENCY'), false) AS mismatch FROM sa0),
sanity AS (SELECT obs_id, NOT ok OR ratio > 1 OR mismatch AS flagged,
  CASE WHEN NOT ok THEN 1.0 WHEN mismatch THEN 0.95 WHEN ratio > 1 THEN 0.9 ELSE 0 END AS score,
  CASE WHEN NOT ok THEN 'critical' WHEN mismatch OR ratio > 1 THEN 'high' END AS severity,
  concat_ws(',', CASE WHEN NOT ok THEN 'data_quality' END, CASE WHEN ratio > 1 THEN 'price_sanity' END,
    CASE WHEN mismatch THEN 'currency_mismatch' END) AS types FROM sa1)"""


@query("detect_sanity", with_sql(OBS, SANITY, body=f"""SELECT obs_id, flagged, {r6_sql('score', 'score')}, severity, types,
  false AS insufficient FROM sanity"""))
def detect_sanity(spark, d):
    checked = D.evaluation_features(observations(spark, d))
    return unpack(checked.withColumn("r", D.sanity()), "r", "obs_id")


@query("detect_sanity_records", with_sql(OBS, """sr0 AS (SELECT *, coalesce(price, 0.0) AS p, price IS NULL OR currency IS NULL AS bad,
  coalesce(currency <> replace(country, 'COUNTRY', 'CURRENCY'), false) AS mismatch FROM obs),
sr AS (SELECT *, CASE WHEN list_price > 0 THEN p / list_price ELSE 1 END AS ratio FROM sr0)""",
    body=f"""SELECT obs_id, bad OR mismatch OR ratio > 1 OR ratio < 0.1 AS flagged,
  {r6_sql("CASE WHEN bad THEN 1 WHEN mismatch THEN 0.95 WHEN ratio > 1 THEN 0.9 WHEN ratio < 0.1 OR p = 0 THEN 0.8 ELSE 0 END", 'score')},
  CASE WHEN bad THEN 'critical' WHEN mismatch OR ratio > 1 THEN 'high' WHEN ratio < 0.1 THEN 'medium' END AS severity,
  concat_ws(',', CASE WHEN bad THEN 'data_quality' END, CASE WHEN ratio > 1 OR ratio < 0.1 THEN 'price_sanity' END,
    CASE WHEN mismatch THEN 'currency_mismatch' END) AS types, false AS insufficient FROM sr"""))
def detect_sanity_records(spark, d):
    """The record variant, with list-price errors and the extreme-discount rule."""
    checked = D.numeric_features(observations(spark, d))
    return unpack(checked.withColumn("r", D.sanity()), "r", "obs_id")


INV = TALK + """,
inv AS (SELECT conv_id, turn, a, title, previous_title, price, previous_price, turn % 2 = 0 AS dk,
  median(price) OVER (PARTITION BY turn) AS med, contains(lower(title), 'tion') AND turn % 5 = 0 AS fake FROM coherent),
inv1 AS (SELECT *, coalesce(len(title) > 0 AND len(previous_title) > 0 AND len(title) / len(previous_title)::DOUBLE < 0.2
    AND abs(price - previous_price) > 0.01, false) AS collapsed, coalesce(fake, false) AS placeholder, dk AND turn % 4 = 0 AS mismatch,
  coalesce(CASE WHEN med > 0 THEN price / med END > 10 OR CASE WHEN med > 0 THEN price / med END < 0.1, false) AS extreme FROM inv)"""


@query("detect_invariants", with_sql(INV, body=f"""SELECT conv_id, turn, collapsed OR placeholder OR mismatch OR extreme AS flagged,
  {r6_sql('CASE WHEN mismatch THEN 0.95 WHEN collapsed THEN 0.9 WHEN extreme THEN 0.85 WHEN placeholder THEN 0.6 ELSE 0 END', 'score')},
  CASE WHEN collapsed OR mismatch THEN 'critical' WHEN extreme THEN 'high' WHEN placeholder THEN 'medium' END AS severity,
  concat_ws(',', CASE WHEN collapsed THEN 'title_collapse' END, CASE WHEN placeholder THEN 'placeholder_image' END,
    CASE WHEN mismatch THEN 'currency_mismatch' END, CASE WHEN extreme THEN 'extreme_price' END) AS types, false AS insufficient FROM inv1"""))
def detect_invariants(spark, d):
    from tidemark.plans.skew import exact_median

    talk = talk_features(spark, d)
    medians = exact_median(talk, ["turn"], "price", "category_median_price")
    fake = F.lower("title").contains("tion") & (F.col("turn") % 5 == 0)
    rows = talk.join(medians, "turn").withColumns({
        "image_urls": F.array(F.when(fake, "http://x/No-Image.png").otherwise("http://x/1.png"), F.lit(None)),
        "country": F.when(F.col("turn") % 2 == 0, "DK").otherwise("XX"),
        "currency": F.when(F.col("turn") % 4 == 0, "SEK").otherwise("DKK"),
    })
    return unpack(rows.withColumn("r", D.invariants()), "r", "conv_id", "turn")


ENS = f"""en AS (SELECT zw.obs_id, coalesce(z > 2.9, false) AS f1, {cap('z', 5.8)} AS s1, {sev_dev('z', 2.9)} AS v1,
  distance IS NOT NULL AS f2, CASE WHEN distance IS NULL THEN 0 WHEN spread > 0 THEN least(distance / (spread * 2), 1) ELSE 0.5 END AS s2,
  CASE WHEN distance IS NOT NULL AND spread > 0 THEN CASE WHEN distance / spread > 3 THEN 'critical' WHEN distance / spread > 2 THEN 'high' ELSE 'medium' END END AS v2,
  coalesce(c > 0.2, false) AS f3, {cap('c', 0.4)} AS s3,
  CASE WHEN c > 0.2 THEN CASE WHEN c > 0.2::DOUBLE * 3 THEN 'critical' WHEN c > 0.2::DOUBLE * 2 THEN 'high' ELSE 'medium' END END AS v3,
  sanity.flagged AS f4, sanity.score AS s4, sanity.severity AS v4, sanity.types AS t4
  FROM zw JOIN iq USING (obs_id) JOIN ch USING (obs_id) JOIN sanity USING (obs_id))"""
RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("detect_ensemble", with_sql(OBS, ROBUST, ZWIN, HIST, IQR, CHG, SANITY, ENS, body=f"""SELECT obs_id,
  f1 OR f2 OR f3 OR f4 AS flagged, {r6_sql('greatest(s1, s2, s3, s4)', 'score')},
  [NULL, 'low', 'medium', 'high', 'critical'][1 + greatest({', '.join(RANK.format(v) for v in ('v1', 'v2', 'v3', 'v4'))})] AS severity,
  coalesce(array_to_string(list_sort(list_filter([CASE WHEN f1 THEN 'price_zscore' END, CASE WHEN f2 THEN 'price_iqr' END,
    CASE WHEN f3 THEN 'price_change' END, CASE WHEN t4 LIKE '%data_quality%' THEN 'data_quality' END,
    CASE WHEN t4 LIKE '%price_sanity%' THEN 'price_sanity' END, CASE WHEN t4 LIKE '%mismatch%' THEN 'currency_mismatch' END],
    lambda x: x IS NOT NULL)), ','), '') AS types,
  concat_ws(',', CASE WHEN f1 THEN 'zscore' END, CASE WHEN f2 THEN 'iqr' END, CASE WHEN f3 THEN 'threshold' END,
    CASE WHEN f4 THEN 'sanity' END) AS triggered FROM en"""))
def detect_ensemble(spark, d):
    rows = D.evaluation_features(windowed(spark, d)).withColumns({
        "zscore": D.zscore(2.9), "iqr": D.iqr(), "threshold": D.price_change(), "sanity": D.sanity(),
    })
    members = {n: F.col(n) for n in ("zscore", "iqr", "threshold", "sanity")}
    out = unpack(rows.withColumn("r", D.ensemble(members)), "r", "obs_id").drop("insufficient")
    return out.withColumn("triggered", F.array_join("triggered", ","))


# ------------------------------------------------------------------ gated

FOLD_COLUMNS = ["observation_count", "rolling_mean", "price_zscore", "price_change_pct",
                "consecutive_unchanged", "flagged", "score", "severity"]


def fold_sql(key: str, ident: str, source: str, flag: str, score: str, severity: str, seed: str = "[]::DOUBLE[]",
             last: str = "NULL::DOUBLE", extra: str = "", persist: bool = False) -> str:
    """Recursive CTE of the gated fold: one round per position in the series.

    ``flag``, ``score`` and ``severity`` may use p, h (history), n, z, c (change) and row columns.
    """
    hours = "(epoch_us(r.seen_at) - w.held_at) / 3600000000.0"
    match = "(w.held IS NOT NULL AND abs(w.held - r.p) <= w.held * 0.02)"
    accept = f"({match} AND {hours} >= 24)" if persist else "false"
    return f"""src AS ({source}),
ord AS (SELECT *, coalesce(price, 0.0) AS p, row_number() OVER (PARTITION BY {key} ORDER BY seen_at, {ident}) AS rn FROM src),
walk AS (
  SELECT {key}, NULL::{'BIGINT' if ident == 'event_id' else 'VARCHAR'} AS ident, 0::BIGINT AS rn, {seed} AS h, {last} AS last, 0::BIGINT AS unchanged,
    NULL::DOUBLE AS held, NULL::BIGINT AS held_at, false AS flagged, 0.0::DOUBLE AS score, NULL::VARCHAR AS severity,
    0::BIGINT AS n, NULL::DOUBLE AS m, NULL::DOUBLE AS z, NULL::DOUBLE AS c, 0::BIGINT AS u0, false AS accepted
  FROM (SELECT DISTINCT {key} {extra} FROM ord)
  UNION ALL
  SELECT {key}, ident, rn,
    CASE WHEN fl OR (NOT acc AND last = p) THEN h ELSE list_append(h, p)[-30:] END,
    CASE WHEN fl THEN last ELSE p END,
    CASE WHEN fl THEN unchanged WHEN NOT acc AND last = p THEN unchanged + 1 ELSE 0 END,
    CASE WHEN {'false' if persist else 'true'} THEN NULL WHEN acc THEN NULL WHEN fl AND NOT matched THEN p WHEN matched THEN held END,
    CASE WHEN {'false' if persist else 'true'} THEN NULL WHEN acc THEN NULL WHEN fl AND NOT matched THEN now_us WHEN matched THEN held_at END,
    fl, score, severity, n, m, z, c, unchanged, acc
  FROM (SELECT *, CASE WHEN acc THEN false ELSE coalesce({flag}, false) END AS fl, {score} AS score, {severity} AS severity FROM (
    SELECT *, len(h) AS n, list_avg(h) AS m,
      CASE WHEN list_min(h) < list_max(h) THEN (p - list_avg(h)) / list_stddev_samp(h) END AS z,
      CASE WHEN last <> p AND last > 0 THEN (p - last) / last END AS c FROM (
      SELECT r.*, epoch_us(r.seen_at) AS now_us, r.{ident} AS ident, w.unchanged, w.held, w.held_at, {match} AS matched, {accept} AS acc,
        CASE WHEN {accept} THEN list_append(w.h, r.p)[-30:] ELSE w.h END AS h,
        CASE WHEN {accept} THEN r.p ELSE w.last END AS last
      FROM walk w JOIN ord r ON r.rn = w.rn + 1 AND {' AND '.join(f'r.{k.strip()} = w.{k.strip()}' for k in key.split(','))})))
)"""


def fold_sql_no_double_append(sql: str) -> str:
    """With acceptance the price is already in h when the row is scored."""
    return sql.replace(
        "CASE WHEN fl OR (NOT acc AND last = p) THEN h ELSE list_append(h, p)[-30:] END,",
        "CASE WHEN fl OR acc OR last = p THEN h ELSE list_append(h, p)[-30:] END,",
    ).replace(
        "CASE WHEN fl THEN unchanged WHEN NOT acc AND last = p THEN unchanged + 1 ELSE 0 END,",
        "CASE WHEN acc THEN 0 WHEN fl THEN unchanged WHEN last = p THEN unchanged + 1 ELSE 0 END,",
    ).replace("z, c, unchanged, acc\n", "z, c, CASE WHEN acc THEN 0 ELSE unchanged END, acc\n")


Z_FLAG = "n >= 3 AND abs(z) > {t}"
Z_SCORE = "CASE WHEN n >= 3 THEN {capped} ELSE 0 END"
Z_SEV = "CASE WHEN n >= 3 THEN " + "{s}" + " END"


def z_parts(t: float) -> tuple[str, str, str]:
    return Z_FLAG.format(t=t), Z_SCORE.format(capped=cap("abs(z)", t * 2)), Z_SEV.format(s=sev_dev("abs(z)", t))


def fold_select(ident: str, more: str = "") -> str:
    return f"""SELECT ident AS {ident}, n AS observation_count, {r6_sql('m', 'rolling_mean')}, {r6_sql('z', 'price_zscore')},
  {r6_sql('c', 'price_change_pct')}, u0 AS consecutive_unchanged, flagged, {r6_sql('score', 'score')},
  CASE WHEN flagged THEN severity END AS severity{more} FROM walk WHERE rn > 0"""


def folded(df, ident, *more):
    out = rounded(df, "rolling_mean", "price_zscore", "price_change_pct", "score")
    return out.withColumn("severity", F.when(F.col("flagged"), F.col("severity"))).select(ident, *FOLD_COLUMNS, *more)


@query("gated_zscore_events", with_sql(EV, fold_sql("user_id", "event_id", "SELECT * FROM ev", *z_parts(1.5)),
                                       body=fold_select("event_id"), recursive=True))
def gated_zscore_events(spark, d):
    out = G.gated_fold(event_observations(spark, d), ["user_id"], ["seen_at", "event_id"],
                       R.zscore_rule(1.5), keep=["event_id"])
    return folded(out, "event_id")


@query("gated_zscore", with_sql(OBS, fold_sql(", ".join(SERIES), "obs_id", "SELECT * FROM obs", *z_parts(2.9)),
                                body=fold_select("obs_id"), recursive=True))
def gated_zscore(spark, d):
    out = G.gated_fold(observations(spark, d), SERIES, ORDER, R.zscore_rule(2.9), keep=["obs_id"])
    return folded(out, "obs_id")


@query("gated_zscore_acceptance", with_sql(EV, fold_sql_no_double_append(
    fold_sql("user_id", "event_id", "SELECT event_id, user_id, seen_at, round(price) AS price FROM ev", *z_parts(1.0), persist=True)),
    body=fold_select("event_id", ", accepted"), recursive=True))
def gated_zscore_acceptance(spark, d):
    """Row path: a flagged price that returns after 24 hours within 2 % joins the baseline."""
    events = event_observations(spark, d).withColumn("price", F.round("price"))
    out = G.gated_fold(events, ["user_id"], ["seen_at", "event_id"], R.zscore_rule(1.0),
                       keep=["event_id"], acceptance=True)
    return folded(out, "event_id", "accepted")


I_Q1, I_Q3 = "list_sort(h)[n // 4 + 1]", "list_sort(h)[(3 * n) // 4 + 1]"
I_DIST = f"greatest({I_Q1} - 1.5 * ({I_Q3} - {I_Q1}) - p, p - ({I_Q3} + 1.5 * ({I_Q3} - {I_Q1})))"


@query("gated_iqr", with_sql(OBS, fold_sql(", ".join(SERIES), "obs_id", "SELECT * FROM obs",
    f"n >= 4 AND {I_DIST} > 0",
    f"CASE WHEN n >= 4 AND {I_DIST} > 0 THEN CASE WHEN {I_Q3} > {I_Q1} THEN least({I_DIST} / (2 * ({I_Q3} - {I_Q1})), 1.0) ELSE 0.5 END ELSE 0 END",
    f"CASE WHEN {I_Q3} > {I_Q1} THEN CASE WHEN {I_DIST} / ({I_Q3} - {I_Q1}) > 3 THEN 'critical' WHEN {I_DIST} / ({I_Q3} - {I_Q1}) > 2 THEN 'high' ELSE 'medium' END END"),
    body=fold_select("obs_id"), recursive=True))
def gated_iqr(spark, d):
    return folded(G.gated_fold(observations(spark, d), SERIES, ORDER, R.iqr_rule(), keep=["obs_id"]), "obs_id")


@query("gated_price_change", with_sql(OBS, fold_sql(", ".join(SERIES), "obs_id", "SELECT * FROM obs",
    "abs(c) > 0.2", cap("abs(c)", 0.4),
    "CASE WHEN abs(c) > 0.2::DOUBLE * 3 THEN 'critical' WHEN abs(c) > 0.2::DOUBLE * 2 THEN 'high' ELSE 'medium' END"),
    body=fold_select("obs_id"), recursive=True))
def gated_price_change(spark, d):
    return folded(G.gated_fold(observations(spark, d), SERIES, ORDER, R.change_rule(), keep=["obs_id"]), "obs_id")


G_MAD = "(1.4826 * list_mad(h))"
G_SN = "(list_median([list_median([abs(x - y) FOR y IN h]) FOR x IN h]) * CASE WHEN n % 2 = 1 THEN n / (n - 0.9) ELSE 1 END)"
G_GAP = "abs(p - list_median(h))"
_GATED = {
    "mad": f"{G_GAP} / nullif({G_MAD}, 0)",
    "sn": f"{G_GAP} / nullif({G_SN}, 0)",
    "weighted": f"0.5 * ({G_GAP} / nullif({G_MAD}, 0)) + 0.5 * ({G_GAP} / nullif({G_SN}, 0))",
    "max": f"CASE WHEN {G_MAD} > 0 AND {G_SN} > 0 THEN greatest({G_GAP} / {G_MAD}, {G_GAP} / {G_SN}) END",
    "mean": f"0.5 * ({G_GAP} / nullif({G_MAD}, 0) + {G_GAP} / nullif({G_SN}, 0))",
}


def _gated_modified(mode: str) -> None:
    z = _GATED[mode]

    @query(f"gated_modified_{mode}", with_sql(EV, fold_sql("user_id", "event_id", "SELECT * FROM ev",
        f"n >= 3 AND {z} > 2", f"CASE WHEN n >= 3 THEN {cap(f'({z})', 4.0)} ELSE 0 END", sev_dev(f"({z})", 2.0)),
        body=fold_select("event_id"), recursive=True))
    def run(spark, d):
        out = G.gated_fold(event_observations(spark, d), ["user_id"], ["seen_at", "event_id"],
                           R.modified_rule(mode), keep=["event_id"])
        return folded(out, "event_id")


for _mode in _GATED:
    _gated_modified(_mode)

SPLIT_AT = "TIMESTAMP '2024-01-15'"
PRE = """pre AS (SELECT user_id, list(price ORDER BY back DESC) AS seed FROM (SELECT user_id, price,
  row_number() OVER (PARTITION BY user_id ORDER BY seen_at DESC, event_id DESC) AS back FROM ev WHERE event_id % 2 = 0) WHERE back <= 30 GROUP BY user_id)"""


@query("gated_zscore_preloaded", with_sql(EV, PRE, fold_sql("user_id", "event_id",
    "SELECT ev.*, seed FROM ev LEFT JOIN pre USING (user_id) WHERE event_id % 2 = 1", *z_parts(2.0),
    seed="coalesce(seed, []::DOUBLE[])", last="seed[-1]", extra=", seed"), body=fold_select("event_id"), recursive=True))
def gated_zscore_preloaded(spark, d):
    """Baselines preloaded from one half of the events, the other half scored."""
    events = event_observations(spark, d)
    order = ["seen_at", "event_id"]
    train, test = (events.filter(F.col("event_id") % 2 == k) for k in (0, 1))
    states = G.baseline_states(train.join(test.select("user_id").distinct(), "user_id", "left_semi"), ["user_id"], order)
    return folded(G.gated_fold(test, ["user_id"], order, R.zscore_rule(2.0), keep=["event_id"], states=states), "event_id")


@query("baseline_states", with_sql(OBS, body=f"""SELECT product_id, competitor_id, len(h) AS n, {r6_sql('h[-1]', 'last_price')},
  {r6_sql('list_avg(h)', 'mean_price')}, {r6_sql('h[1]', 'oldest')} FROM (SELECT product_id, competitor_id,
  list(price ORDER BY back DESC) AS h FROM (SELECT *, row_number() OVER (PARTITION BY product_id, competitor_id
  ORDER BY seen_at DESC, obs_id DESC) AS back FROM obs WHERE price IS NOT NULL) WHERE back <= 30 GROUP BY ALL)"""))
def baseline_states(spark, d):
    states = G.baseline_states(observations(spark, d), SERIES, ORDER)
    h = F.col("_state.prices")
    from tidemark.functions.scales import array_mean

    return states.select(
        *SERIES, F.size(h).cast("long").alias("n"), r6("_state.last_price", "last_price"),
        r6(array_mean(h), "mean_price"), r6(F.element_at(h, 1), "oldest"),
    )


@query("final_baselines", with_sql(EV, fold_sql("user_id", "event_id", "SELECT * FROM ev", *z_parts(1.5)),
    body=f"""SELECT user_id, len(max_by(h, rn)) AS n, {r6_sql('max_by(last, rn)', 'last_price')},
  {r6_sql('list_avg(max_by(h, rn))', 'mean_price')} FROM walk GROUP BY user_id""", recursive=True))
def final_baselines(spark, d):
    from tidemark.functions.scales import array_mean

    states = G.final_states(event_observations(spark, d), ["user_id"], ["seen_at", "event_id"], R.zscore_rule(1.5))
    h = F.col("_state.prices")
    return states.select("user_id", F.size(h).cast("long").alias("n"), r6("_state.last_price", "last_price"),
                         r6(array_mean(h), "mean_price"))


@query("state_statistics", with_sql(OBS, body="""SELECT competitor_id, count(*) AS n_series, CAST(sum(least(c, 30)) AS BIGINT) AS n_observations
  FROM (SELECT product_id, competitor_id, count(price) AS c FROM obs GROUP BY ALL HAVING count(price) > 0) GROUP BY competitor_id"""))
def state_statistics(spark, d):
    states = G.baseline_states(observations(spark, d), SERIES, ORDER)
    return states.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("n_series"), F.sum(F.size("_state.prices")).cast("long").alias("n_observations")
    )


@query("state_snapshot_reuse", with_sql(OBS, body="""SELECT count(*) AS n_series, true AS first_built, false AS second_built,
  true AS rebuilt_on_change FROM (SELECT DISTINCT product_id, competitor_id FROM obs WHERE price IS NOT NULL)"""))
def state_snapshot_reuse(spark, d):
    """Baselines saved under their source's signature: reused while it holds, rebuilt when it changes."""
    from tidemark.operators.snapshots import load_or_build
    from tidemark.session import scratch_path

    root = scratch_path(spark, "snapshots")
    obs = observations(spark, d)
    states, first = load_or_build(root, obs, SERIES, ORDER)
    states, second = load_or_build(root, obs, SERIES, ORDER)
    _, third = load_or_build(root, obs.filter(F.col("segment") == "B2B"), SERIES, ORDER)
    return states.agg(F.count(F.lit(1)).alias("n_series")).withColumns({
        "first_built": F.lit(first), "second_built": F.lit(second), "rebuilt_on_change": F.lit(third),
    })


@query("history_depth_at_scoring", with_sql(EV, fold_sql("user_id", "event_id", "SELECT * FROM ev", *z_parts(1.5)),
    body="""SELECT least(n, 30) AS depth, count(*) AS n_rows, count(*) FILTER (flagged) AS n_flagged FROM walk WHERE rn > 0
  GROUP BY 1""", recursive=True))
def history_depth_at_scoring(spark, d):
    out = G.gated_fold(event_observations(spark, d), ["user_id"], ["seen_at", "event_id"], R.zscore_rule(1.5),
                       keep=["event_id"])
    return out.groupBy(F.col("observation_count").alias("depth")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("flagged").alias("n_flagged")
    )
