"""Series features, scalar functions and scale estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EV, OBS, ORDER, SERIES, event_observations, observations, query, r6, r6_sql, rounded, table, with_sql,
)
from tidemark.functions import scalar as S
from tidemark.functions import scales, text
from tidemark.operators import detectors as D
from tidemark.operators import features as X
from tidemark.operators.outliers import series_outliers

W = "PARTITION BY product_id, competitor_id ORDER BY seen_at, obs_id"
PAST = f"{W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING"

ROLL = f"""roll AS (SELECT *, lag(price) OVER ({W}) AS previous_price,
  avg(price) OVER ({PAST}) AS rolling_mean, stddev_samp(price) OVER ({PAST}) AS rolling_std,
  min(price) OVER ({PAST}) AS rolling_min, max(price) OVER ({PAST}) AS rolling_max,
  count(price) OVER ({PAST}) AS observation_count FROM obs)"""

ROBUST = f"""robust AS (SELECT *, lag(price) OVER ({W}) AS previous_price,
  count(price) OVER ({PAST}) AS observation_count,
  avg(price) OVER ({PAST}) AS rolling_mean,
  CASE WHEN count(price) OVER ({PAST}) = 1 THEN 0.0 ELSE stddev_samp(price) OVER ({PAST}) END AS rolling_std,
  min(price) OVER ({PAST}) AS rolling_min, max(price) OVER ({PAST}) AS rolling_max,
  median(price) OVER ({PAST}) AS rolling_median, mad(price) OVER ({PAST}) AS rolling_mad,
  quantile_cont(price, 0.05) OVER ({PAST}) AS percentile_5,
  quantile_cont(price, 0.95) OVER ({PAST}) AS percentile_95 FROM obs)"""

HIST = f"""hist AS (SELECT *, lag(price) OVER ({W}) AS previous_price,
  coalesce(list(price) FILTER (price IS NOT NULL) OVER ({PAST}), []::DOUBLE[]) AS history FROM obs)"""


@query("window_zscore_flags", with_sql(EV, f"""f AS (SELECT user_id, value_z FROM (
  SELECT user_id, CASE WHEN count(price) OVER p >= 3 AND stddev_samp(price) OVER p > 0
    THEN (price - avg(price) OVER p) / stddev_samp(price) OVER p END AS value_z
  FROM ev WINDOW p AS (PARTITION BY user_id ORDER BY seen_at, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)))""",
    body="""SELECT user_id, count(*) AS n_rows, count(*) FILTER (abs(value_z) > 3) AS n_flagged,
  max(round(abs(value_z), 6)) AS top_z FROM f GROUP BY user_id"""))
def window_zscore_flags(spark, d):
    rolled = X.rolling_features(event_observations(spark, d), ["user_id"], ["seen_at", "event_id"])
    z = F.when(
        (F.col("observation_count") >= 3) & (F.col("rolling_std") > 0),
        F.abs((F.col("price") - F.col("rolling_mean")) / F.col("rolling_std")),
    )
    return rolled.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(z > 3).alias("n_flagged"),
        F.max(F.round(z, 6)).alias("top_z"),
    )


@query("rolling_features", with_sql(OBS, ROLL, body=f"""SELECT obs_id,
  {r6_sql('previous_price', 'previous_price')}, {r6_sql('rolling_mean', 'rolling_mean')},
  {r6_sql('rolling_std', 'rolling_std')}, {r6_sql('rolling_min', 'rolling_min')},
  {r6_sql('rolling_max', 'rolling_max')}, observation_count FROM roll"""))
def rolling_features(spark, d):
    out = X.rolling_features(observations(spark, d), SERIES, ORDER)
    names = ["previous_price", "rolling_mean", "rolling_std", "rolling_min", "rolling_max"]
    return rounded(out, *names).select("obs_id", *names, "observation_count")


TREE = """tree0 AS (SELECT *, coalesce(price, 0.0) AS p0, observation_count >= 3 AS ready FROM roll),
tree AS (SELECT obs_id, product_id, competitor_id, country, segment, seen_at, p0 AS price,
  ln(greatest(p0, 1e-10) + 1.0) AS price_log,
  CASE WHEN list_price > 0 THEN p0 / list_price ELSE 1.0 END AS price_ratio,
  CASE WHEN list_price IS NOT NULL THEN 1.0 ELSE 0.0 END AS has_list_price,
  CASE WHEN ready THEN coalesce(rolling_mean, 0) ELSE 0 END AS rolling_mean,
  CASE WHEN ready THEN coalesce(rolling_std, 0) ELSE 0 END AS rolling_std,
  CASE WHEN ready THEN coalesce(rolling_min, 0) ELSE 0 END AS rolling_min,
  CASE WHEN ready THEN coalesce(rolling_max, 0) ELSE 0 END AS rolling_max,
  CASE WHEN ready AND rolling_std > 0 THEN (p0 - rolling_mean) / rolling_std ELSE 0 END AS price_zscore,
  CASE WHEN ready AND previous_price > 0 THEN coalesce((price - previous_price) / previous_price, 0) ELSE 0 END AS price_change_pct,
  CASE WHEN NOT ready THEN 0 WHEN rolling_mean > 0 THEN p0 / rolling_mean ELSE 1 END AS price_vs_mean_ratio,
  CASE WHEN NOT ready THEN 0 WHEN rolling_max - rolling_min > 0 THEN (p0 - rolling_min) / (rolling_max - rolling_min)
    ELSE 0.5 END AS price_range_position FROM tree0)"""


@query("tree_features", with_sql(OBS, ROLL, TREE, body=f"""SELECT obs_id,
  {', '.join(r6_sql(c, c) for c in X.TREE_FEATURES)} FROM tree"""))
def tree_features(spark, d):
    out = X.tree_features(X.rolling_features(observations(spark, d), SERIES, ORDER))
    return rounded(out, *X.TREE_FEATURES).select("obs_id", *X.TREE_FEATURES)


@query("training_row_mask", with_sql(OBS, ROLL, TREE, body="""SELECT competitor_id, count(*) AS n_rows,
  count(*) FILTER (""" + " OR ".join(f"abs({c}) > 1e-8" for c in X.TREE_FEATURES[4:]) + """) AS n_trainable
  FROM tree GROUP BY competitor_id"""))
def training_row_mask(spark, d):
    tree = X.tree_features(X.rolling_features(observations(spark, d), SERIES, ORDER))
    X.check_feature_names(tree)
    total = tree.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = X.trainable(tree).groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n_trainable"))
    return total.join(kept, "competitor_id", "left").na.fill(0)


@query("robust_rolling_statistics", with_sql(OBS, ROBUST, body=f"""SELECT obs_id, observation_count,
  {', '.join(r6_sql(c, c) for c in ('rolling_median', 'rolling_mad', 'percentile_5', 'percentile_95'))} FROM robust"""))
def robust_rolling_statistics(spark, d):
    out = X.baseline_statistics(X.history_arrays(observations(spark, d), SERIES, ORDER))
    names = ["rolling_median", "rolling_mad", "percentile_5", "percentile_95"]
    return rounded(out, *names).select("obs_id", "observation_count", *names)


@query("robust_scores", with_sql(OBS, ROBUST, """sc AS (SELECT obs_id, coalesce(price, 0.0) AS p, * EXCLUDE (obs_id) FROM robust)""",
    body=f"""SELECT obs_id,
  {r6_sql('CASE WHEN rolling_std > 0 THEN (p - rolling_mean) / rolling_std END', 'price_zscore')},
  {r6_sql('CASE WHEN previous_price <> p AND previous_price > 0 THEN (p - previous_price) / previous_price END', 'price_change_pct')},
  {r6_sql('CASE WHEN rolling_mad IS NULL THEN NULL WHEN rolling_mad = 0 THEN CASE WHEN p = rolling_median THEN 0 ELSE 10 END ELSE (p - rolling_median) / (1.4826 * rolling_mad) END', 'robust_zscore')},
  {r6_sql('CASE WHEN percentile_5 IS NULL THEN NULL WHEN percentile_95 - percentile_5 = 0 THEN 0.5 ELSE greatest(0, least(1, (p - percentile_5) / (percentile_95 - percentile_5))) END', 'percentile_position')},
  observation_count >= 3 AS has_sufficient_history FROM sc"""))
def robust_scores(spark, d):
    out = X.scoring_features(X.baseline_statistics(X.history_arrays(observations(spark, d), SERIES, ORDER)))
    names = ["price_zscore", "price_change_pct", "robust_zscore", "percentile_position"]
    return rounded(out, *names).select("obs_id", *names, "has_sufficient_history")


@query("series_positions", with_sql(OBS, body="""SELECT obs_id,
  row_number() OVER (PARTITION BY product_id ORDER BY seen_at, obs_id) AS position,
  count(*) OVER (PARTITION BY product_id) AS series_rows FROM obs"""))
def series_positions(spark, d):
    from tidemark.operators.history import series_positions as positions

    return positions(observations(spark, d), ["product_id"], ORDER).select("obs_id", "position", "series_rows")


@query("category_median_price", with_sql(OBS, body=f"""SELECT category,
  {r6_sql('median(price)', 'category_median_price')} FROM obs GROUP BY category"""))
def category_median_price(spark, d):
    return rounded(X.category_median(observations(spark, d)), "category_median_price")


@query("global_price_percentiles", with_sql(OBS, body=", ".join(
    ["SELECT count(price) AS n"] + [r6_sql(f"quantile_cont(price, {p})", n) for n, p in
     (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))]) + " FROM obs"))
def global_price_percentiles(spark, d):
    from tidemark.plans.skew import exact_percentiles

    obs = observations(spark, d)
    cuts = exact_percentiles(obs, [], "price", {"p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95})
    total = obs.agg(F.count("price").alias("n"))
    return rounded(total.join(F.broadcast(cuts)), "p05", "p25", "p50", "p75", "p95")


RUNS = f"""marked AS (SELECT *, CASE WHEN lag(price) OVER ({W}) = price THEN 0 ELSE 1 END AS changed
  FROM obs WHERE price IS NOT NULL),
numbered AS (SELECT *, sum(changed) OVER ({W}) AS run_no FROM marked),
runs AS (SELECT *, row_number() OVER (PARTITION BY product_id, competitor_id, run_no ORDER BY seen_at, obs_id) - 1
    AS consecutive_unchanged,
  first_value(seen_at) OVER (PARTITION BY product_id, competitor_id, run_no ORDER BY seen_at, obs_id) AS last_change_at
  FROM numbered)"""


@query("unchanged_price_runs", with_sql(OBS, RUNS, body="""SELECT obs_id, consecutive_unchanged,
  consecutive_unchanged >= 1 AS is_persistent,
  date_diff('day', last_change_at, seen_at) AS days_in_run FROM runs"""))
def unchanged_price_runs(spark, d):
    out = X.unchanged_runs(observations(spark, d).filter(F.col("price").isNotNull()), SERIES, ORDER)
    return out.select(
        "obs_id", "consecutive_unchanged", "is_persistent",
        F.date_diff("seen_at", "last_change_at").cast("long").alias("days_in_run"),
    )


PF_SQL = {
    "price": "CASE WHEN price > 0 THEN price END",
    "price_log": "CASE WHEN price > 0 THEN ln(price) END",
    "price_ratio": "CASE WHEN price <> 0 AND list_price > 0 THEN price / list_price ELSE 1 END",
    "price_change_pct": "CASE WHEN live AND previous_price <> 0 THEN (price - previous_price) / previous_price ELSE 0 END",
    "price_zscore": "CASE WHEN live AND rolling_std > 0 THEN (price - rolling_mean) / rolling_std ELSE 0 END",
    "price_vs_mean_ratio": "CASE WHEN live AND rolling_mean <> 0 THEN price / rolling_mean ELSE 1 END",
    "price_range_position": "CASE WHEN live AND rolling_min <> 0 AND rolling_max <> 0 AND rolling_max - rolling_min > 0 THEN (price - rolling_min) / (rolling_max - rolling_min) ELSE 0.5 END",
    "rolling_median": "rolling_median",
    "rolling_mad": "rolling_mad",
    "robust_zscore": "CASE WHEN price <> 0 AND rolling_median IS NOT NULL THEN CASE WHEN rolling_mad > 0 THEN (price - rolling_median) / (1.4826 * rolling_mad) WHEN price = rolling_median THEN 0 ELSE 10 END ELSE 0 END",
    "price_percentile_position": "CASE WHEN price <> 0 AND percentile_95 - percentile_5 > 0 THEN greatest(0, least(1, (price - percentile_5) / (percentile_95 - percentile_5))) ELSE 0.5 END",
    "days_since_change": "date_diff('day', last_change_at, seen_at)",
    "consecutive_unchanged": "consecutive_unchanged",
    "is_persistent_change": "CASE WHEN consecutive_unchanged >= 1 THEN 1 ELSE 0 END",
    "price_vs_category": "CASE WHEN price <> 0 AND category_median_price <> 0 THEN price / category_median_price ELSE 1 END",
    "seller_type_encoded": "CASE seller_type WHEN 'marketplace_first_party' THEN 1 WHEN 'marketplace_third_party' THEN 2 ELSE 0 END",
    "is_club_price": "CASE WHEN is_club_price THEN 1 ELSE 0 END",
    "has_promotion": "CASE WHEN has_promotion THEN 1 ELSE 0 END",
    "expected_discount": "CASE WHEN has_promotion AND discount_amount <> 0 AND price <> 0 THEN discount_amount / price ELSE 0 END",
    "stock_status_encoded": "CASE stock_status WHEN 'in_stock' THEN 0 WHEN 'limited' THEN 1 WHEN 'out_of_stock' THEN 2 ELSE 3 END",
    "is_outlet": "CASE WHEN is_outlet THEN 1 ELSE 0 END",
    "condition_encoded": "CASE item_condition WHEN 'refurbished' THEN 1 WHEN 'used' THEN 2 ELSE 0 END",
}


def _context(df):
    """Context columns derived from the observation's own fields."""
    return df.withColumns({
        "seller_type": F.when(F.col("competitor_id") == "SHOP_DK", "retailer")
        .when(F.col("competitor_id") == "SHOP_SE", "Marketplace_First_Party")
        .otherwise("marketplace_third_party"),
        "is_club_price": F.col("segment") == "B2C",
        "has_promotion": F.coalesce(F.col("list_price") > F.col("price"), F.lit(False)),
        "discount_amount": F.col("list_price") - F.col("price"),
        "stock_status": F.when(F.col("category") == "ECONOMY", "in_stock")
        .when(F.col("category") == "PROMO", "limited").otherwise("sold_elsewhere"),
        "is_outlet": F.col("country") == "COUNTRY_4",
        "item_condition": F.when(F.col("country") == "COUNTRY_1", "refurbished")
        .when(F.col("country") == "COUNTRY_2", "used").otherwise("new"),
    })


@query("price_features", with_sql(OBS, ROBUST, RUNS.replace("FROM obs", "FROM robust"), """med AS (
  SELECT category, median(price) AS category_median_price FROM obs GROUP BY category),
pf AS (SELECT runs.*, category_median_price, observation_count >= 3 AND price <> 0 AS live,
  CASE competitor_id WHEN 'SHOP_DK' THEN 'retailer' WHEN 'SHOP_SE' THEN 'marketplace_first_party' ELSE 'marketplace_third_party' END AS seller_type,
  segment = 'B2C' AS is_club_price, coalesce(list_price > price, false) AS has_promotion, list_price - price AS discount_amount,
  CASE category WHEN 'ECONOMY' THEN 'in_stock' WHEN 'PROMO' THEN 'limited' ELSE 'sold_elsewhere' END AS stock_status,
  country = 'COUNTRY_4' AS is_outlet,
  CASE country WHEN 'COUNTRY_1' THEN 'refurbished' WHEN 'COUNTRY_2' THEN 'used' ELSE 'new' END AS item_condition
  FROM runs JOIN med USING (category))""",
    body=f"""SELECT obs_id, {', '.join(r6_sql(e, n) for n, e in PF_SQL.items())},
  coalesce(price > 0, false) AS is_valid,
  concat_ws(',', CASE WHEN NOT coalesce(price > 0, false) THEN 'price' END, CASE WHEN list_price IS NULL THEN 'price_ratio' END,
    CASE WHEN observation_count < 3 THEN 'price_change_pct,price_zscore,price_vs_mean_ratio,price_range_position' END,
    CASE WHEN rolling_median IS NULL THEN 'robust_zscore,price_percentile_position' END) AS missing
  FROM pf"""))
def price_features(spark, d):
    obs = observations(spark, d).filter(F.col("price").isNotNull())
    base = X.baseline_statistics(X.history_arrays(observations(spark, d), SERIES, ORDER)).filter(
        F.col("price").isNotNull()
    )
    runs = X.unchanged_runs(obs, SERIES, ORDER).select(
        "obs_id", "last_change_at", F.col("consecutive_unchanged")
    )
    category = X.category_median(observations(spark, d))
    joined = base.join(runs, "obs_id").join(category, "category")
    out = X.price_features(_context(joined))
    return rounded(out, *PF_SQL).select(
        "obs_id", *PF_SQL, "is_valid", F.concat_ws(",", "missing_features").alias("missing")
    )


CONTENT = """content0 AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title, text AS description, lang AS brand,
  CAST(n_chars % 3 AS VARCHAR) AS ean, CAST(n_chars % 2 AS VARCHAR) AS mpn,
  len(text) - len(replace(text, chr(10), '')) AS bullet_count, len(text) - len(replace(text, '.', '')) AS image_count,
  CASE WHEN n_chars < 800 THEN 'hidden' ELSE 'confirmed' END AS price_status FROM documents),
content AS (SELECT *, """ + ", ".join(
    f"lag({c}) OVER (PARTITION BY source ORDER BY doc_id) AS previous_{c}" for c in X.CONTENT_COLUMNS
) + " FROM content0)"


def _content(spark, d):
    docs = table(spark, d, "documents")
    content = docs.select(
        "doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"), F.col("lang").alias("brand"),
        (F.col("n_chars") % 3).cast("string").alias("ean"), (F.col("n_chars") % 2).cast("string").alias("mpn"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("bullet_count"),
        (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).alias("image_count"),
        F.when(F.col("n_chars") < 800, "hidden").otherwise("confirmed").alias("price_status"),
    )
    return X.with_previous(content, ["source"], ["doc_id"], X.CONTENT_COLUMNS, F.col("doc_id"))


SF_NAMES = [
    "title_length", "title_length_ratio", "title_changed", "title_collapsed", "description_present",
    "description_disappeared", "brand_changed", "identifier_changed", "bullet_count_change",
    "image_count_change", "price_status_changed", "run_parse_error_rate", "run_products_missing_pct",
]


def _differs(c):
    return f"coalesce({c}, '') <> '' AND coalesce(previous_{c}, '') <> '' AND {c} <> previous_{c}"


SF_SQL = {
    "title_length": "len(title)",
    "title_length_ratio": "CASE WHEN len(previous_title) > 0 THEN len(title) / len(previous_title)::DOUBLE ELSE 1 END",
    "title_changed": f"CASE WHEN {_differs('title')} THEN 1 ELSE 0 END",
    "title_collapsed": "CASE WHEN len(previous_title) > 0 AND len(title) / len(previous_title)::DOUBLE < 0.3 THEN 1 ELSE 0 END",
    "description_present": "CASE WHEN coalesce(description, '') <> '' THEN 1 ELSE 0 END",
    "description_disappeared": "CASE WHEN coalesce(previous_description, '') <> '' AND coalesce(description, '') = '' THEN 1 ELSE 0 END",
    "brand_changed": f"CASE WHEN {_differs('brand')} THEN 1 ELSE 0 END",
    "identifier_changed": f"CASE WHEN ({_differs('ean')}) OR ({_differs('mpn')}) THEN 1 ELSE 0 END",
    "bullet_count_change": "CASE WHEN previous_bullet_count > 0 THEN (bullet_count - previous_bullet_count) / previous_bullet_count::DOUBLE ELSE 0 END",
    "image_count_change": "CASE WHEN previous_image_count > 0 THEN (image_count - previous_image_count) / previous_image_count::DOUBLE ELSE 0 END",
    "price_status_changed": "CASE WHEN previous_price_status = 'confirmed' AND price_status = 'hidden' THEN 1 ELSE 0 END",
    "run_parse_error_rate": "0.25",
    "run_products_missing_pct": "0",
}


@query("scrape_features", with_sql(CONTENT, body=f"""SELECT doc_id,
  {', '.join(r6_sql(e, n) for n, e in SF_SQL.items())} FROM content"""))
def scrape_features(spark, d):
    content = _content(spark, d).withColumns({
        "run_parse_error_rate": F.lit(0.25), "run_products_missing_pct": F.lit(None).cast("double"),
    })
    return rounded(X.scrape_features(content), *SF_NAMES).select("doc_id", *SF_NAMES)


TALK = """talk AS (SELECT conv_id, turn, text AS title, len(text)::DOUBLE AS price,
  lag(text) OVER w AS previous_title, lag(len(text)::DOUBLE) OVER w AS previous_price
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
lowered AS (SELECT *, lower(trim(title)) AS a, lower(trim(previous_title)) AS b FROM talk),
grams AS (SELECT *, list_distinct([substr(a, i, 3) FOR i IN range(1, len(a) - 1)]) AS ga,
  list_distinct([substr(b, i, 3) FOR i IN range(1, len(b) - 1)]) AS gb,
  list_distinct(string_split(a, '')) AS ca, list_distinct(string_split(b, '')) AS cb FROM lowered),
coherent AS (SELECT *, CASE WHEN coalesce(previous_title, '') = '' THEN NULL WHEN coalesce(title, '') = '' THEN 0
  WHEN a = b THEN 1 WHEN a = '' OR b = '' THEN 0
  WHEN len(a) < 3 OR len(b) < 3 THEN len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb)))::DOUBLE
  ELSE len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE END AS similarity,
  CASE WHEN price <> 0 AND previous_price <> 0 THEN (price - previous_price) / previous_price END AS pct FROM grams)"""


def talk_features(spark, d):
    talk = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("title"), F.length("text").cast("double").alias("price")
    )
    before = X.with_previous(talk, ["conv_id"], ["turn"], ["title", "price"], F.col("turn"))
    return X.coherence_features(before)


@query("coherence_features", with_sql(TALK, body=f"""SELECT conv_id, turn,
  {r6_sql('similarity', 'title_similarity')}, {r6_sql('pct', 'price_change_pct')},
  coalesce(abs(pct) > 0.01, false) AS price_changed,
  CASE WHEN pct > 0.01 THEN 'increase' WHEN pct < -0.01 THEN 'decrease' END AS price_change_direction,
  coalesce(similarity < 0.8, false) AS title_changed,
  coalesce(previous_title <> '' AND (title = '' OR len(title) < len(previous_title) * 0.5), false) AS content_degraded
  FROM coherent"""))
def coherence_features(spark, d):
    names = ["title_similarity", "price_change_pct"]
    return rounded(talk_features(spark, d), *names).select(
        "conv_id", "turn", *names, "price_changed", "price_change_direction", "title_changed", "content_degraded"
    )


@query("numeric_features", with_sql(OBS, """nf AS (SELECT obs_id, currency, product_name, price, list_price,
  coalesce(price, 0.0) AS p, CASE WHEN list_price >= 0 THEN list_price END AS l FROM obs)""",
    body=f"""SELECT obs_id, {r6_sql('CASE WHEN l > 0 THEN p / l ELSE 1 END', 'price_ratio')},
  l IS NOT NULL AS has_list_price, {r6_sql('ln(p + 1)', 'price_log')},
  currency IS NOT NULL AND price IS NOT NULL AS is_valid,
  concat_ws(',', CASE WHEN currency IS NULL THEN 'missing_currency' END,
    CASE WHEN price IS NULL THEN 'missing_price' WHEN price = 0 THEN 'zero_price' END,
    CASE WHEN p / l > 1 THEN 'price_exceeds_list' WHEN p / l < 0.1 THEN 'extreme_discount' END) AS errors FROM nf"""))
def numeric_features(spark, d):
    out = rounded(D.numeric_features(observations(spark, d)), "price_ratio", "price_log")
    return out.select(
        "obs_id", "price_ratio", "has_list_price", "price_log", "is_valid",
        F.concat_ws(",", "validation_errors").alias("errors"),
    )


@query("evaluation_features", with_sql(OBS, """nf AS (SELECT *, coalesce(price, 0.0) AS p FROM obs)""",
    body=f"""SELECT obs_id, {r6_sql('CASE WHEN list_price > 0 THEN p / list_price ELSE 1 END', 'price_ratio')},
  p > 0 AND currency IS NOT NULL AS is_valid,
  concat_ws(',', CASE WHEN p <= 0 THEN 'invalid_price' END, CASE WHEN currency IS NULL THEN 'missing_currency' END) AS errors
  FROM nf"""))
def evaluation_features(spark, d):
    out = rounded(D.evaluation_features(observations(spark, d)), "price_ratio")
    return out.select("obs_id", "price_ratio", "is_valid", F.concat_ws(",", "validation_errors").alias("errors"))


@query("guarded_arithmetic", with_sql(OBS, body=f"""SELECT obs_id,
  {r6_sql('CASE WHEN price IS NULL OR list_price IS NULL THEN 0 ELSE price / list_price END', 'divided')},
  {r6_sql('CASE WHEN list_price IS NULL OR price IS NULL OR price = 0 THEN 0 ELSE (list_price - price) / price END', 'changed')},
  {r6_sql('CASE WHEN price IS NULL OR list_price IS NULL OR price = 0 THEN 1 ELSE list_price / price END', 'related')} FROM obs"""))
def guarded_arithmetic(spark, d):
    price, listed = F.col("price"), F.col("list_price")
    return observations(spark, d).select(
        "obs_id", r6(S.safe_divide(price, listed), "divided"),
        r6(S.pct_change(listed, price, 0.0), "changed"), r6(S.ratio(listed, price), "related"),
    )


@query("score_and_severity", with_sql(EV, body=f"""SELECT event_id,
  {r6_sql('least(price / 40.0, 1.0)', 'normalized')},
  CASE WHEN price > 40 THEN 'critical' WHEN price > 30 THEN 'high' WHEN price > 20 THEN 'medium' END AS by_deviation,
  CASE WHEN price / 60.0 >= 0.9 THEN 'critical' WHEN price / 60.0 >= 0.8 THEN 'high' WHEN price / 60.0 >= 0.7 THEN 'medium' ELSE 'low' END AS by_score,
  CASE WHEN price / 60.0 >= 0.9 THEN 'critical' WHEN price / 60.0 >= 0.8 THEN 'high' WHEN price / 60.0 >= 0.7 THEN 'medium'
    WHEN price / 60.0 >= 0.5 THEN 'low' END AS by_weighted_score,
  CASE WHEN price > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS no_threshold FROM ev"""))
def score_and_severity(spark, d):
    v = F.col("price")
    return event_observations(spark, d).select(
        "event_id", r6(S.normalized_score(v, 20.0), "normalized"),
        S.severity_by_deviation(v, 20.0).alias("by_deviation"),
        S.severity_by_score(v / 60.0).alias("by_score"),
        S.severity_by_score(v / 60.0, low_from=0.5).alias("by_weighted_score"),
        S.normalized_score(v, 0.0).alias("no_threshold"),
    )


@query("currency_expectation", with_sql(OBS, body="""SELECT country, competitor_id,
  replace(country, 'COUNTRY', 'CURRENCY') AS expected,
  CASE competitor_id WHEN 'SHOP_DK' THEN 'DKK' WHEN 'SHOP_SE' THEN 'SEK' WHEN 'SHOP_NO' THEN 'NOK' WHEN 'SHOP_FI' THEN 'EUR' END AS inferred,
  count(*) AS n_rows, count(*) FILTER (currency <> replace(country, 'COUNTRY', 'CURRENCY')) AS n_mismatch
  FROM obs GROUP BY country, competitor_id"""))
def currency_expectation(spark, d):
    obs = observations(spark, d).withColumns({
        "expected": S.expected_currency(F.lower("country")), "inferred": S.competitor_currency(F.col("competitor_id")),
    })
    return obs.groupBy("country", "competitor_id", "expected", "inferred").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("currency") != F.col("expected")).alias("n_mismatch")
    )


@query("tolerance_match", with_sql(OBS, body=f"""SELECT obs_id,
  coalesce(abs(prev - price) <= prev * 0.02, false) AS within_two_percent, coalesce(prev = price, false) AS exactly_equal
  FROM (SELECT obs_id, price, lag(price) OVER ({W}) AS prev FROM obs)"""))
def tolerance_match(spark, d):
    before = X.with_previous(observations(spark, d), SERIES, ORDER, ["price"], X.micros())
    old, now = F.col("previous_price"), F.col("price")
    return before.select(
        "obs_id", F.coalesce(S.within_tolerance(old, now, 0.02), F.lit(False)).alias("within_two_percent"),
        F.coalesce(S.within_tolerance(old, now, 0.0), F.lit(False)).alias("exactly_equal"),
    )


@query("timestamp_parsing", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN -1
  ELSE epoch_us(date_trunc('second', ts)) END AS parsed_us FROM events""")
def timestamp_parsing(spark, d):
    ev = table(spark, d, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(
        F.col("event_id") % 3 == 1, F.concat(iso, F.lit("+00:00"))
    ).otherwise(F.concat(F.lit("on "), iso))
    return ev.select("event_id", F.coalesce(F.unix_micros(S.parse_instant(raw)), F.lit(-1)).alias("parsed_us"))


SCALE_SQL = {
    "sd": "CASE WHEN n > 0 THEN coalesce(list_stddev_pop(history), 0) END",
    "mad": "CASE WHEN n > 0 THEN 1.4826 * list_mad(history) END",
    "sn": "CASE WHEN n > 0 THEN list_median([list_median([abs(x - y) FOR y IN history]) FOR x IN history]) * CASE WHEN n % 2 = 1 THEN n / (n - 0.9) ELSE 1 END END",
}


@query("scale_estimators", with_sql(OBS, HIST, f"""sc AS (SELECT obs_id, coalesce(price, 0.0) AS p, history, len(history) AS n,
  {', '.join(f'{e} AS s_{k}' for k, e in SCALE_SQL.items())} FROM (SELECT *, len(history) AS n FROM hist)),
zs AS (SELECT *, list_avg(history) AS m, list_median(history) AS c FROM sc),
zz AS (SELECT *, CASE WHEN s_sd > 0 THEN (p - m) / s_sd END AS z_sd, CASE WHEN s_mad > 0 THEN (p - c) / s_mad END AS z_mad,
  CASE WHEN s_sn > 0 THEN (p - c) / s_sn END AS z_sn FROM zs)""",
    body=f"""SELECT obs_id, {r6_sql('s_sd', 'scale_sd')}, {r6_sql('s_mad', 'scale_mad')}, {r6_sql('s_sn', 'scale_sn')},
  {r6_sql('CASE WHEN s_sd > 1e-9 THEN z_sd END', 'z_sd')}, {r6_sql('z_mad', 'z_mad')}, {r6_sql('z_sn', 'z_sn')}, {r6_sql('0.25 * z_mad + 0.75 * z_sn', 'z_weighted')},
  {r6_sql('CASE WHEN z_mad IS NOT NULL AND z_sn IS NOT NULL THEN greatest(z_mad, z_sn) END', 'z_max')},
  {r6_sql('0.5 * (z_mad + z_sn)', 'z_mean')} FROM zz"""))
def scale_estimators(spark, d):
    h, p = F.col("history"), F.coalesce(F.col("price"), F.lit(0.0))
    hist = X.history_arrays(observations(spark, d), SERIES, ORDER)
    # Estimators are computed once per row and reused by the z-scores.
    base = hist.select(
        "obs_id", p.alias("p"), scales.array_mean(h).alias("m"), scales.array_median(h).alias("c"),
        *[fn(h).alias(f"scale_{k}") for k, fn in scales.SCALES.items()],
    )
    z = base.withColumns({
        "z_sd": F.when(F.col("scale_sd") > 1e-9, (F.col("p") - F.col("m")) / F.col("scale_sd")),
        "z_mad": scales.scale_z(F.col("p"), F.col("c"), F.col("scale_mad")),
        "z_sn": scales.scale_z(F.col("p"), F.col("c"), F.col("scale_sn")),
    })
    both = F.col("z_mad").isNotNull() & F.col("z_sn").isNotNull()
    z = z.withColumns({
        "z_weighted": F.lit(0.25) * F.col("z_mad") + F.lit(0.75) * F.col("z_sn"),
        "z_max": F.when(both, F.greatest("z_mad", "z_sn")),
        "z_mean": F.lit(0.5) * (F.col("z_mad") + F.col("z_sn")),
    })
    names = [c for c in z.columns if c.startswith(("scale_", "z_"))]
    return rounded(z, *names).select("obs_id", *names)


def _outlier_sql(scale: str, z: str, threshold: float) -> str:
    return with_sql(EV, """g AS (SELECT user_id, list(price) AS h, count(price) AS n FROM ev GROUP BY user_id)""",
        f"s AS (SELECT user_id, {scale} FROM g)",
        body=f"""SELECT event_id, {r6_sql(z, 'z')}, coalesce(abs({z}) > {threshold}, false) AS is_outlier
  FROM ev JOIN s USING (user_id)""")


_MAD = "list_median(h) AS c, 1.4826 * list_mad(h) AS md"
_SN = ("list_median(h) AS c, list_median([list_median([abs(x - y) FOR y IN h]) FOR x IN h])"
       " * CASE WHEN n % 2 = 1 THEN n / (n - 0.9) ELSE 1 END AS sn")
_OUTLIERS = {
    "sd": ("list_avg(h) AS c, list_stddev_pop(h) AS sd", "(price - c) / nullif(sd, 0)"),
    "mad": (_MAD, "abs(price - c) / nullif(md, 0)"),
    "sn": (_SN, "abs(price - c) / nullif(sn, 0)"),
    "weighted": (_MAD + ", " + _SN.split(", ", 1)[1],
                 "0.5 * (abs(price - c) / nullif(md, 0)) + 0.5 * (abs(price - c) / nullif(sn, 0))"),
    "max": (_MAD + ", " + _SN.split(", ", 1)[1],
            "greatest(abs(price - c) / nullif(md, 0), abs(price - c) / nullif(sn, 0))"),
    "mean": (_MAD + ", " + _SN.split(", ", 1)[1],
             "0.5 * (abs(price - c) / nullif(md, 0) + abs(price - c) / nullif(sn, 0))"),
}


def _register_outliers(method: str) -> None:
    @query(f"series_outliers_{method}", _outlier_sql(*_OUTLIERS[method], threshold=2.0))
    def run(spark, d):
        ev = event_observations(spark, d)
        out = series_outliers(ev, ["user_id"], "price", "event_id", method, 2.0)
        return rounded(out, "z").select("event_id", "z", "is_outlier")


for _method in _OUTLIERS:
    _register_outliers(_method)


@query("sql_scale_functions", with_sql(EV, """g AS (SELECT user_id, event_type, list(price) AS h, count(price) AS n
  FROM ev GROUP BY user_id, event_type)""", body=f"""SELECT user_id, event_type, {r6_sql('list_stddev_pop(h)', 'sd')},
  {r6_sql('1.4826 * list_mad(h)', 'mad')},
  {r6_sql('list_median([list_median([abs(x - y) FOR y IN h]) FOR x IN h]) * CASE WHEN n % 2 = 1 THEN n / (n - 0.9) ELSE 1 END', 'sn')}
  FROM (SELECT user_id, event_type, list(price) AS h, count(price) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY seen_at DESC, event_id DESC) AS back FROM ev) WHERE back <= 30 GROUP BY user_id, event_type)"""))
def sql_scale_functions(spark, d):
    """The estimators called from SQL on each series' newest 30 prices."""
    from tidemark.operators.fold import baseline_states

    scales.register_sql_functions(spark)
    states = baseline_states(event_observations(spark, d), ["user_id", "event_type"], ["seen_at", "event_id"])
    out = states.selectExpr(
        "user_id", "event_type", "scale_sd(_state.prices) AS sd", "scale_mad(_state.prices) AS mad",
        "scale_sn(_state.prices) AS sn",
    )
    return rounded(out, "sd", "mad", "sn")


@query("vector_similarity", """WITH pairs AS (SELECT label, vec_id, embedding AS a,
  lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
d AS (SELECT *, list_sum([a[i]::DOUBLE * b[i]::DOUBLE FOR i IN range(1, len(a) + 1)]) AS ab,
  sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN a])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN b])) AS nn,
  sqrt(list_sum([(a[i]::DOUBLE - b[i]::DOUBLE) ** 2 FOR i IN range(1, len(a) + 1)])) AS dist FROM pairs)
SELECT vec_id, """ + r6_sql("CASE WHEN b IS NULL OR nn = 0 THEN 0 ELSE ab / nn END", "cosine") + ", "
    + r6_sql("coalesce(dist, -1)", "distance")
    + ", 1 - CASE WHEN b IS NULL OR nn = 0 THEN 0 ELSE ab / nn END > 0.1 AS drifted FROM d")
def vector_similarity(spark, d):
    vectors = table(spark, d, "embeddings")
    pairs = X.with_previous(vectors, ["label"], ["vec_id"], ["embedding"], F.col("vec_id"))
    a, b = F.col("embedding"), F.col("previous_embedding")
    far = text.euclidean(a, b)
    return pairs.select(
        "vec_id", r6(text.cosine(a, b), "cosine"),
        r6(F.when(far == float("inf"), -1.0).otherwise(far), "distance"),
        text.vector_drift(a, b).alias("drifted"),
    )
