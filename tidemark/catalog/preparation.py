"""Filters by history, scopes, splits and dataset tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    OBS, ORDER, SERIES, query, r6, r6_sql, rounded, table, uniform_sql, with_sql,
)
from tidemark.catalog.base import observation_table as observations
from tidemark.functions import scalar as S
from tidemark.operators import history as H
from tidemark.plans import preparation as P
from tidemark.sources import artifacts as A

LEVELS = [5, 20, 25, 30, 35]


@query("minimum_history_filter", with_sql(OBS, body="""SELECT competitor_id, count(*) AS n_rows, count(DISTINCT product_id) AS n_products
  FROM (SELECT *, count(*) OVER (PARTITION BY product_id, competitor_id) AS c FROM obs) WHERE c >= 5 GROUP BY competitor_id"""))
def minimum_history_filter(spark, d):
    kept = H.minimum_history(observations(spark, d), 5, SERIES)
    return kept.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("product_id").alias("n_products")
    )


@query("history_levels", with_sql(OBS, body=f"""SELECT mh, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_products FROM
  (SELECT product_id, count(*) AS c FROM obs GROUP BY product_id) JOIN (SELECT unnest({LEVELS}) AS mh) ON c >= mh GROUP BY mh"""))
def history_levels(spark, d):
    return H.history_levels(observations(spark, d), H.parse_levels(["mh30", 5, "20", "mh25", 35, "mh5"]))


@query("valid_price_rows", with_sql(OBS, body=f"""SELECT run_id, count(*) AS n_valid, {r6_sql('sum(CAST(price AS DECIMAL(18,4)))', 'total')} FROM obs
  WHERE price > 0 GROUP BY run_id"""))
def valid_price_rows(spark, d):
    return H.valid_prices(observations(spark, d)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_valid"), r6(F.sum(F.col("price").cast("decimal(18,4)")), "total")
    )


@query("status_filter", """SELECT o_orderpriority, count(*) AS n FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN ' OK ' WHEN 'F' THEN 'Failed'
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'success' END END AS status FROM orders)
  WHERE lower(trim(coalesce(status, ''))) IN ('', 'ok', 'success') GROUP BY o_orderpriority""")
def status_filter(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", " OK ").when(F.col("o_orderstatus") == "F", "Failed").otherwise(
        F.when(F.col("o_orderkey") % 2 == 0, None).otherwise("success")
    )
    orders = table(spark, d, "orders").withColumn("status", status)
    return orders.filter(H.ok_status()).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("evaluation_row_index", with_sql(OBS, body=f"""SELECT obs_id, row_number() OVER (ORDER BY seen_at, obs_id) - 1 AS evaluation_row_id,
  {r6_sql('price', 'original_price')}, false AS is_injected, '' AS anomaly_type FROM obs"""))
def evaluation_row_index(spark, d):
    """Evaluation columns with defaults, and a row index over the total order."""
    obs = observations(spark, d).withColumns({
        "original_price": F.col("price"), "is_injected": F.lit(False), "anomaly_type": F.lit(""),
    })
    day = F.datediff("seen_at", F.lit("1970-01-01")).cast("long")
    # Within a day the order is that of the ids, so their first characters refine the bucket.
    indexed = H.row_index(obs, ORDER, day * 65536 + H.text_bucket("obs_id"))
    return rounded(indexed, "original_price").select(
        "obs_id", "evaluation_row_id", "original_price", "is_injected", "anomaly_type"
    )


@query("reindexed_union", with_sql(OBS, body="""SELECT country, min(i) AS first_id, max(i) AS last_id, count(DISTINCT i) AS n_ids FROM
  (SELECT country, row_number() OVER (ORDER BY country, seen_at, obs_id) - 1 AS i FROM obs) GROUP BY country"""))
def reindexed_union(spark, d):
    """Row ids unique over a union of datasets: each dataset's ids follow the one before."""
    obs = observations(spark, d)
    place = F.substring("country", -1, 1).cast("long") * 100_000 + F.datediff("seen_at", F.lit("1970-01-01"))
    bucket = place * 65536 + H.text_bucket("obs_id")
    indexed = H.row_index(obs, ["country", *ORDER], bucket, name="i")
    return indexed.groupBy("country").agg(
        F.min("i").alias("first_id"), F.max("i").alias("last_id"), F.count_distinct("i").alias("n_ids")
    )


@query("canonical_projection", with_sql(OBS, body=f"""SELECT obs_id, {r6_sql('price', 'evaluated_price')}, product_id,
  'schema_version,run_id,candidate_id' AS head, 'obs_id,note' AS tail FROM obs"""))
def canonical_projection(spark, d):
    obs = observations(spark, d).select(
        F.col("obs_id"), "product_id", "run_id", F.col("price").alias("evaluated_price"), F.lit("x").alias("note")
    )
    shaped = A.canonical(obs, A.INJECTED_COLUMNS)
    return rounded(shaped, "evaluated_price").select(
        "obs_id", "evaluated_price", "product_id", F.lit(",".join(shaped.columns[:3])).alias("head"),
        F.lit(",".join(shaped.columns[-2:])).alias("tail"),
    )


@query("name_normalizing", with_sql(OBS, body="""SELECT DISTINCT replace(product_name, ' ', '_') AS slug, segment_name AS split
  FROM (SELECT product_name, CASE WHEN segment = 'B2B' THEN 'new_prices' ELSE 'new_products' END AS segment_name FROM obs)"""))
def name_normalizing(spark, d):
    raw = F.when(F.col("segment") == "B2B", "_test_new_prices.parquet").otherwise("new_products.parquet")
    odd = F.concat(F.lit(" "), F.upper("product_name"), F.lit("!"))
    return observations(spark, d).select(S.slug(odd).alias("slug"), S.split_label(raw).alias("split")).distinct()


_NAMES = ["Isolation Forest", "AE", "deep_ae", "zscore", "Z-Score", "IQR", "threshold", "sanity", "my ensemble", "a+b", "Odd One"]
_FAMILY = ["isolation_forest", "ae", "autoencoder", "zscore", "zscore", "iqr", "threshold", "sanity",
           "statistical_ensemble", "combined", "odd_one"]


@query("detector_families", f"""SELECT {_FAMILY!r}[1 + user_id % 11] AS family, count(*) AS n FROM events GROUP BY 1""")
def detector_families(spark, d):
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("user_id") % 11).cast("int"))
    return table(spark, d, "events").groupBy(A.detector_family(name).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_per_model", with_sql(OBS, body="""SELECT competitor_id AS model, competitor_id || '_' || max(day) || '.parquet' AS file_name
  FROM (SELECT competitor_id, strftime(seen_at, '%Y-%m-%d') AS day FROM obs) GROUP BY competitor_id"""))
def latest_per_model(spark, d):
    day = F.when(F.col("country") == "COUNTRY_9", None).otherwise(F.date_format("seen_at", "yyyy-MM-dd"))
    files = observations(spark, d).select(
        F.col("competitor_id").alias("model"), day.alias("date_token"),
        F.concat("competitor_id", F.lit("_"), day, F.lit(".parquet")).alias("file_name"),
    )
    return P.latest_per_model(files)


@query("newest_rows_per_series", with_sql(OBS, body="""SELECT obs_id FROM (SELECT obs_id, row_number() OVER (PARTITION BY product_id, competitor_id
  ORDER BY seen_at DESC, obs_id DESC) AS b FROM obs) WHERE b <= 2"""))
def newest_rows_per_series(spark, d):
    return H.last_rows(observations(spark, d), SERIES, ORDER, 2).select("obs_id")


def split_sql(by: str = "") -> str:
    """Product and time split of ``obs`` (per ``by``) as CTEs ending in ``sp``."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    using = f"{by}, product_id" if by else "product_id"
    return f"""pr AS (SELECT DISTINCT {lead} product_id, {uniform_sql('42', 'split', 'product_id')} AS u FROM obs),
pk AS (SELECT *, row_number() OVER ({part} ORDER BY u, product_id) AS k, count(*) OVER ({part}) AS np FROM pr),
bk AS (SELECT *, row_number() OVER (PARTITION BY {using} ORDER BY seen_at DESC, obs_id DESC) AS b FROM obs),
sp AS (SELECT bk.*, CASE WHEN np > 1 AND k <= ceil(np * 0.2::DOUBLE) THEN 'new_products' WHEN b <= 2 THEN 'new_prices' ELSE 'train' END AS dataset_split
  FROM bk JOIN pk USING ({using}))"""


@query("product_time_split", with_sql(OBS, split_sql(), body="SELECT obs_id, dataset_split FROM sp"))
def product_time_split(spark, d):
    return P.split_observations(observations(spark, d)).select("obs_id", "dataset_split")


@query("split_inventory_by_country", with_sql(OBS, split_sql("country"), body="""SELECT country, dataset_split, count(*) AS n_rows,
  count(DISTINCT product_id) AS n_products FROM sp GROUP BY country, dataset_split"""))
def split_inventory_by_country(spark, d):
    obs = observations(spark, d)
    P.require_products(obs)
    return P.split_inventory(P.split_observations(obs, by=["country"]), ["country"])


SCOPED = """scoped AS (SELECT *, 'competitor' AS scope_kind, competitor_id AS scope_id FROM obs
  UNION ALL SELECT *, 'country', country FROM obs UNION ALL SELECT *, 'country_market', country || '_' || segment FROM obs
  UNION ALL SELECT *, 'global', 'global' FROM obs)"""


@query("scope_expansion", with_sql(OBS, SCOPED, body=f"""SELECT scope_kind, scope_id, count(*) AS n_rows, {r6_sql('sum(CAST(price AS DECIMAL(18,4)))', 'total')}
  FROM scoped GROUP BY scope_kind, scope_id"""))
def scope_expansion(spark, d):
    return P.expand_scopes(observations(spark, d)).groupBy("scope_kind", "scope_id").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.sum(F.col("price").cast("decimal(18,4)")), "total")
    )


@query("scope_resolution", with_sql(OBS, SCOPED, body="""SELECT scope_id, count(*) AS n_rows FROM scoped
  WHERE scope_kind = 'country' AND scope_id IN ('COUNTRY_1', 'COUNTRY_3', 'COUNTRY_4') GROUP BY scope_id"""))
def scope_resolution(spark, d):
    picked = P.select_scopes(
        P.expand_scopes(observations(spark, d)), "country", ids=["first", "pair"],
        aliases={"first": "COUNTRY_1"}, groups={"pair": ["COUNTRY_3", "COUNTRY_4"]},
    )
    return picked.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("custom_scope_groups", with_sql(OBS, body="""SELECT g AS scope_group, count(*) AS n_rows FROM obs,
  (SELECT unnest(['nordic', 'small']) AS g) WHERE (g = 'nordic' AND competitor_id IN ('SHOP_DK', 'SHOP_SE', 'SHOP_NO'))
  OR (g = 'small' AND competitor_id IN ('SHOP_NO', 'SHOP_FI')) GROUP BY g"""))
def custom_scope_groups(spark, d):
    scoped = P.expand_scopes(observations(spark, d), ["competitor"])
    groups = {"nordic": ["SHOP_DK", "SHOP_SE", "SHOP_NO"], "small": ["SHOP_NO", "SHOP_FI"]}
    return P.scope_groups(scoped, groups).groupBy("scope_group").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dataset_catalog", with_sql(OBS, SCOPED, body="""SELECT scope_kind, scope_id, count(*) AS n_rows, count(DISTINCT product_id) AS n_products,
  array_to_string(list_sort(list(DISTINCT country)), ',') AS countries FROM scoped GROUP BY scope_kind, scope_id"""))
def dataset_catalog(spark, d):
    return P.dataset_catalog(observations(spark, d))


@query("train_rows_of_tested_products", with_sql(OBS, split_sql(), body="""SELECT competitor_id, count(*) AS n_rows FROM sp WHERE dataset_split = 'train'
  AND product_id IN (SELECT product_id FROM sp WHERE dataset_split = 'new_prices') GROUP BY competitor_id"""))
def train_rows_of_tested_products(spark, d):
    split = P.split_observations(observations(spark, d))
    tested = split.filter(F.col("dataset_split") == "new_prices").select("product_id")
    train = split.filter(F.col("dataset_split") == "train")
    return train.join(tested, "product_id", "left_semi").groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("product_membership", with_sql(OBS, split_sql(), body="""SELECT p IN (SELECT product_id FROM sp WHERE dataset_split = 'new_products') AS held_out,
  count(*) AS n_products FROM (SELECT DISTINCT product_id AS p FROM obs) GROUP BY 1"""))
def product_membership(spark, d):
    obs = observations(spark, d)
    held = P.split_observations(obs).filter(F.col("dataset_split") == "new_products").select("product_id")
    products = obs.select("product_id").distinct()
    inside = products.join(held, "product_id", "left_semi").withColumn("held_out", F.lit(True))
    outside = products.join(held, "product_id", "left_anti").withColumn("held_out", F.lit(False))
    return inside.unionByName(outside).groupBy("held_out").agg(F.count(F.lit(1)).alias("n_products"))
