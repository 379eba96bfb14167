"""Scans, scrape parsing, path attributes, contract checks and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    OBS, ORDER, observations, query, r6, r6_sql, rounded, table, with_sql,
)
from tidemark.functions import scalar as S
from tidemark.session import scratch_path
from tidemark.sources import artifacts as A
from tidemark.sources import observations as O
from tidemark.sources import scrapes as J


def raw_lines(spark, d):
    """JSON scrape lines in every shape the parser knows, one per observation."""
    obs = observations(spark, d)
    line = F.split("obs_id", "-")[1].cast("int")
    price = F.col("price").cast("string")
    full = F.col("list_price").cast("string")
    iso = F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit('{"competitor_product_id":"'), F.col("product_id"), F.lit('","competitor":"'), F.col("competitor_id"),
        F.lit('","scraped_at":"'), iso, F.lit('","scrape_run_id":"'), F.col("run_id"), F.lit('",'),
    )
    name = F.concat(F.lit('"product_name":"'), F.col("product_name"), F.lit('",'))
    price_text = F.coalesce(price, F.lit("null"))
    flat = F.concat(head, name, F.lit('"pricing":{"price":'), price_text, F.lit(',"currency":"'),
                    F.coalesce("currency", F.lit("")), F.lit('","list_price":'), F.coalesce(full, F.lit("null")),
                    F.lit('},"ean":"'), F.col("product_id") % 7, F.lit('","images":["http://x/'),
                    F.col("product_id"), F.lit('.png"]}'))
    nested = F.concat(head, name, F.lit('"pricing":{"price":{"currency":"EUR","current":['),
                      F.coalesce(full, F.lit("null")), F.lit(","), price_text,
                      F.lit(']}},"availability":{"online":{"status":"in_stock"}}}'))
    single = F.concat(head, F.lit('"pricing":{"price":{"current":['), price_text, F.lit("]}}}"))
    api = F.concat(head, F.lit('"api_product":{"name":"api '), F.col("product_name"),
                   F.lit('","brand":"acme","price":{"currency":"SEK","current":['), price_text,
                   F.lit(']}},"image_url":"http://x/placeholder.png"}'))
    text_price = F.concat(head, F.lit('"pricing":{"price":"'), price_text, F.lit('"}}'))
    no_shop = F.concat(F.lit('{"competitor_product_id":"'), F.col("product_id"),
                       F.lit('","pricing":{"price":'), price_text, F.lit('}}'))
    broken = F.substring(flat, 1, 40)
    value = (
        F.when(line == 1, flat).when(line == 2, nested).when(line == 3, single).when(line == 4, api)
        .when(line == 5, text_price).when(line == 6, no_shop).otherwise(broken)
    )
    return obs.select("obs_id", "run_id", value.alias("value"))


# What each line should parse to, stated on the observation itself.
PARSED = """ln AS (SELECT *, CAST(split_part(obs_id, '-', 2) AS INTEGER) AS line_no FROM obs),
cur AS (SELECT *, CASE competitor_id WHEN 'SHOP_DK' THEN 'DKK' WHEN 'SHOP_SE' THEN 'SEK' WHEN 'SHOP_NO' THEN 'NOK' WHEN 'SHOP_FI' THEN 'EUR' END AS inferred,
  CASE WHEN line_no = 2 THEN coalesce(price, list_price) ELSE price END AS got_price FROM ln),
parsed AS (SELECT obs_id, run_id, competitor_id, product_id, line_no,
  CASE WHEN line_no = 7 THEN 'json_decode_error' WHEN line_no = 6 OR got_price IS NULL THEN 'missing_required_fields' END AS error_type,
  CASE WHEN line_no = 7 THEN '' WHEN line_no = 6 THEN concat_ws(',', 'competitor', CASE WHEN got_price IS NULL THEN 'price' END, 'scraped_at')
    WHEN got_price IS NULL THEN 'price' ELSE '' END AS missing,
  got_price AS price,
  CASE line_no WHEN 1 THEN list_price WHEN 2 THEN list_price WHEN 3 THEN price WHEN 4 THEN price END AS list_price,
  CASE line_no WHEN 1 THEN coalesce(currency, inferred) WHEN 2 THEN 'EUR' WHEN 4 THEN 'SEK' ELSE inferred END AS currency,
  CASE line_no WHEN 1 THEN product_name WHEN 2 THEN product_name WHEN 4 THEN 'api ' || product_name END AS product_name,
  CASE line_no WHEN 4 THEN 'acme' END AS brand,
  CASE line_no WHEN 2 THEN 'in_stock' END AS availability_status,
  CASE line_no WHEN 1 THEN CAST(product_id % 7 AS VARCHAR) END AS ean,
  CASE line_no WHEN 1 THEN 'http://x/' || product_id || '.png' WHEN 4 THEN 'http://x/placeholder.png' END AS images,
  seen_at FROM cur)"""


@query("scrape_records", with_sql(OBS, PARSED, body=f"""SELECT obs_id, {r6_sql('price', 'price')},
  {r6_sql('list_price', 'list_price')}, currency, product_name, brand, availability_status, ean, images,
  strftime(seen_at, '%Y-%m-%d') AS scraped_day FROM parsed WHERE error_type IS NULL"""))
def scrape_records(spark, d):
    good = J.good_records(J.parse_scrapes(raw_lines(spark, d)))
    return rounded(good, "price", "list_price").select(
        "obs_id", "price", "list_price", "currency", "product_name", "brand", "availability_status", "ean",
        F.array_join("image_urls", ",").alias("images"), F.date_format("scraped_at", "yyyy-MM-dd").alias("scraped_day"),
    )


@query("scrape_rejects", with_sql(OBS, PARSED, body="""SELECT error_type, missing, count(*) AS n_lines
  FROM parsed WHERE error_type IS NOT NULL GROUP BY error_type, missing"""))
def scrape_rejects(spark, d):
    bad = J.rejects(J.parse_scrapes(raw_lines(spark, d)))
    missing = F.coalesce(F.array_join("missing_fields", ","), F.lit("")).alias("missing")
    return bad.groupBy("error_type", missing).agg(F.count(F.lit(1)).alias("n_lines"))


@query("parse_statistics", with_sql(OBS, PARSED, body="""SELECT run_id, count(*) AS total_lines,
  count(*) FILTER (error_type IS NULL) AS parsed, count(*) FILTER (error_type IS NOT NULL) AS failed,
  count(*) FILTER (error_type = 'json_decode_error') AS json_decode_errors,
  count(*) FILTER (error_type = 'missing_required_fields') AS missing_field_errors FROM parsed GROUP BY run_id"""))
def parse_statistics(spark, d):
    return J.parse_statistics(J.parse_scrapes(raw_lines(spark, d)), ["run_id"])


@query("scrape_files_round_trip", with_sql(OBS, PARSED, body="""SELECT coalesce(competitor_id, '') AS competitor, count(*) AS n
  FROM parsed WHERE error_type IS NULL GROUP BY 1"""))
def scrape_files_round_trip(spark, d):
    """Lines written as text files, blank lines between them, and read back."""
    path = scratch_path(spark, "scrape-lines")
    lines = raw_lines(spark, d).select(F.explode(F.array(F.col("value"), F.lit("   "))).alias("value"))
    lines.write.text(path)
    return J.good_records(J.read_scrapes(spark, path)).groupBy("competitor").agg(F.count(F.lit(1)).alias("n"))


def _observation_tree(spark, d):
    """Observations as one directory per country, segment and shop, plus a split file to be skipped."""
    obs = observations(spark, d)
    root = scratch_path(spark, "by-competitor")
    leaf = F.concat("competitor_id", F.lit("_"), F.date_format("seen_at", "yyyy-01-01"))
    tagged = obs.withColumns({"_country": F.col("country"), "_leaf": leaf})
    # One file per directory of this small tree; directories carry Hive-style keys.
    parts = ["_country", "segment", "_leaf"]
    tagged.repartition(*parts).write.partitionBy(*parts).parquet(root)
    return root


@query("observation_scan", with_sql(OBS, body="""SELECT country, segment, competitor_id,
  strftime(seen_at, '%Y-01-01') AS date_token, count(*) AS n_rows FROM obs
  GROUP BY ALL"""))
def observation_scan(spark, d):
    """Recursive scan with attributes taken from the path alone."""
    root = _observation_tree(spark, d)
    df = spark.read.option("recursiveFileLookup", "true").parquet(root)
    path = F.url_decode(F.col("_metadata.file_path"))
    plain = F.concat(F.regexp_replace(F.regexp_replace(path, "/part-[^/]*$", ".parquet"), r"/[A-Za-z_]+=", "/"))
    out = df.withColumns({**O.path_attributes(plain)})
    return out.groupBy(
        F.col("path_country").alias("country"), F.col("path_segment").alias("segment"),
        F.col("path_competitor").alias("competitor_id"), F.col("path_date").alias("date_token"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query("split_files_skipped", with_sql(OBS, body="SELECT count(*) AS n_rows FROM obs"))
def split_files_skipped(spark, d):
    """A tree with a full file and its train and test splits: only the full file is scanned."""
    root = scratch_path(spark, "tree")
    obs = observations(spark, d).drop("country", "segment")
    half = F.crc32("obs_id") % 2
    obs.write.parquet(f"{root}/COUNTRY_1/B2C/SHOP_DK_2024-01-01.parquet")
    obs.filter(half == 0).write.parquet(f"{root}/COUNTRY_1/B2C/SHOP_DK_2024-01-01_train.parquet")
    obs.filter(half == 1).write.parquet(f"{root}/COUNTRY_1/B2C/SHOP_DK_2024-01-01_test_new_prices.parquet")
    return O.read_observations(spark, root).agg(F.count(F.lit(1)).alias("n_rows"))


@query("source_contract", """SELECT 'lineitem.parquet' AS file_name, 'changed' AS problem
  UNION ALL SELECT 'extra.parquet', 'missing' UNION ALL SELECT 'region.parquet', 'unexpected'""")
def source_contract(spark, d):
    """Rows per file against a manifest that has one wrong count, one extra and one absent file."""
    names = ["region", "nation", "lineitem", "orders"]
    scans = None
    for name in names:
        one = spark.read.parquet(f"{d}/{name}.parquet")
        rows = O.file_rows(one)
        scans = rows if scans is None else scans.unionByName(rows)
    manifest = (
        scans.filter(F.col("file_name") != "region.parquet")
        .withColumn("n_rows", F.col("n_rows") + F.when(F.col("file_name") == "lineitem.parquet", 1).otherwise(0))
        .unionByName(spark.range(1).select(F.lit("extra.parquet").alias("file_name"), F.lit(1).cast("long").alias("n_rows")))
    )
    return O.inventory_mismatches(scans, manifest, ["n_rows"])


@query("file_inventory")
def file_inventory(spark, d):
    return O.inventory(spark, d)


@query("schema_aligned_union", with_sql(OBS, body=f"""SELECT segment, count(*) AS n_rows, count(list_price) AS n_listed,
  {r6_sql('sum(CAST(price AS DECIMAL(18,4)))', 'total')} FROM (SELECT segment, price, list_price FROM obs WHERE segment = 'B2B'
  UNION ALL SELECT segment, floor(price) AS price, NULL AS list_price FROM obs WHERE segment = 'B2C') GROUP BY segment"""))
def schema_aligned_union(spark, d):
    """Second frame: price as text of whole units, no list price, one extra column."""
    obs = observations(spark, d).select("segment", "price", "list_price")
    other = obs.filter(F.col("segment") == "B2C").select(
        F.floor("price").cast("string").alias("price"), "segment", F.lit(1).alias("surplus")
    )
    both = O.align_union([obs.filter(F.col("segment") == "B2B"), other])
    return both.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("list_price").alias("n_listed"), r6(F.sum(F.col("price").cast("decimal(18,4)")), "total")
    )


@query("partitioned_sink", with_sql(OBS, body="""SELECT mh, segment AS split, count(*) AS n_rows FROM
  (SELECT *, count(*) OVER (PARTITION BY product_id) AS c FROM obs) JOIN (SELECT unnest([5, 25, 30]) AS mh) ON c >= mh
  GROUP BY mh, segment"""))
def partitioned_sink(spark, d):
    """Subsets by history level written once as a partitioned table and read back pruned."""
    from tidemark.operators.history import expand_levels

    subsets = expand_levels(observations(spark, d), [5, 25, 30]).withColumnRenamed("segment", "split")
    path = A.write_partitioned(subsets, scratch_path(spark, "subsets"), ["mh", "split"])
    A.write_partitioned(subsets, path, ["mh", "split"], skip_existing=True)
    return spark.read.parquet(path).groupBy("mh", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("consolidated_predictions", with_sql(OBS, body="""SELECT country AS model, 'new_prices' AS test_scenario,
  CASE WHEN segment = 'B2B' THEN 'zscore' ELSE 'iqr' END AS detector_combo, count(*) AS n_rows,
  count(*) FILTER (price > list_price) AS n_flagged FROM obs GROUP BY ALL"""))
def consolidated_predictions(spark, d):
    """Per-detector outputs, named by model, scenario and detector, read as one table."""
    root = scratch_path(spark, "predictions")
    obs = observations(spark, d)
    flag = F.coalesce(F.col("price") > F.col("list_price"), F.lit(False))
    for country in (f"COUNTRY_{i}" for i in range(1, 5)):
        for segment, detector in (("B2B", "zscore"), ("B2C", "iqr")):
            part = obs.filter((F.col("country") == country) & (F.col("segment") == segment))
            part.select("obs_id", flag.alias("flagged")).write.parquet(
                f"{root}/{country}__new_prices__{detector}.parquet"
            )
    return A.consolidate_predictions(spark, root).groupBy("model", "test_scenario", "detector_combo").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("flagged").alias("n_flagged")
    )


@query("harvested_results", with_sql(OBS, body=f"""SELECT competitor_id AS scope_id, mh,
  CASE WHEN competitor_id = 'SHOP_XX' THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN competitor_id = 'SHOP_XX' THEN NULL ELSE c::DOUBLE END AS n_rows FROM
  (SELECT competitor_id, count(*) AS c FROM obs GROUP BY competitor_id), (SELECT unnest([5, 10]) AS mh)"""))
def harvested_results(spark, d):
    """Nested JSON result files, one of them unreadable, as rows with a status."""
    counts = observations(spark, d).groupBy("competitor_id").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("competitor_id") == "SHOP_XX", F.lit('{"best": {'))\
        .otherwise(F.to_json(F.struct(F.struct(F.col("n").alias("n_rows")).alias("best"))))
    root = scratch_path(spark, "results")
    made = counts.select("competitor_id", F.explode(F.array(F.lit(5), F.lit(10))).alias("mh"), text.alias("value"))
    for shop in ("SHOP_DK", "SHOP_SE", "SHOP_NO", "SHOP_FI", "SHOP_XX"):
        for mh in (5, 10):
            one = made.filter((F.col("competitor_id") == shop) & (F.col("mh") == mh)).select("value")
            one.coalesce(1).write.option("lineSep", "\n").text(f"{root}/{shop}/mh{mh}/best_configuration")
    rows = A.harvest_results(spark, root, "best STRUCT<n_rows: DOUBLE>")
    return rows.select("scope_id", "mh", "status", F.col("best.n_rows").alias("n_rows"))


@query("currency_from_suffix", with_sql(OBS, body="""SELECT competitor_id,
  CASE competitor_id WHEN 'SHOP_DK' THEN 'DKK' WHEN 'SHOP_SE' THEN 'SEK' WHEN 'SHOP_NO' THEN 'NOK' WHEN 'SHOP_FI' THEN 'EUR' END AS currency,
  count(*) AS n FROM obs GROUP BY competitor_id"""))
def currency_from_suffix(spark, d):
    currency = S.competitor_currency(F.lower("competitor_id"))
    return observations(spark, d).groupBy("competitor_id", currency.alias("currency")).agg(
        F.count(F.lit(1)).alias("n")
    )
