"""JSON-lines scrapes: parsing into records and rejects, and parse statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import competitor_currency, parse_instant

# Prices arrive as a number, as text or as an object, so they are kept as JSON text.
LINE = T.StructType([
    T.StructField("competitor_product_id", T.StringType()),
    T.StructField("competitor", T.StringType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("scrape_run_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("product_url", T.StringType()),
    T.StructField("mpn", T.StringType()),
    T.StructField("ean", T.StringType()),
    T.StructField("pricing", T.StructType([
        T.StructField("price", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("list_price", T.StringType()),
    ])),
    T.StructField("api_product", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.StringType()),
    ])),
    T.StructField("availability", T.StructType([
        T.StructField("online", T.StructType([T.StructField("status", T.StringType())])),
    ])),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("image_url", T.StringType()),
    T.StructField("_broken", T.StringType()),
])


def _is_object(raw: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(raw), F.lit("{")), F.lit(False))


def _nested_prices(frame: DataFrame, raws: dict[str, Column]) -> DataFrame:
    """For each raw price, ``<name>_object`` {currency, current} and ``<name>_values``.

    Each JSON text is parsed once: the one-row explodes keep later filters
    from repeating the parse inside their condition.
    """
    objects = F.struct(*[
        F.when(_is_object(raw), F.from_json(raw, "currency STRING, current STRING")).alias(n)
        for n, raw in raws.items()
    ])
    frame = frame.withColumn("_o", F.explode(F.array(objects)))
    values = F.struct(*[F.from_json(F.col("_o")[n]["current"], "ARRAY<STRING>").alias(n) for n in raws])
    return frame.withColumn("_v", F.explode(F.array(values)))


def _price_fields(name: str, raw: Column, currency: Column, list_price: Column) -> Column:
    """Price, currency and list price from a flat value or a {currency, current} object.

    Of ``current`` the second value is the price when present, else the first;
    the first is the list price. ``current`` may also be a bare number.
    """
    item, values = F.col("_o")[name], F.col("_v")[name]
    nested = item.isNotNull()
    is_list = nested & values.isNotNull()
    price = F.when(is_list, F.coalesce(F.get(values, 1), F.get(values, 0))).when(
        nested, item["current"]
    ).otherwise(raw)
    return F.struct(
        price.try_cast("double").alias("price"),
        F.coalesce(item["currency"], currency).alias("currency"),
        F.when(is_list, F.get(values, 0)).otherwise(list_price).try_cast("double").alias("list_price"),
    )


def _either(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def parse_scrapes(lines: DataFrame, column: str = "value", run: str | None = None) -> DataFrame:
    """One row per non-blank line with ``error_type`` null for good records.

    Error kinds: json_decode_error, and missing_required_fields with the list
    of missing fields.
    """
    text = F.trim(column)
    record = F.from_json(text, LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # The one-row explode keeps later filters from repeating the parse inside their condition.
    parsed = lines.filter(text != "").withColumn("_j", F.explode(F.array(record)))
    j = F.col("_j")
    nothing = F.lit(None).cast("string")
    api_raw = j["api_product"]["price"]
    parsed = _nested_prices(parsed, {"usual": j["pricing"]["price"], "spare": api_raw})
    usual = _price_fields("usual", j["pricing"]["price"], j["pricing"]["currency"], j["pricing"]["list_price"])
    spare = _price_fields("spare", nothing, nothing, nothing)
    chosen = F.when(usual["price"].isNull() & _is_object(api_raw), spare).otherwise(usual)
    parsed = parsed.withColumn("_p", F.explode(F.array(chosen)))

    def pick(name: str) -> Column:
        return F.col("_p")[name]

    broken = j["_broken"].isNotNull() | j.isNull()
    out = parsed.select(
        *[c for c in lines.columns if c != column],
        F.col(column).alias("raw_data"),
        broken.alias("_bad"),
        j["competitor_product_id"].alias("competitor_product_id"),
        j["competitor"].alias("competitor"),
        pick("price").alias("price"),
        _either(pick("currency"), competitor_currency(j["competitor"])).alias("currency"),
        pick("list_price").alias("list_price"),
        parse_instant(j["scraped_at"]).alias("scraped_at"),
        _either(j["product_name"], j["api_product"]["name"]).alias("product_name"),
        _either(j["brand"], j["api_product"]["brand"]).alias("brand"),
        j["availability"]["online"]["status"].alias("availability_status"),
        j["scrape_run_id"].alias("scrape_run_id"),
        j["product_url"].alias("product_url"),
        j["mpn"].alias("mpn"),
        j["ean"].alias("ean"),
        F.coalesce(
            F.when(F.size(j["images"]) > 0, j["images"]),
            F.when(F.coalesce(j["image_url"], F.lit("")) != "", F.array(j["image_url"])),
        ).alias("image_urls"),
    )
    missing = F.array_compact(F.array(
        F.when(F.coalesce(F.col("competitor_product_id"), F.lit("")) == "", "competitor_product_id"),
        F.when(F.coalesce(F.col("competitor"), F.lit("")) == "", "competitor"),
        F.when(F.col("price").isNull(), "price"),
        F.when(F.col("scraped_at").isNull(), "scraped_at"),
    ))
    return out.withColumns({
        "missing_fields": F.when(~F.col("_bad"), missing),
        "error_type": F.when(F.col("_bad"), "json_decode_error").when(
            F.size(missing) > 0, "missing_required_fields"
        ),
    }).drop("_bad")


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error_type").isNull()).drop("error_type", "missing_fields")


def rejects(parsed: DataFrame) -> DataFrame:
    """The quarantine table: every bad line with its error."""
    keep = ["raw_data", "error_type", "missing_fields", "competitor_product_id", "competitor"]
    return parsed.filter(F.col("error_type").isNotNull()).select(*keep)


def parse_statistics(parsed: DataFrame, by: list[str]) -> DataFrame:
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("error_type").isNull()).alias("parsed"),
        F.count_if(F.col("error_type").isNotNull()).alias("failed"),
        F.count_if(F.col("error_type") == "json_decode_error").alias("json_decode_errors"),
        F.count_if(F.col("error_type") == "missing_required_fields").alias("missing_field_errors"),
    )


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of all text files under ``path``, with their file name."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_scrapes(lines.withColumn("source_file", F.col("_metadata.file_path")))


def stream_scrapes(spark: SparkSession, path: str) -> DataFrame:
    return parse_scrapes(spark.readStream.text(path))
