"""Dataset preparation: scopes, product and time splits, inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import hash_uniform
from tidemark.operators.history import last_rows
from tidemark.plans.skew import hash_cut, join_small, null_safe_join, small_table, up_to_cut

SCOPES = {
    "competitor": ["competitor_id"],
    "country": ["country"],
    "country_market": ["country", "segment"],
    "global": [],
}


def expand_scopes(df: DataFrame, kinds: Sequence[str] = tuple(SCOPES)) -> DataFrame:
    """Each row once per scope it belongs to, as ``scope_kind`` and ``scope_id``."""

    def ident(kind: str) -> Column:
        columns = SCOPES[kind]
        return F.concat_ws("_", *columns) if columns else F.lit("global")

    scopes = F.array(*[
        F.struct(F.lit(k).alias("scope_kind"), ident(k).alias("scope_id")) for k in kinds
    ])
    return df.withColumn("_s", F.explode(scopes)).select(*df.columns, "_s.scope_kind", "_s.scope_id")


def select_scopes(
    df: DataFrame, kind: str, ids: Sequence[str] = (), aliases: Mapping[str, str] | None = None,
    groups: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows of the wanted scopes. An id may be an alias, or the name of a group of ids."""
    aliases, groups = dict(aliases or {}), dict(groups or {})
    wanted: list[str] = []
    for item in ids:
        for member in groups.get(item, [item]):
            wanted.append(aliases.get(member, member))
    scoped = df.filter(F.col("scope_kind") == kind)
    return scoped.filter(F.col("scope_id").isin(wanted)) if ids else scoped


def scope_groups(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows once per custom group of scope ids that holds their scope."""
    pairs = F.array(*[
        F.when(F.col("scope_id").isin(list(ids)), F.lit(name)) for name, ids in groups.items()
    ])
    return df.withColumn("scope_group", F.explode(F.array_compact(pairs)))


def split_observations(
    df: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("seen_at", "obs_id"),
    share: float = 0.2, last_n: int = 2, seed: int = 42, product: str = "product_id",
) -> DataFrame:
    """Add ``dataset_split``: new_products, new_prices or train, per scope in ``by``.

    The first ceil(share x n) products by hash are new products; of the others
    the newest ``last_n`` rows are new prices. A scope with one product trains
    on it.
    """
    by, order = list(by), list(order)
    products = df.select(*by, product).distinct().withColumn("_u", hash_uniform(seed, "split", F.col(product)))
    sizes = products.groupBy(*by).agg(F.count(F.lit(1)).alias("_products"))
    limits = sizes.select(
        *by, F.when(F.col("_products") > 1, F.ceil(F.col("_products") * F.lit(share))).otherwise(0).alias("_limit")
    )
    cut = small_table(hash_cut(products, by, "_u", product, limits), "split-cut")
    # Start of each product's hold-out: the oldest of its newest rows, a rank limit Spark applies early.
    start = last_rows(df.select(*by, product, *order), [*by, product], order, last_n).groupBy(*by, product).agg(
        F.min(F.struct(*order)).alias("_start")
    )
    marked = join_small(products, cut, by, "left").select(
        *by, product, up_to_cut("_u", product).alias("_new")
    )
    marked = null_safe_join(marked, start, [*by, product])
    split = F.when(F.col("_new"), "new_products").when(
        F.struct(*order) >= F.col("_start"), "new_prices"
    ).otherwise("train")
    return null_safe_join(df, marked, [*by, product]).withColumn("dataset_split", split).select(*df.columns, "dataset_split")


def require_products(df: DataFrame, minimum: int = 2, product: str = "product_id") -> None:
    """Raise when fewer than ``minimum`` products are left to split."""
    found = df.select(product).distinct().limit(minimum).count()
    if found < minimum:
        raise ValueError(f"need at least {minimum} products, found {found}")


def split_inventory(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and products of every split."""
    per_product = df.groupBy(*by, "dataset_split", "product_id").agg(F.count(F.lit(1)).alias("_rows"))
    return per_product.groupBy(*by, "dataset_split").agg(
        F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_products")
    )


def latest_per_model(files: DataFrame) -> DataFrame:
    """Newest dated file of each model; undated files only where a model has no dated one."""
    return files.groupBy("model").agg(
        F.max_by("file_name", F.struct(F.col("date_token").isNotNull(), F.col("date_token"), F.col("file_name"))).alias("file_name")
    )


def dataset_catalog(df: DataFrame) -> DataFrame:
    """Countries, rows and products per scope."""
    per = expand_scopes(df).groupBy("scope_kind", "scope_id", "product_id", "country").agg(
        F.count(F.lit(1)).alias("_rows")
    )
    return per.groupBy("scope_kind", "scope_id").agg(
        F.sum("_rows").alias("n_rows"),
        F.count_distinct("product_id").alias("n_products"),
        F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"),
    )
