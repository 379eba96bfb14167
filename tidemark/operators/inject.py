"""Labelled synthetic anomalies, chosen and sized by hashes of row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import hash_uniform, literal_map
from tidemark.plans.skew import hash_cut, join_small, small_table, up_to_cut

# Swap target and price factor per currency, price floor, co-scaled types.
SWAP_TARGET = {
    "CURRENCY_1": "CURRENCY_5",
    "CURRENCY_2": "CURRENCY_5",
    "CURRENCY_3": "CURRENCY_5",
    "CURRENCY_4": "CURRENCY_5",
    "CURRENCY_5": "CURRENCY_1",
}
SWAP_FACTOR = {
    "CURRENCY_1": 10.0,
    "CURRENCY_2": 0.1,
    "CURRENCY_3": 1.4,
    "CURRENCY_4": 0.7,
    "CURRENCY_5": 0.1,
}
PRICE_FLOOR = 1.0
CO_SCALED = [
    "price_spike", "price_drop", "price_noise", "extreme_outlier", "decimal_shift", "currency_swap",
    "transient_spike", "persistent_change",
]
DEFAULT_TYPES = ["price_spike", "price_drop", "decimal_shift", "list_price_violation"]
ALL_TYPES = [
    "price_spike", "price_drop", "price_noise", "list_price_violation", "zero_price", "negative_price",
    "extreme_outlier", "title_collapse", "decimal_shift", "currency_swap", "transient_spike",
    "persistent_change",
]
# Weights of the record-level injector.
RECORD_WEIGHTS = {
    "price_spike": 0.15,
    "price_drop": 0.15,
    "price_noise": 0.10,
    "list_price_violation": 0.08,
    "zero_price": 0.07,
    "negative_price": 0.05,
    "extreme_outlier": 0.10,
    "title_collapse": 0.10,
    "decimal_shift": 0.10,
    "currency_swap": 0.05,
    "transient_spike": 0.03,
    "persistent_change": 0.02,
}


def _swap(mapping: dict, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), F.upper(F.trim("currency"))), F.lit(default))


def changed_price(
    kind: Column, u: Column, side: Column, spike: tuple[float, float] = (2.0, 5.0),
    drop: tuple[float, float] = (0.1, 0.5), mean: Column | None = None, std: Column | None = None,
) -> Column:
    """Price after an anomaly of ``kind``; ``u`` sizes it and ``side`` picks a direction."""
    price, listed = F.col("price"), F.col("list_price")
    mean = F.lit(None).cast("double") if mean is None else mean
    std = F.lit(None).cast("double") if std is None else std

    def between(low: float, high: float) -> Column:
        return F.lit(low) + u * F.lit(high - low)

    def floored(value: Column) -> Column:
        return F.greatest(F.lit(PRICE_FLOOR), value)

    sign = F.when(side < 0.5, -1.0).otherwise(1.0)
    return (
        F.when(kind == "price_spike", price * between(*spike))
        .when(kind == "price_drop", floored(price * between(*drop)))
        .when(kind == "price_noise", floored(price * (1 + between(-0.3, 0.3))))
        .when(kind == "list_price_violation",
              F.when(listed > 0, listed * between(1.1, 1.5)).otherwise(price * between(1.3, 1.8)))
        .when(kind == "zero_price", 0.0)
        .when(kind == "negative_price", -F.abs(price * between(0.1, 0.5)))
        .when(kind == "extreme_outlier", floored(mean + sign * between(4.0, 8.0) * std))
        .when(kind == "title_collapse", price * between(0.5, 1.5))
        .when(kind == "decimal_shift", floored(price * F.when(side < 0.5, 100.0).otherwise(0.01)))
        .when(kind == "currency_swap", floored(price * _swap(SWAP_FACTOR, 10.0)))
        .when(kind == "transient_spike", price * between(1.5, 3.0))
        .when(kind == "persistent_change", floored(price * between(0.7, 1.3)))
        .otherwise(price)
    )


def apply_types(df: DataFrame, seed: int | Column, ident: str, **options) -> DataFrame:
    """Rewrite price, list price, currency and title of rows with an ``anomaly_type``."""
    kind = F.col("anomaly_type")
    u = hash_uniform(seed, "size", F.col(ident))
    side = hash_uniform(seed, "side", F.col(ident))
    out = df.withColumn("original_price", F.col("price")).withColumn(
        "_new", F.when(kind.isNotNull(), changed_price(kind, u, side, **options)).otherwise(F.col("price"))
    )
    scale = F.col("_new") / F.col("price")
    scaled = F.col("list_price") * scale
    listed = F.when(
        kind.isin(CO_SCALED) & (F.col("list_price") > 0) & (F.col("price") > 0),
        F.when(scale < 1.0, F.greatest(F.lit(PRICE_FLOOR), scaled)).otherwise(scaled),
    ).otherwise(F.col("list_price"))
    columns = {
        "list_price": listed,
        "change_pct": F.when(kind.isNotNull() & (F.col("price") != 0), (F.col("_new") - F.col("price")) / F.col("price")),
        "price": F.col("_new"),
    }
    if "currency" in df.columns:
        columns["currency"] = F.when(kind == "currency_swap", _swap(SWAP_TARGET, "CURRENCY_5")).otherwise(
            F.col("currency")
        )
    if "product_name" in df.columns:
        length = F.length("product_name")
        kept = F.greatest(F.lit(5), F.floor(length / 5).cast("int"))
        columns["product_name"] = F.when(
            (kind == "title_collapse") & (length > 5), F.substring("product_name", F.lit(1), kept)
        ).otherwise(F.col("product_name"))
    return out.withColumns(columns).drop("_new")


def inject(
    df: DataFrame, by: Sequence[str] = (), rate: float = 0.1, seed: int | Column = 42,
    types: Sequence[str] = tuple(DEFAULT_TYPES), ident: str = "obs_id",
    spike: tuple[float, float] = (2.0, 5.0), drop: tuple[float, float] = (0.1, 0.5),
) -> DataFrame:
    """Inject max(1, floor(rate x n)) anomalies per group into rows with a valid price.

    Phase 1 gives list-price violations their 1/k share among rows with a list
    price; phase 2 picks among the rest and draws the other types evenly. Both
    choices are hash cuts: two small histograms instead of a shuffle of rows.
    ``seed`` may be a column of ``by``, for several trials at once.
    """
    by, types = list(by), list(types)
    valid = F.coalesce(F.col("price") > 0, F.lit(False))
    listed = valid & F.coalesce(F.col("list_price") > 0, F.lit(False))
    base = df.withColumns({
        "_u1": hash_uniform(seed, "phase1", F.col(ident)),
        "_u2": hash_uniform(seed, "phase2", F.col(ident)),
    })
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_valid"), F.count_if(listed).alias("_listed"),
        F.avg(F.when(valid, F.col("price"))).alias("_mean"),
        F.stddev_samp(F.when(valid, F.col("price"))).alias("_std"),
    )
    budget = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(rate))), F.col("_valid"))
    has_first = "list_price_violation" in types
    share = F.least(F.col("_listed"), F.floor(budget / len(types))) if has_first else F.lit(0)
    totals = totals.withColumn("_first", share.cast("long")).withColumn("_second", (budget - share).cast("long"))
    totals = small_table(totals, "injection-totals")
    limits = totals.select(*by, F.col("_first").alias("_limit"))
    cut1 = small_table(hash_cut(base.filter(listed), by, "_u1", ident, limits), "injection-cut")
    one = join_small(base, cut1, by, "left").withColumn("_p1", listed & up_to_cut("_u1", ident)).drop("_cut_u", "_cut_id")
    rest = valid & ~F.col("_p1")
    others = [t for t in types if t != "list_price_violation"]
    if others:
        limits = totals.select(*by, F.col("_second").alias("_limit"))
        cut2 = small_table(hash_cut(one.filter(rest), by, "_u2", ident, limits), "injection-cut")
        two = join_small(one, cut2, by, "left").withColumn("_p2", rest & up_to_cut("_u2", ident))
        pick = F.floor(hash_uniform(seed, "type", F.col(ident)) * len(others)).cast("int")
        kind = F.when(F.col("_p1"), "list_price_violation").when(
            F.col("_p2"), F.get(F.array(*[F.lit(t) for t in others]), pick)
        )
        phase = F.when(F.col("_p1"), 1).when(F.col("_p2"), 2)
    else:
        two = one
        kind, phase = F.when(F.col("_p1"), "list_price_violation"), F.when(F.col("_p1"), 1)
    typed = join_small(
        two.withColumns({"anomaly_type": kind, "injection_phase": phase}),
        totals.select(*by, "_mean", F.coalesce("_std", F.col("_mean") * 0.1).alias("_std")), by,
    )
    done = apply_types(typed, seed, ident, spike=spike, drop=drop, mean=F.col("_mean"), std=F.col("_std"))
    done = done.withColumn("is_injected", F.col("anomaly_type").isNotNull())
    extra = ["original_price", "anomaly_type", "injection_phase", "change_pct", "is_injected"]
    return done.select(*df.columns, *extra)


def inject_records(df: DataFrame, rate: float = 0.05, seed: int = 42, ident: str = "obs_id") -> DataFrame:
    """Record-level injector: each record independently with probability ``rate``, weighted types."""
    draw = hash_uniform(seed, "type", F.col(ident))
    kind, top = F.lit("persistent_change"), 1.0
    for name, weight in reversed(RECORD_WEIGHTS.items()):
        kind = F.when(draw < F.lit(round(top, 10)), F.lit(name)).otherwise(kind)
        top -= weight
    chosen = (hash_uniform(seed, "pick", F.col(ident)) < rate) & (F.col("price") > 0)
    typed = df.withColumn("anomaly_type", F.when(chosen, kind))
    stats = df.filter(F.col("price") > 0).agg(F.avg("price").alias("_mean"), F.stddev_samp("price").alias("_std"))
    out = apply_types(join_small(typed, stats, []), seed, ident, spike=(2.0, 2.0), drop=(0.3, 0.3),
                      mean=F.col("_mean"), std=F.col("_std"))
    return out.withColumn("is_injected", F.col("anomaly_type").isNotNull()).drop("_mean", "_std")


def all_variants(
    df: DataFrame, seed: int = 42, types: Sequence[str] = tuple(DEFAULT_TYPES), ident: str = "obs_id"
) -> DataFrame:
    """Each row unchanged and once per anomaly type."""
    options = F.array(F.lit(None).cast("string"), *[F.lit(t) for t in types])
    typed = df.filter(F.col("price") > 0).withColumn("anomaly_type", F.explode(options))
    return apply_types(typed, seed, ident)
