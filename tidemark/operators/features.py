"""Series features over ungated windows, and per-row feature projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import scales
from tidemark.functions.text import title_similarity
from tidemark.plans.skew import CHUNK_ROWS, null_safe_join, chunk_series, exact_median, over_series

TREE_FEATURES = [
    "price",
    "price_log",
    "price_ratio",
    "has_list_price",
    "rolling_mean",
    "rolling_std",
    "rolling_min",
    "rolling_max",
    "price_zscore",
    "price_change_pct",
    "price_vs_mean_ratio",
    "price_range_position",
]

# Category encodings.
SELLER_CODES = {"retailer": 0, "marketplace_first_party": 1, "marketplace_third_party": 2, "unknown": 0}
STOCK_CODES = {
    "in_stock": 0, "limited": 1, "out_of_stock": 2, "preorder": 3, "backorder": 3, "unknown": 3,
}
CONDITION_CODES = {
    "new": 0, "refurbished": 1, "used": 2, "open_box": 1, "demo": 1, "outlet": 1, "unknown": 0,
}


def micros(column: str = "seen_at") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def rolling_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    depth: int = S.HISTORY_DEPTH,
    time: str = "seen_at",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Previous price and mean, std, min, max, count of the ``depth`` rows before each row."""

    def build(frame: DataFrame, w: WindowSpec) -> DataFrame:
        past = w.rowsBetween(-depth, -1)
        price = F.col("price")
        return frame.withColumns({
            "previous_price": F.lag(price).over(w),
            "rolling_mean": F.avg(price).over(past),
            "rolling_std": F.stddev_samp(price).over(past),
            "rolling_min": F.min(price).over(past),
            "rolling_max": F.max(price).over(past),
            "observation_count": F.count(price).over(past),
        })

    return over_series(df, keys, order, micros(time), depth, build, chunk_rows)


def history_arrays(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    depth: int = S.HISTORY_DEPTH,
    time: str = "seen_at",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The prices of the ``depth`` rows before each row as ``history``; nulls left out."""

    def build(frame: DataFrame, w: WindowSpec) -> DataFrame:
        past = w.rowsBetween(-depth, -1)
        return frame.withColumns({
            "history": F.collect_list("price").over(past),
            "previous_price": F.lag("price").over(w),
        })

    return over_series(df, keys, order, micros(time), depth, build, chunk_rows)


def baseline_statistics(df: DataFrame, history: str = "history") -> DataFrame:
    """Mean, std, extremes, median, MAD and 5th/95th percentiles of a history array."""
    h = F.col(history)

    def percentile(p: float) -> Column:
        def pick(ordered: Column) -> Column:
            pos = F.lit(p) * (F.size(ordered) - 1)
            low = F.try_element_at(ordered, (F.floor(pos) + 1).cast("int"))
            high = F.try_element_at(ordered, (F.ceil(pos) + 1).cast("int"))
            return low + (high - low) * (pos - F.floor(pos))

        return F.when(F.size(h) > 0, S.let(F.array_sort(h), pick))

    return df.withColumns({
        "observation_count": F.size(h).cast("long"),
        "rolling_mean": scales.array_mean(h),
        "rolling_std": scales.array_std(h),
        "rolling_min": F.array_min(h),
        "rolling_max": F.array_max(h),
        "rolling_median": scales.array_median(h),
        "rolling_mad": scales.array_mad(h),
        "percentile_5": percentile(0.05),
        "percentile_95": percentile(0.95),
    })


def scoring_features(df: DataFrame) -> DataFrame:
    """z-scores and change against the baseline columns; nulls where undefined."""
    price, last = F.coalesce(F.col("price"), F.lit(0.0)), F.col("previous_price")
    return df.withColumns({
        "price_zscore": F.when(
            F.col("rolling_std") > 0, (price - F.col("rolling_mean")) / F.col("rolling_std")
        ),
        "price_change_pct": F.when((last != price) & (last > 0), (price - last) / last),
        "robust_zscore": S.robust_z(price, F.col("rolling_median"), F.col("rolling_mad")),
        "percentile_position": S.percentile_position(
            price, F.col("percentile_5"), F.col("percentile_95")
        ),
        "has_sufficient_history": F.col("observation_count") >= S.MIN_OBSERVATIONS,
    })


def tree_features(df: DataFrame) -> DataFrame:
    """The twelve model inputs from ``rolling_features`` columns, complete and finite."""
    price = F.coalesce(F.col("price"), F.lit(0.0))
    list_price, previous = F.col("list_price"), F.col("previous_price")
    ready = F.col("observation_count") >= S.MIN_OBSERVATIONS
    mean, std = F.col("rolling_mean"), F.col("rolling_std")
    low, high = F.col("rolling_min"), F.col("rolling_max")
    span = high - low

    def warm(value: Column) -> Column:
        return F.when(ready, F.coalesce(value, F.lit(0.0))).otherwise(0.0)

    features = {
        "price": price,
        "price_log": F.log(F.greatest(price, F.lit(1e-10)) + 1.0),
        "price_ratio": F.when(list_price > 0, price / list_price).otherwise(1.0),
        "has_list_price": list_price.isNotNull().cast("double"),
        "rolling_mean": warm(mean),
        "rolling_std": warm(std),
        "rolling_min": warm(low),
        "rolling_max": warm(high),
        "price_zscore": warm(F.when(std > 0, (price - mean) / std)),
        "price_change_pct": warm(
            F.when(previous > 0, (F.col("price") - previous) / previous).otherwise(0.0)
        ),
        "price_vs_mean_ratio": warm(F.when(mean > 0, price / mean).otherwise(1.0)),
        "price_range_position": warm(F.when(span > 0, (price - low) / span).otherwise(0.5)),
    }
    others = [c for c in df.columns if c not in features]
    return df.select(*others, *[v.alias(k) for k, v in features.items()])


def trainable(df: DataFrame, names: Sequence[str] = tuple(TREE_FEATURES)) -> DataFrame:
    """Rows with finite inputs and at least one temporal input away from zero."""
    finite = F.lit(True)
    for n in names:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    signal = F.lit(False)
    for n in names[4:]:
        signal = signal | (F.abs(F.col(n)) > 1e-8)
    return df.filter(finite & signal)


def feature_differences(names: Sequence[str], expected: Sequence[str]) -> dict[str, list[str]]:
    """Names that lack, names too many, and names at another place than a model was trained with."""
    return {
        "missing": [n for n in expected if n not in names],
        "extra": [n for n in names if n not in expected],
        "moved": [n for i, n in enumerate(names) if n in expected and (i >= len(expected) or expected[i] != n)],
    }


def check_model_features(names: Sequence[str], expected: Sequence[str], detector: str) -> None:
    """Raise unless the inputs are those of the training, in its order: models know them by place."""
    found = {k: v for k, v in feature_differences(names, expected).items() if v}
    if found or len(names) != len(expected):
        raise ValueError(f"{detector}: expected {len(expected)} features, got {len(names)}: {found}")


def check_feature_names(df: DataFrame, expected: Sequence[str] = tuple(TREE_FEATURES)) -> None:
    """Raise when the frame lacks expected feature columns."""
    missing = [n for n in expected if n not in df.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")


def category_median(df: DataFrame, category: str = "category") -> DataFrame:
    return exact_median(df.filter(F.col("price").isNotNull()), [category], "price", "category_median_price")


def price_features(df: DataFrame) -> DataFrame:
    """The 22 price features plus ``missing_features`` and ``is_valid``.

    Needs price, list_price, baseline statistics, previous_price,
    last_change_at, consecutive_unchanged and the context columns.
    """
    price, list_price = F.col("price"), F.col("list_price")
    usable = price.isNotNull() & (price != 0)
    history = (F.col("observation_count") >= 3) & F.col("rolling_mean").isNotNull()
    live = history & usable
    mean, std = F.col("rolling_mean"), F.col("rolling_std")
    low, high = F.col("rolling_min"), F.col("rolling_max")
    median, mad = F.col("rolling_median"), F.col("rolling_mad")
    p5, p95 = F.col("percentile_5"), F.col("percentile_95")
    category = F.col("category_median_price")
    valid = F.coalesce(price > 0, F.lit(False))

    def code(column: str, codes: dict[str, int], default: int) -> Column:
        return F.coalesce(
            F.try_element_at(S.literal_map(codes), F.lower(F.col(column))), F.lit(default)
        ).cast("double")

    features = {
        "price": F.when(valid, price),
        "price_log": F.when(valid, F.log(price)),
        "price_ratio": F.when(usable & (list_price > 0), price / list_price).otherwise(1.0),
        "price_change_pct": F.when(live, S.pct_change(price, F.col("previous_price"), 0.0)).otherwise(0.0),
        "price_zscore": F.when(live & (std > 0), (price - mean) / std).otherwise(0.0),
        "price_vs_mean_ratio": F.when(live, S.ratio(price, mean)).otherwise(1.0),
        "price_range_position": F.when(
            live & (low != 0) & (high != 0) & (high - low > 0), (price - low) / (high - low)
        ).otherwise(0.5),
        "rolling_median": median,
        "rolling_mad": mad,
        "robust_zscore": F.when(
            usable & median.isNotNull(),
            F.when(mad > 0, (price - median) / (F.lit(S.MAD_NORMAL) * mad)).otherwise(
                F.when(price == median, 0.0).otherwise(10.0)
            ),
        ).otherwise(0.0),
        "price_percentile_position": F.when(
            usable & p5.isNotNull() & p95.isNotNull() & (p95 - p5 > 0),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (price - p5) / (p95 - p5))),
        ).otherwise(0.5),
        "days_since_change": (micros("seen_at") - micros("last_change_at")) / 8.64e10,
        "consecutive_unchanged": F.col("consecutive_unchanged").cast("double"),
        "is_persistent_change": (F.col("consecutive_unchanged") >= 1).cast("double"),
        "price_vs_category": F.when(usable & (category != 0), price / category).otherwise(1.0),
        "seller_type_encoded": code("seller_type", SELLER_CODES, 0),
        "is_club_price": F.col("is_club_price").cast("double"),
        "has_promotion": F.col("has_promotion").cast("double"),
        "expected_discount": F.when(
            F.col("has_promotion") & (F.col("discount_amount") != 0) & usable,
            F.col("discount_amount") / price,
        ).otherwise(0.0),
        "stock_status_encoded": code("stock_status", STOCK_CODES, 3),
        "is_outlet": F.col("is_outlet").cast("double"),
        "condition_encoded": code("item_condition", CONDITION_CODES, 0),
    }
    cold = ~history
    missing = F.array_compact(F.array(
        F.when(~valid, "price"),
        F.when(list_price.isNull(), "price_ratio"),
        *[F.when(cold, n) for n in
          ("price_change_pct", "price_zscore", "price_vs_mean_ratio", "price_range_position")],
        F.when(median.isNull(), "robust_zscore"),
        F.when(p5.isNull(), "price_percentile_position"),
        F.when(F.col("last_change_at").isNull(), "days_since_change"),
        F.when(category.isNull(), "price_vs_category"),
    ))
    ident = [c for c in df.columns if c in ("obs_id", "product_id", "competitor_id")]
    return df.select(
        *ident, *[v.alias(k) for k, v in features.items()],
        missing.alias("missing_features"), valid.alias("is_valid"),
    )


CONTENT_COLUMNS = [
    "title", "description", "brand", "ean", "mpn", "bullet_count", "image_count", "price_status",
]


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    clock: Column, prefix: str = "previous_", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Attach the values of the row before, per series."""
    return over_series(
        df, keys, order, clock, 1,
        lambda frame, w: frame.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns}),
        chunk_rows,
    )


def scrape_features(df: DataFrame) -> DataFrame:
    """Thirteen content features from ``CONTENT_COLUMNS`` and their ``previous_`` twins."""

    def text(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(""))

    def length(column: str) -> Column:
        return F.length(text(column))

    def differs(column: str) -> Column:
        now, before = text(column), text(f"previous_{column}")
        return (now != "") & (before != "") & (now != before)

    def change(column: str) -> Column:
        now = F.coalesce(F.col(column), F.lit(0))
        before = F.coalesce(F.col(f"previous_{column}"), F.lit(0))
        return F.when(before > 0, (now - before) / before).otherwise(0.0)

    before = length("previous_title")
    title_ratio = length("title") / before
    return df.withColumns({
        "title_length": length("title").cast("double"),
        "title_length_ratio": F.when(before > 0, title_ratio).otherwise(1.0),
        "title_changed": differs("title").cast("double"),
        "title_collapsed": F.when((before > 0) & (title_ratio < 0.3), 1.0).otherwise(0.0),
        "description_present": (text("description") != "").cast("double"),
        "description_disappeared": (
            (text("previous_description") != "") & (text("description") == "")
        ).cast("double"),
        "brand_changed": differs("brand").cast("double"),
        "identifier_changed": (differs("ean") | differs("mpn")).cast("double"),
        "bullet_count_change": change("bullet_count"),
        "image_count_change": change("image_count"),
        "price_status_changed": (
            (text("previous_price_status") == "confirmed") & (text("price_status") == "hidden")
        ).cast("double"),
        "run_parse_error_rate": F.coalesce(F.col("run_parse_error_rate"), F.lit(0.0)),
        "run_products_missing_pct": F.coalesce(F.col("run_products_missing_pct"), F.lit(0.0)),
    })


def coherence_features(df: DataFrame) -> DataFrame:
    """Price and title change against the previous observation of the same product."""
    price, before = F.col("price"), F.col("previous_price")
    title, old = F.col("title"), F.col("previous_title")
    pct = F.when((price != 0) & (before != 0), (price - before) / before)
    has_title = F.coalesce(title, F.lit("")) != ""
    had_title = F.coalesce(old, F.lit("")) != ""
    similarity = F.when(had_title & has_title, title_similarity(title, old)).when(
        had_title & ~has_title, 0.0
    )
    out = df.withColumns({"price_change_pct": pct, "title_similarity": similarity})
    return out.withColumns({
        "price_changed": F.coalesce(F.abs("price_change_pct") > 0.01, F.lit(False)),
        "price_change_direction": S.price_direction(F.col("price_change_pct")),
        "title_changed": F.coalesce(F.col("title_similarity") < 0.8, F.lit(False)),
        "content_degraded": F.coalesce(
            had_title & (~has_title | (F.length(title) < F.length(old) * 0.5)), F.lit(False)
        ),
    })


def unchanged_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str = "seen_at", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Position inside each run of equal consecutive prices, and when the run began.

    Gaps and islands in one sorted pass per series. A long series is cut into
    time chunks; a run that crosses into a chunk is continued from a table of
    one row per chunk. Prices must not be null.
    """
    keys, order = list(keys), list(order)
    chunked, cut = chunk_series(df, keys, micros(time), chunk_rows)
    part = [*keys, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    changed = F.when(F.lag("price").over(w) == F.col("price"), 0).otherwise(1)
    # The first row of a chunk opens run 1 whether or not it continues an earlier one.
    numbered = chunked.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w))
    run = Window.partitionBy(*part, "_run").orderBy(*order)
    out = numbered.withColumns({
        "consecutive_unchanged": (F.row_number().over(run) - 1).cast("long"),
        "last_change_at": F.first(time).over(run),
    })
    if cut:
        out = _continue_runs(out, keys, order)
    return out.withColumn("is_persistent", F.col("consecutive_unchanged") >= 1).drop("_new", "_run", "_chunk")


def _continue_runs(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add to each chunk's first run the rows it already had in earlier chunks."""
    part = [*keys, "_chunk"]
    edge = F.struct(*order)
    chunks = runs.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("price", edge).alias("_first"),
        F.max_by("price", edge).alias("_last"),
        F.max("_run").alias("_runs"),
        F.max_by(F.col("consecutive_unchanged") + 1, edge).alias("_tail"),
        F.max_by("last_change_at", edge).alias("_since"),
    )
    w = Window.partitionBy(*keys).orderBy("_chunk")  # one row per chunk
    chunks = chunks.withColumns({
        "_joined": F.coalesce(F.lag("_last").over(w) == F.col("_first"), F.lit(False)),
        "_before": F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    # Where a chunk's last run starts in the series; unknown when the whole chunk continues an older run.
    own = ~(F.col("_joined") & (F.col("_runs") == 1))
    chunks = chunks.withColumns({
        "_start": F.when(own, F.col("_before") + F.col("_rows") - F.col("_tail")),
        "_began": F.when(own, F.col("_since")),
    })
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(
        *part,
        F.when(F.col("_joined"), F.col("_before") - F.last("_start", True).over(so_far)).alias("_carry"),
        F.when(F.col("_joined"), F.last("_began", True).over(so_far)).alias("_carry_since"),
    )
    first = F.col("_run") == 1
    carried = null_safe_join(runs, carry, part)
    return carried.withColumns({
        "consecutive_unchanged": F.col("consecutive_unchanged")
        + F.when(first, F.coalesce("_carry", F.lit(0))).otherwise(0),
        "last_change_at": F.when(first, F.coalesce("_carry_since", "last_change_at")).otherwise(F.col("last_change_at")),
    }).drop("_carry", "_carry_since")
