"""Detectors as column expressions.

Each detector returns one struct column with the fields flagged, score,
severity, types (array of strings) and insufficient (history too short).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import scales

DEFAULTS = {"zscore": 3.0, "modified": 2.0, "iqr": 1.5, "change": 0.20}

# Substrings that mark a placeholder image.
PLACEHOLDER_IMAGES = [
    "placeholder",
    "no-image",
    "noimage",
    "default-product",
    "coming-soon",
    "not-available",
    "missing-image",
    "product-image-placeholder",
    "/static/img/placeholder",
    "/assets/placeholder",
    "data:image/",
]


def outcome(
    flagged: Column, score: Column, severity: Column, types: Column, insufficient: Column | None = None
) -> Column:
    return F.struct(
        F.coalesce(flagged, F.lit(False)).alias("flagged"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        severity.alias("severity"),
        types.alias("types"),
        F.coalesce(insufficient if insufficient is not None else F.lit(False), F.lit(False)).alias(
            "insufficient"
        ),
    )


def _one_type(flagged: Column, name: str) -> Column:
    return F.when(F.coalesce(flagged, F.lit(False)), F.array(F.lit(name))).otherwise(
        F.array().cast("array<string>")
    )


def zscore(threshold: float = DEFAULTS["zscore"]) -> Column:
    ready = F.col("observation_count") >= S.MIN_OBSERVATIONS
    z = F.when(ready, F.abs("price_zscore"))
    flagged = z > threshold
    return outcome(
        flagged, S.normalized_score(z, threshold), S.severity_by_deviation(z, threshold),
        _one_type(flagged, "price_zscore"), ~ready,
    )


def modified_zscore(
    mode: str = "mad", threshold: float = DEFAULTS["modified"], weight: float = 0.5,
    history: str = "history", price: str = "price",
) -> Column:
    """mad, sn, weighted, max or mean; a zero scale is degenerate and never flags."""
    h = F.col(history)
    ready = F.size(h) >= S.MIN_OBSERVATIONS
    gap = F.abs(F.coalesce(F.col(price), F.lit(0.0)) - scales.array_median(h))
    mad = scales.mad_scale(h) if mode != "sn" else F.lit(None).cast("double")
    sn = scales.sn_scale(h) if mode != "mad" else F.lit(None).cast("double")

    def combine(part: Column) -> Column:
        by_mad = F.when(part["mad"] > 0, part["gap"] / part["mad"])
        by_sn = F.when(part["sn"] > 0, part["gap"] / part["sn"])
        if mode == "mad":
            return by_mad
        if mode == "sn":
            return by_sn
        if mode == "weighted":
            return F.lit(weight) * by_mad + F.lit(1.0 - weight) * by_sn
        if mode == "max":
            return F.when(by_mad.isNotNull() & by_sn.isNotNull(), F.greatest(by_mad, by_sn))
        return F.lit(0.5) * (by_mad + by_sn)

    parts = F.struct(gap.alias("gap"), mad.alias("mad"), sn.alias("sn"))
    # The scales are costly, so each is bound once per row.
    z = F.when(ready, S.let(parts, combine))
    return S.let(z, lambda z: outcome(
        z > threshold, S.normalized_score(z, threshold), S.severity_by_deviation(z, threshold),
        _one_type(z > threshold, "price_zscore"), ~ready,
    ))


def iqr(multiplier: float = DEFAULTS["iqr"], history: str = "history", price: str = "price") -> Column:
    """Outside the quartile fences; quartiles are the sorted values at n/4 and 3n/4."""
    h = F.col(history)
    value = F.coalesce(F.col(price), F.lit(0.0))
    n = F.size(h)
    ready = n >= 4

    def judge(ordered: Column) -> Column:
        q1 = F.try_element_at(ordered, F.floor(n / 4).cast("int") + 1)
        q3 = F.try_element_at(ordered, F.floor(n * 3 / 4).cast("int") + 1)
        spread = q3 - q1
        below = (q1 - F.lit(multiplier) * spread) - value
        above = value - (q3 + F.lit(multiplier) * spread)
        distance = F.when(ready & (below > 0), below).when(ready & (above > 0), above)
        flagged = distance.isNotNull()
        score = F.when(
            flagged, F.when(spread > 0, F.least(distance / (spread * 2.0), F.lit(1.0))).otherwise(0.5)
        )
        rel = distance / F.nullif(spread, F.lit(0.0))
        severity = F.when(
            flagged & (spread > 0),
            F.when(rel > 3, "critical").when(rel > 2, "high").otherwise("medium"),
        )
        return outcome(flagged, score, severity, _one_type(flagged, "price_iqr"), ~ready)

    return S.let(F.array_sort(h), judge)


def price_change(threshold: float = DEFAULTS["change"]) -> Column:
    change = F.abs("price_change_pct")
    flagged = change > threshold
    severity = F.when(
        flagged,
        F.when(change > F.lit(threshold * 3), "critical")
        .when(change > F.lit(threshold * 2), "high")
        .otherwise("medium"),
    )
    return outcome(
        flagged, S.normalized_score(change, threshold), severity, _one_type(flagged, "price_change")
    )


def numeric_features(df: DataFrame) -> DataFrame:
    """Record checks: ratio, log price, validity and the list of validation errors."""
    price, list_price = F.col("price"), F.col("list_price")
    kept_list = F.when(list_price >= 0, list_price)
    value = F.coalesce(price, F.lit(0.0))
    ratio = F.when(kept_list > 0, value / kept_list)
    blank_currency = F.coalesce(F.trim("currency"), F.lit("")) == ""
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("product_name"), F.lit("")) == "", "missing_product_name"),
        F.when(blank_currency, "missing_currency"),
        F.when(price.isNull(), "missing_price").when(price < 0, "negative_price").when(
            price == 0, "zero_price"
        ),
        F.when(list_price < 0, "negative_list_price"),
        F.when(ratio > 1.0, "price_exceeds_list").when(ratio < 0.1, "extreme_discount"),
    ))
    return df.withColumns({
        "checked_price": value,
        "checked_list_price": kept_list,
        "price_ratio": F.coalesce(ratio, F.lit(1.0)),
        "has_list_price": kept_list.isNotNull(),
        "price_log": F.when(value >= 0, F.log(value + 1)).otherwise(0.0),
        "is_valid": ~blank_currency & price.isNotNull() & (F.coalesce(price, F.lit(-1.0)) >= 0),
        "validation_errors": errors,
    })


def evaluation_features(df: DataFrame) -> DataFrame:
    """The evaluation variant: a price <= 0 is invalid and no list-price errors arise."""
    value = F.coalesce(F.col("price"), F.lit(0.0))
    list_price = F.col("list_price")
    has_currency = "currency" in df.columns
    no_currency = F.col("currency").isNull() if has_currency else F.lit(False)
    return df.withColumns({
        "checked_price": value,
        "checked_list_price": list_price,
        "price_ratio": F.when(list_price > 0, value / list_price).otherwise(1.0),
        "has_list_price": list_price.isNotNull(),
        "price_log": F.when(value >= 0, F.log(value + 1)).otherwise(0.0),
        "is_valid": (value > 0) & ~no_currency,
        "validation_errors": F.array_compact(F.array(
            F.when(value <= 0, "invalid_price"), F.when(no_currency, "missing_currency"),
        )),
    })


def sanity() -> Column:
    """Business-rule violations from the numeric feature columns."""
    errors = F.col("validation_errors")
    quality = F.exists(errors, lambda e: e.contains("negative") | e.contains("missing"))
    listed = F.exists(errors, lambda e: e.contains("exceeds_list") | e.contains("extreme_discount"))
    over_list = F.col("has_list_price") & (F.col("price_ratio") > 1.0)
    actual = F.upper(F.trim("currency"))
    expected = S.expected_currency(F.col("country"))
    mismatch = F.coalesce((actual != "") & (actual != expected), F.lit(False))
    invalid = ~F.col("is_valid")
    types = F.array_compact(F.array(
        F.when(quality | invalid, "data_quality"),
        F.when(listed | over_list, "price_sanity"),
        F.when(mismatch, "currency_mismatch"),
    ))
    score = F.when(invalid, 1.0).when(mismatch, 0.95).when(over_list, 0.9).when(
        F.size(errors) > 0, 0.8
    )
    severity = (
        F.when(invalid, "critical")
        .when(mismatch | over_list, "high")
        .when(quality, "high")
        .when(F.size(types) > 0, "medium")
    )
    return outcome(F.size(types) > 0, score, severity, types)


def invariants(collapse_below: float = 0.2, extreme_factor: float = 10.0) -> Column:
    """Title collapse, placeholder images, currency mismatch, price far from the category median."""
    title, old = F.col("title"), F.col("previous_title")
    has_both = (F.length(title) > 0) & (F.length(old) > 0)
    moved = F.abs(F.col("price") - F.col("previous_price")) > 0.01
    collapsed = F.coalesce(
        has_both & (F.length(title) / F.length(old) < collapse_below) & moved, F.lit(False)
    )
    placeholder = F.coalesce(
        F.exists(
            "image_urls",
            lambda u: F.coalesce(
                F.lower(u).rlike("|".join(PLACEHOLDER_IMAGES)), F.lit(False)
            ),
        ),
        F.lit(False),
    )
    expected = F.try_element_at(S.literal_map(S.COUNTRY_CURRENCY), F.col("country"))
    mismatch = F.coalesce((F.col("currency") != "") & (F.col("currency") != expected), F.lit(False))
    rel = F.when(F.col("category_median_price") > 0, F.col("price") / F.col("category_median_price"))
    extreme = F.coalesce((rel > extreme_factor) | (rel < 1 / extreme_factor), F.lit(False))
    types = F.array_compact(F.array(
        F.when(collapsed, "title_collapse"),
        F.when(placeholder, "placeholder_image"),
        F.when(mismatch, "currency_mismatch"),
        F.when(extreme, "extreme_price"),
    ))
    score = F.when(mismatch, 0.95).when(collapsed, 0.9).when(extreme, 0.85).when(placeholder, 0.6)
    severity = F.when(collapsed | mismatch, "critical").when(extreme, "high").when(placeholder, "medium")
    return outcome(F.size(types) > 0, score, severity, types)


def ensemble(members: dict[str, Column]) -> Column:
    """Union of types, highest score and severity, and the names of the members that fired."""
    parts = list(members.values())
    types = F.array_sort(F.array_distinct(F.flatten(F.array(*[p.getField("types") for p in parts]))))
    return F.struct(
        (F.size(types) > 0).alias("flagged"),
        F.greatest(*[p.getField("score") for p in parts]).alias("score"),
        S.top_severity(*[p.getField("severity") for p in parts]).alias("severity"),
        types.alias("types"),
        F.lit(False).alias("insufficient"),
        F.array_compact(
            F.array(*[F.when(p.getField("flagged"), n) for n, p in members.items()])
        ).alias("triggered"),
    )
