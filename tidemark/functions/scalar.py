"""Row expressions shared by features, detectors and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HISTORY_DEPTH = 30
MIN_OBSERVATIONS = 3
MAD_NORMAL = 1.4826
SEVERITIES = ["low", "medium", "high", "critical"]
COUNTRY_CURRENCY = {"DK": "DKK", "SE": "SEK", "NO": "NOK", "FI": "EUR"}
ANONYMOUS_CURRENCY = {
    "COUNTRY_1": "CURRENCY_1",
    "COUNTRY_2": "CURRENCY_2",
    "COUNTRY_3": "CURRENCY_3",
    "COUNTRY_4": "CURRENCY_4",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def hash_uniform(seed: int | str | Column, tag: str, ident: Column) -> Column:
    """Uniform double in [0, 1) fixed by (seed, tag, id): 32 bits of md5."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws("|", seed_col.cast("string"), F.lit(tag), ident.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def safe_divide(num: Column, den: Column, default: float | None = 0.0) -> Column:
    return F.when(num.isNull() | den.isNull() | (den == 0), F.lit(default)).otherwise(num / den)


def pct_change(current: Column, previous: Column, default: float | None = None) -> Column:
    return F.when(
        current.isNull() | previous.isNull() | (previous == 0), F.lit(default)
    ).otherwise((current - previous) / previous)


def ratio(num: Column, den: Column, default: float = 1.0) -> Column:
    return safe_divide(num, den, default)


def normalized_score(value: Column, threshold: float, cap_multiple: float = 2.0) -> Column:
    """min(value / (2 * threshold), 1); a threshold <= 0 gives .5 for positive values, else 0."""
    if threshold <= 0:
        return F.when(value > 0, 0.5).otherwise(0.0)
    top = F.lit(threshold * cap_multiple)
    # Not least(): it would turn a missing value into 1.
    return F.when(value >= top, 1.0).otherwise(value / top)


def severity_by_deviation(value: Column, threshold: float) -> Column:
    return (
        F.when(value > threshold * 2, "critical")
        .when(value > threshold * 1.5, "high")
        .when(value > threshold, "medium")
    )


def severity_by_score(score: Column, low_from: float | None = None) -> Column:
    """Bands at .9, .8 and .7; below that 'low' (from ``low_from`` on when given)."""
    bands = F.when(score >= 0.9, "critical").when(score >= 0.8, "high").when(score >= 0.7, "medium")
    if low_from is None:
        return bands.otherwise("low")
    return bands.when(score >= low_from, "low")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES, start=1):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank - 1)


def top_severity(*severities: Column) -> Column:
    ranks = [severity_rank(s) for s in severities]
    return severity_name(F.greatest(*ranks) if len(ranks) > 1 else ranks[0])


def within_tolerance(tracked: Column, price: Column, fraction: float) -> Column:
    if fraction == 0.0:
        return tracked == price
    return F.abs(tracked - price) <= tracked * F.lit(fraction)


def robust_z(price: Column, median: Column, mad: Column) -> Column:
    """(price - median) / (1.4826 MAD); with MAD 0 it is 0 at the median and 10 elsewhere."""
    return F.when(median.isNull() | mad.isNull(), None).when(
        mad == 0, F.when(price == median, 0.0).otherwise(10.0)
    ).otherwise((price - median) / (F.lit(MAD_NORMAL) * mad))


def percentile_position(price: Column, p5: Column, p95: Column) -> Column:
    span = p95 - p5
    return F.when(p5.isNull() | p95.isNull(), None).when(span == 0, 0.5).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (price - p5) / span))
    )


def competitor_currency(competitor: Column) -> Column:
    """Currency of the country code after the last underscore, null when unknown."""
    code = F.upper(F.trim(F.substring_index(competitor, "_", -1)))
    return F.when(
        F.instr(competitor, "_") > 0, F.try_element_at(literal_map(COUNTRY_CURRENCY), code)
    )


def expected_currency(country: Column) -> Column:
    code = F.upper(F.trim(country))
    return F.try_element_at(literal_map({**COUNTRY_CURRENCY, **ANONYMOUS_CURRENCY}), code)


def parse_instant(text: Column) -> Column:
    """ISO 8601 text to timestamp, a trailing Z included; null when unreadable."""
    return F.try_to_timestamp(text)


def price_direction(pct: Column, threshold: float = 0.01) -> Column:
    return F.when(F.abs(pct) > threshold, F.when(pct > 0, "increase").otherwise("decrease"))


def slug(text: Column) -> Column:
    lowered = F.lower(F.trim(text))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def split_label(name: Column) -> Column:
    """Split name without leading underscores, a ``test_`` prefix or the file suffix."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\.parquet$", ""), "^_*(test_)?", "")
