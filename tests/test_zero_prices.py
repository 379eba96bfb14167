"""Series of zero prices in reports that divide by their mean."""

import math

from tidemark.operators.profiles import excluded_series


def test_series_of_zeros_has_no_variation_and_sorts_last(spark):
    rows = [("a", "s", 0.0), ("a", "s", 0.0), ("b", "s", 10.0), ("b", "s", 10.0), ("c", "s", 0.0),
            ("d", "t", 0.0), ("d", "t", 0.0), ("d", "t", 0.0), ("e", "t", 1.0), ("e", "t", 1.0), ("e", "t", 1.0)]
    df = spark.createDataFrame([(*r, "2024-01-01") for r in rows], "p STRING, shop STRING, price DOUBLE, seen_at STRING")
    df = df.withColumn("seen_at", df.seen_at.cast("timestamp"))
    out = {r.shop: r for r in excluded_series(df, ["p", "shop"], "shop", 3).collect()}
    # s: variations NaN, 0 and null; the median of 0 and NaN is no number.
    assert (out["s"].excluded, out["s"].total) == (3, 3) and math.isnan(out["s"].excluded_median_cv)
    assert out["s"].included_median_cv is None
    assert out["t"].excluded == 0 and math.isnan(out["t"].included_median_cv)
