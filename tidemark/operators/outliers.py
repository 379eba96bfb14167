"""Outlier masks over whole series of any length.

Medians come from ``exact_percentiles``. The Sn scale needs, per value, the
median distance to all values of its series; the k-th smallest distance from x
is the least, over windows of k neighbours in sorted order, of the larger
distance to a window end. With window midpoints sorted next to the values this
is one running maximum and one running minimum, so no pairs are formed and no
series is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import MAD_NORMAL
from tidemark.plans.skew import CHUNK_ROWS, bucketed_row_number, exact_median, null_safe_join, oversized
from tidemark.session import persist_table

SLICES = 256


def value_slices(df: DataFrame, by: Sequence[str], value: str, slice_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_n`` and ``_slice``; slices follow the value order and only large groups are cut."""
    steps = [i / SLICES for i in range(1, SLICES)]
    cuts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, steps, 20 * SLICES).alias("_cuts")
    ).withColumn("_cuts", F.when(F.col("_n") > slice_rows, F.col("_cuts")))
    joined = null_safe_join(df, cuts, by)
    return joined.withColumn(
        "_slice",
        F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0)).cast("long"),
    ).withColumn("_slice", F.greatest("_slice", F.lit(0))).drop("_cuts")


def _running(df: DataFrame, by: list[str], order: list[Column], what: Column, kind: str, name: str) -> DataFrame:
    """Running max from below or min from above over slices, with carries between slices."""
    lowest = kind == "max"
    agg = F.max if lowest else F.min
    frame = (Window.unboundedPreceding, 0) if lowest else (0, Window.unboundedFollowing)
    within = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(*frame)
    totals = df.groupBy(*by, "_slice").agg(agg(what).alias("_total"))
    outer = (Window.unboundedPreceding, -1) if lowest else (1, Window.unboundedFollowing)
    carry = totals.select(
        *by, "_slice",
        agg("_total").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(*outer)).alias("_carry"),
    )
    joined = null_safe_join(df.withColumn("_part", agg(what).over(within)), carry, [*by, "_slice"])
    pick = F.greatest if lowest else F.least
    return joined.withColumn(name, pick("_part", "_carry")).drop("_part", "_carry")


def _neighbour_distance(values: DataFrame, by: list[str], k: Column, cut: bool, slice_rows: int) -> DataFrame:
    """(by, ident, distance) with the k-th smallest distance inside each series."""
    low = values.select(*by, F.col("_v").alias("_a"), (F.col("_rank") + k - 1).cast("long").alias("_end"))
    high = values.select(*by, F.col("_rank").alias("_end"), F.col("_v").alias("_b"))
    windows = null_safe_join(low, high, [*by, "_end"]).select(
        *by, ((F.col("_a") + F.col("_b")) / 2).alias("_v"), "_a", "_b", F.lit(0).alias("_kind"),
        F.lit(None).cast(values.schema["ident"].dataType).alias("ident"),
    )
    points = values.select(
        *by, "_v", F.lit(None).cast("double").alias("_a"), F.lit(None).cast("double").alias("_b"),
        F.lit(1).alias("_kind"), "ident",
    )
    # Ties between a midpoint and a value give the same distance from either side.
    both = windows.unionByName(points)
    order = [F.col("_v"), F.col("_kind"), F.col("ident"), F.col("_a"), F.col("_b")]
    if cut:
        both = value_slices(persist_table(both, "sn-merge"), by, "_v", slice_rows)
        both = persist_table(_running(both, by, order, F.col("_a"), "max", "_below"), "sn-below")
        both = _running(both, by, order, F.col("_b"), "min", "_above")
    else:
        w = Window.partitionBy(*by).orderBy(*order)
        both = both.withColumns({
            "_below": F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_above": F.min("_b").over(w.rowsBetween(0, Window.unboundedFollowing)),
        })
    return both.filter(F.col("_kind") == 1).select(
        *by, "ident", F.least(F.col("_v") - F.col("_below"), F.col("_above") - F.col("_v")).alias("distance")
    )


def series_sn(df: DataFrame, by: Sequence[str], value: str, ident: str, slice_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sn scale per series as (by, sn)."""
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(
        *by, F.col(ident).alias("ident"), F.col(value).cast("double").alias("_v")
    )
    cut = oversized(rows, by, slice_rows)
    if cut:
        sliced = value_slices(rows, by, "_v", slice_rows)
        ranked = bucketed_row_number(sliced, by, F.col("_slice"), [F.col("_v"), F.col("ident")], "_rank")
        ranked = persist_table(ranked.drop("_slice"), "sn-ranks")
    else:
        w = Window.partitionBy(*by)
        ranked = rows.withColumns({
            "_rank": F.row_number().over(w.orderBy("_v", "ident")).cast("long"),
            "_n": F.count(F.lit(1)).over(w),
        })
    near = _neighbour_distance(ranked, by, F.floor((F.col("_n") + 1) / 2), cut, slice_rows)
    far = _neighbour_distance(ranked, by, F.floor(F.col("_n") / 2) + 1, cut, slice_rows)
    inner = null_safe_join(near, far.withColumnRenamed("distance", "_far"), [*by, "ident"]).select(
        *by, ((F.col("distance") + F.col("_far")) / 2).alias("_d")
    )
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    factor = F.when(F.col("_n") % 2 == 1, F.col("_n") / (F.col("_n") - F.lit(0.9))).otherwise(1.0)
    return null_safe_join(exact_median(inner, by, "_d", "_mid"), sizes, by).select(
        *by, (F.col("_mid") * factor).alias("sn")
    )


def series_outliers(
    df: DataFrame, by: Sequence[str], value: str, ident: str, method: str = "weighted",
    threshold: float = 2.0, weight: float = 0.5, slice_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """z-score and outlier flag of every value against its whole series.

    Methods: sd (signed, two-sided), mad, sn, weighted, max, mean. A series
    with zero scale has no z-scores and no outliers.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull())
    if method == "sd":
        scale = rows.groupBy(*by).agg(F.avg(value).alias("_c"), F.stddev_pop(value).alias("_s"))
        z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_c")) / F.col("_s"))
        out = null_safe_join(rows, scale, by).withColumn("z", z)
        return out.withColumn("is_outlier", F.coalesce(F.abs("z") > threshold, F.lit(False))).drop("_c", "_s")
    centred = null_safe_join(rows, exact_median(rows, by, value, "_c"), by)
    gap = F.abs(F.col(value) - F.col("_c"))
    if method != "sn":
        mad = exact_median(centred.withColumn("_gap", gap), by, "_gap", "_mad")
        centred = null_safe_join(centred, mad, by).withColumn("_mad", F.col("_mad") * MAD_NORMAL)
    if method != "mad":
        centred = null_safe_join(centred, series_sn(rows, by, value, ident, slice_rows), by)
    parts = {}
    if method != "sn":
        parts["mad"] = F.when(F.col("_mad") > 0, gap / F.col("_mad"))
    if method != "mad":
        parts["sn"] = F.when(F.col("sn") > 0, gap / F.col("sn"))
    if method in parts:
        z = parts[method]
    elif method == "weighted":
        z = F.lit(weight) * parts["mad"] + F.lit(1 - weight) * parts["sn"]
    elif method == "max":
        z = F.when(parts["mad"].isNotNull() & parts["sn"].isNotNull(), F.greatest(*parts.values()))
    else:
        z = F.lit(0.5) * (parts["mad"] + parts["sn"])
    out = centred.withColumn("z", z)
    return out.withColumn("is_outlier", F.coalesce(F.col("z") > threshold, F.lit(False))).drop(
        "_c", "_mad", "sn"
    )
