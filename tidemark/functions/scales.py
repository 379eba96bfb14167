"""Scale estimators and z-scores over ``array<double>`` columns.

The arrays are price baselines of at most a few dozen values, so nested
``transform`` calls are cheap and stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import MAD_NORMAL, let


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    low = F.floor((n + 1) / 2).cast("int")
    high = F.floor((n + 2) / 2).cast("int")
    return (F.try_element_at(ordered, low) + F.try_element_at(ordered, high)) / 2


def array_median(values: Column) -> Column:
    return F.when(F.size(values) > 0, let(F.array_sort(values), _middle))


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def array_std(values: Column, ddof: int = 1) -> Column:
    """Standard deviation; with ``ddof=1`` a single value has deviation 0.

    Welford's running mean and squares, in array order: the arithmetic of the SQL
    aggregate to the last bit, which decides where a z-score meets a threshold exactly.
    """
    n = F.size(values)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(acc: Column, x: Column) -> Column:
        mean = acc["mean"] + (x - acc["mean"]) / (acc["n"] + 1.0)
        return F.struct(
            (acc["n"] + 1.0).alias("n"), mean.alias("mean"),
            (acc["squares"] + (x - mean) * (x - acc["mean"])).alias("squares"),
        )

    squares = F.aggregate(values, start, add, lambda acc: acc["squares"])
    return F.when(n > ddof, F.sqrt(squares / F.greatest(n - ddof, F.lit(1)))).when(n > 0, 0.0)


def sd_scale(values: Column) -> Column:
    return array_std(values, ddof=0)


def array_mad(values: Column) -> Column:
    """Median absolute deviation without the normal factor."""
    return let(
        array_median(values),
        lambda mid: array_median(F.transform(values, lambda x: F.abs(x - mid))),
    )


def mad_scale(values: Column) -> Column:
    return F.lit(MAD_NORMAL) * array_mad(values)


def sn_scale(values: Column) -> Column:
    """Median over i of the median over j of abs(x_i - x_j), corrected for odd counts."""
    inner = F.transform(
        values, lambda x: array_median(F.transform(values, lambda y: F.abs(x - y)))
    )
    n = F.size(values)
    factor = F.when(n % 2 == 1, n / (n - F.lit(0.9))).otherwise(1.0)
    return array_median(inner) * factor


def scale_z(price: Column, centre: Column, scale: Column) -> Column:
    """Signed distance in scale units, null where the scale is zero or missing."""
    return F.when(scale > 0, (price - centre) / scale)


def sd_z(values: Column, price: Column) -> Column:
    return scale_z(price, array_mean(values), sd_scale(values))


def mad_z(values: Column, price: Column) -> Column:
    return scale_z(price, array_median(values), mad_scale(values))


def sn_z(values: Column, price: Column) -> Column:
    return scale_z(price, array_median(values), sn_scale(values))


def hybrid_z(values: Column, price: Column, mode: str = "weighted", weight: float = 0.5) -> Column:
    """Combine MAD and Sn z-scores: 'weighted', 'max' or 'mean'."""
    mad, sn = mad_z(values, price), sn_z(values, price)
    if mode == "weighted":
        return F.lit(weight) * mad + F.lit(1.0 - weight) * sn
    if mode == "max":
        return F.when(mad.isNotNull() & sn.isNotNull(), F.greatest(mad, sn))
    if mode == "mean":
        return F.lit(0.5) * (mad + sn)
    raise ValueError(f"unknown hybrid mode {mode!r}")


# SQL text of the same estimators, so that they are usable from spark.sql.
_MEDIAN_SQL = (
    "CASE WHEN size({a}) > 0 THEN (try_element_at(array_sort({a}), int(floor((size({a})+1)/2)))"
    " + try_element_at(array_sort({a}), int(floor((size({a})+2)/2)))) / 2 END"
)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions for the estimators in this session."""
    median = _MEDIAN_SQL.format
    spread = "transform(v, x -> abs(x - array_middle(v)))"
    definitions: dict[str, tuple[str, str]] = {
        "array_middle": ("v ARRAY<DOUBLE>", median(a="v")),
        "scale_sd": (
            "v ARRAY<DOUBLE>",
            "sqrt(aggregate(v, 0D, (s, x) -> s + power(x - aggregate(v, 0D, (t, y) -> t + y)/size(v), 2))/size(v))",
        ),
        "scale_mad": ("v ARRAY<DOUBLE>", f"{MAD_NORMAL}D * ({median(a=spread)})"),
        "scale_sn": (
            "v ARRAY<DOUBLE>",
            "("
            + median(a="transform(v, x -> " + median(a="transform(v, y -> abs(x - y))") + ")")
            + ") * CASE WHEN size(v) % 2 = 1 THEN size(v)/(size(v) - 0.9D) ELSE 1D END",
        ),
    }
    for name, (args, body) in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    return list(definitions)


SCALES: dict[str, Callable[[Column], Column]] = {"sd": sd_scale, "mad": mad_scale, "sn": sn_scale}
