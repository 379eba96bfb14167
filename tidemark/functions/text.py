"""Title comparison and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct character 3-grams of the whole text, by an overlapping regex scan."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def characters(text: Column) -> Column:
    return F.array_distinct(F.split(text, ""))


def _jaccard(left: Column, right: Column) -> Column:
    common = F.size(F.array_intersect(left, right))
    return common / (F.size(left) + F.size(right) - common)


def title_similarity(current: Column, previous: Column) -> Column:
    """Jaccard of 3-gram sets after lower-trim; of character sets where one is too short."""
    a, b = F.lower(F.trim(current)), F.lower(F.trim(previous))
    short = (F.length(a) < 3) | (F.length(b) < 3)
    blank = current.isNull() | previous.isNull() | (current == "") | (previous == "")
    return (
        F.when(blank, 0.0)
        .when(a == b, 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when(short, _jaccard(characters(a), characters(b)))
        .otherwise(_jaccard(trigrams(a), trigrams(b)))
    )


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 for a missing vector or a zero norm."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(left.isNull() | right.isNull() | (norm == 0), 0.0).otherwise(
        dot(left, right) / norm
    )


def euclidean(left: Column, right: Column) -> Column:
    """Euclidean distance; infinity for a missing vector."""
    squares = F.aggregate(
        F.zip_with(left, right, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(left.isNull() | right.isNull(), F.lit(float("inf"))).otherwise(F.sqrt(squares))


def vector_drift(current: Column, previous: Column, threshold: float = 0.1) -> Column:
    return (F.lit(1.0) - cosine(current, previous)) > threshold
