"""Exact building blocks that hold when one key owns a large share of the rows.

* ``bucketed_row_number``: row numbers over an order, sorted bucket by bucket,
  so that no task sorts a whole group.
* ``null_safe_join``: a join that keeps groups whose key is null.
* ``exact_percentiles``: interpolated percentiles without a buffer of all values.
* ``chunk_series`` and ``over_series``: long series are cut into time chunks;
  a window of bounded width sees the last rows of the chunk before its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import persist_table

HASH_BUCKETS = 1024
# Rows of one series that a single task may hold or walk through.
CHUNK_ROWS = 2_000_000
# Hot-series tables above this many rows are joined by shuffle, not broadcast.
BROADCAST_ROWS = 1_000_000


def bucketed_row_number(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "row_number",
) -> DataFrame:
    """Row number within ``by`` where ``bucket`` is an integer that never falls along ``order``.

    Each (group, bucket) is numbered on its own; the counts of the buckets
    before it, a table of groups x buckets rows, give the offset.
    """
    tagged = df.withColumn("_bucket", bucket.cast("long"))
    sizes = tagged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # The running sum walks buckets, not rows: as many per group as ``bucket`` has values.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    if by:
        joined = tagged.join(_null_safe(offsets, [*by, "_bucket"]), _match(tagged, [*by, "_bucket"]), "left")
    else:
        joined = tagged.join(offsets.withColumnRenamed("_bucket", "_k__bucket"),
                             F.col("_bucket") == F.col("_k__bucket"), "left")
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = joined.withColumn(name, (F.row_number().over(within) + F.col("_offset")).cast("long"))
    return numbered.select(*df.columns, name)


def _null_safe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in df.columns])


def _match(left: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return condition


def null_safe_join(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null: a group without a name is a group."""
    keys = list(keys)
    joined = df.join(_null_safe(side, keys), _match(df, keys), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_k_{k}" for k in keys])


def series_key(keys: Sequence[str]) -> Column:
    """One non-null text per combination of key values, nulls included."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def oversized(df: DataFrame, by: Sequence[str], limit: int) -> bool:
    """Whether any group has more than ``limit`` rows."""
    return not df.groupBy(*by).count().filter(F.col("count") > limit).isEmpty()


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float],
    accuracy: int = 200, slice_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Linear-interpolated percentiles per group, exact and free of large buffers.

    Where all groups are small the built-in aggregate does it. Otherwise three
    passes: rough cut points from the mergeable ``percentile_approx`` sketch,
    counts per slice between cut points, and a ranking of only those slices
    that hold a wanted rank. Only the rows of these slices are shuffled.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if not oversized(rows, by, slice_rows):
        return rows.groupBy(*by).agg(*[F.percentile("_v", F.lit(float(p))).alias(k) for k, p in fractions.items()])
    rows = persist_table(rows, "percentile-input")
    steps = [i / accuracy for i in range(1, accuracy)]
    cuts = rows.groupBy(*by).agg(
        F.array_distinct(F.percentile_approx("_v", steps, accuracy * 20)).alias("_cuts"),
        F.count(F.lit(1)).alias("_n"),
    )
    sliced = join_small(rows, small_table(cuts, "percentile-cuts"), by).select(
        *by, "_v", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_slice")
    )
    sizes = sliced.groupBy(*by, "_slice", "_n").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[
        F.struct(
            F.lit(k).alias("name"),
            F.lit(float(p)).alias("p"),
            (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos"),
        )
        for k, p in fractions.items()
    ])
    targets = (
        sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_wanted", F.filter(wanted, lambda w: (F.floor(w.pos) < F.col("_before") + F.col("_rows"))
                                        & (F.ceil(w.pos) >= F.col("_before"))))
        .filter(F.size("_wanted") > 0)
        .select(*by, "_slice", "_before", "_wanted")
    )
    keys = [*by, "_slice"]
    targets = small_table(targets, "percentile-targets")
    # Equal values always share a slice, so they can be counted together first.
    weighted = null_safe_join(sliced, targets, keys, "left_semi").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    near = null_safe_join(weighted, targets, keys)
    running = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_last", F.col("_before") + F.sum("_w").over(running) - 1)
    placed = placed.withColumn("_first", F.col("_last") - F.col("_w") + 1)
    hits = placed.select(*by, "_v", "_first", "_last", F.explode("_wanted").alias("w")).select(
        *by,
        F.col("w.name").alias("_name"),
        F.col("w.pos").alias("_pos"),
        F.when(F.floor("w.pos").between(F.col("_first"), F.col("_last")), F.col("_v")).alias("_lo"),
        F.when(F.ceil("w.pos").between(F.col("_first"), F.col("_last")), F.col("_v")).alias("_hi"),
    )
    per_name = hits.groupBy(*by, "_name", "_pos").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    # Same interpolation as lo + (hi - lo) * fraction.
    result = per_name.withColumn(
        "_p", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    )
    return result.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == k, F.col("_p"))).alias(k) for k in fractions]
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_percentiles(df, by, value, {name: 0.5})


def _pack_cells(chunk_rows: int, min_rows: int, keys: list[str]):
    """Join neighbouring time cells of one series into chunks of about ``chunk_rows`` rows."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_cell")
        chunk, held, ids = 0, 0, []
        for rows in pdf["_rows"]:
            if held >= max(chunk_rows, min_rows):
                chunk, held = chunk + 1, 0
            ids.append(chunk)
            held += rows
        if chunk and held < min_rows:
            ids = [min(i, chunk - 1) for i in ids]
        return pdf.assign(_chunk=ids)[[*keys, "_cell", "_chunk"]]

    return pack


def chunk_series(
    df: DataFrame, keys: Sequence[str], micros: Column, chunk_rows: int = CHUNK_ROWS, min_rows: int = 1
) -> tuple[DataFrame, bool]:
    """Add ``_chunk``: 0 for ordinary series, consecutive time chunks for long ones.

    Returns the frame and whether any series was cut. Chunks follow time and
    hold at least ``min_rows`` rows; equal times share a chunk.
    """
    keys = list(keys)
    timed = df.withColumn("_us", micros)
    hot = (
        timed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_t0"), F.max("_us").alias("_t1"))
        .filter(F.col("_n") > chunk_rows)
    )
    if hot.isEmpty():
        return df.withColumn("_chunk", F.lit(0)), False
    hot = persist_table(hot, "hot-series")
    cells = F.ceil(F.col("_n") * 8 / F.lit(chunk_rows))
    cell = F.floor((F.col("_us") - F.col("_t0")) * cells / (F.col("_t1") - F.col("_t0") + 1)).cast("long")
    small = hot.count() <= BROADCAST_ROWS
    side = _null_safe(hot, keys)
    marked = timed.join(F.broadcast(side) if small else side, _match(timed, keys), "left")
    marked = marked.withColumn("_cell", cell).select(*timed.columns, "_cell")
    fields = [f for f in timed.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("_cell", T.LongType()), T.StructField("_chunk", T.IntegerType())])
    cell_sizes = (
        marked.filter(F.col("_cell").isNotNull()).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    )
    # One group here is the list of time cells of one series, never its rows.
    packed = cell_sizes.groupBy(*keys).applyInPandas(_pack_cells(chunk_rows, min_rows, keys), schema)
    packed = persist_table(packed, "series-chunks")
    few = packed.count() <= BROADCAST_ROWS
    side = _null_safe(packed, [*keys, "_cell"])
    out = marked.join(F.broadcast(side) if few else side, _match(marked, [*keys, "_cell"]), "left")
    return out.select(*df.columns, F.coalesce("_chunk", F.lit(0)).alias("_chunk")), True


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    micros: Column,
    width: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Apply ``build(frame, window)`` where every window frame looks back at most ``width`` rows.

    Long series are windowed chunk by chunk; each chunk is preceded by copies
    of the last ``width`` rows before it, which are dropped afterwards.
    """
    keys = list(keys)
    chunked, cut = chunk_series(df, keys, micros, chunk_rows, min_rows=max(width, 1))
    if not cut:
        window = Window.partitionBy(*keys).orderBy(*order)
        return build(df, window)
    ends = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    chunks = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    tails = (
        chunked.withColumn("_back", F.row_number().over(ends))
        .filter(F.col("_back") <= width)
        .drop("_back")
        .withColumn("_chunk", F.col("_chunk") + 1)
        .withColumn("_halo", F.lit(True))
    )
    # A tail behind the last chunk opens a chunk without own rows and is dropped with it.
    both = chunked.withColumn("_halo", F.lit(False)).unionByName(tails)
    built = build(both, chunks)
    return built.filter(~F.col("_halo")).drop("_halo", "_chunk")


def hash_cut(df: DataFrame, by: Sequence[str], u: str, ident: str, limits: DataFrame) -> DataFrame:
    """Per group, the (``u``, ``ident``) of the row at rank ``_limit``: columns _cut_u, _cut_id.

    ``limits`` holds ``by`` and ``_limit``. A histogram of the hash finds the
    bucket of that rank; only this bucket (1/1024 of a group) is sorted. Rows
    up to the cut are the ``_limit`` smallest, with no shuffle of the others.
    """
    by = list(by)
    tagged = df.select(*by, u, ident).withColumn("_bucket", F.floor(F.col(u) * HASH_BUCKETS).cast("long"))
    sizes = tagged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    targets = join_small(sizes, limits, by).filter(
        (F.col("_before") < F.col("_limit")) & (F.col("_limit") <= F.col("_before") + F.col("_rows"))
    ).select(*by, "_bucket", (F.col("_limit") - F.col("_before")).alias("_nth"))
    targets = small_table(targets, "cut-targets")
    near = tagged.join(_null_safe(targets, [*by, "_bucket"]), _match(tagged, [*by, "_bucket"]))
    within = Window.partitionBy(*by, "_bucket").orderBy(u, ident)
    return near.withColumn("_at", F.row_number().over(within)).filter(F.col("_at") == F.col("_nth")).select(
        *by, F.col(u).alias("_cut_u"), F.col(ident).alias("_cut_id")
    )


def small_table(df: DataFrame, label: str) -> DataFrame:
    """A table of one row per group, written once and broadcast while it has at most BROADCAST_ROWS rows.

    A shuffle by a key of few groups would deal all rows of the other side to as few tasks.
    """
    written = persist_table(df, label)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def join_small(df: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-group table; without groups it is a single row and is broadcast."""
    if not by:
        return df.join(F.broadcast(small), how=how) if how == "inner" else df.join(
            F.broadcast(small), F.lit(True), how
        )
    return null_safe_join(df, small, by, how)


def up_to_cut(u: str, ident: str) -> Column:
    """Whether a row is at or before the cut joined from ``hash_cut``; false without a cut."""
    inside = (F.col(u) < F.col("_cut_u")) | ((F.col(u) == F.col("_cut_u")) & (F.col(ident) <= F.col("_cut_id")))
    return F.coalesce(inside, F.lit(False))
