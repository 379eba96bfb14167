"""How many consecutive scrape runs each price has lasted.

A series is walked in order with five values of state. A series longer than
``chunk_rows`` is cut into time chunks that run in parallel. What a chunk does to
the state it meets depends on that state's price and last run alone: either no
row moves the price, and the runs of the chunk are added, or the state behind
the first move no longer knows what came before. So chunks are summarised for
the price they may meet, again only where another price arrives, and the
summaries, one row a chunk, are composed along the series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.plans.skew import CHUNK_ROWS, chunk_series, series_key
from tidemark.session import persist_table, ship_package

STABLE_RUNS = 2
CHANGE_FROM = 0.01

TRACKED = T.StructType([
    T.StructField("current_price", T.DoubleType()),
    T.StructField("previous_price", T.DoubleType()),
    T.StructField("first_seen_us", T.LongType()),
    T.StructField("persisted_runs", T.LongType()),
    T.StructField("price_changed", T.BooleanType()),
    T.StructField("is_new_change", T.BooleanType()),
    T.StructField("is_stable", T.BooleanType()),
    T.StructField("position", T.LongType()),
])


def _moved(old: float, new: float) -> bool:
    if old == 0:
        return new != 0
    return abs(new - old) / old > CHANGE_FROM


def advance(state: tuple | None, price: float, run: str | None, now: int) -> tuple[tuple, tuple]:
    """One observation: (new state, (changed, new change, stable)).

    State: current price, previous price, first seen, runs, last run id. A
    repeat of the same run leaves the state alone. The price is compared with
    the run's first price, so slow drift does count as a change in the end.
    """
    if state is None:
        return (price, None, now, 1, run), (False, False, False)
    current, previous, since, runs, last = state
    if run and run == last:
        return state, (False, False, runs >= STABLE_RUNS)
    if _moved(current, price):
        return (price, current, now, 1, run), (True, True, False)
    return (current, previous, since, runs + 1, run), (False, False, runs + 1 >= STABLE_RUNS)


ENTRY = T.StructType([
    T.StructField("current", T.DoubleType()),
    T.StructField("previous", T.DoubleType()),
    T.StructField("since", T.LongType()),
    T.StructField("runs", T.LongType()),
    T.StructField("last", T.StringType()),
    T.StructField("position", T.LongType()),
])
# ``moved``: the exit does not depend on the entry's previous price, time and runs; else ``runs`` are those added.
SUMMARY = T.StructType([
    T.StructField("_series", T.StringType()),
    T.StructField("_chunk", T.IntegerType()),
    T.StructField("moved", T.BooleanType()),
    T.StructField("rows", T.LongType()),
    *ENTRY.fields[:5],
])


def _arrow(fields) -> list[pa.Field]:
    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]


def _seeded(rows: DataFrame, entries: DataFrame | None, order: list[str]) -> DataFrame:
    """Rows sorted by chunk, each chunk led by the state it is entered with."""
    marked = rows.withColumns({"_slot": F.lit(1), "_entry": F.lit(None).cast(ENTRY)})
    if entries is not None:
        marked = marked.unionByName(entries.select("_series", "_chunk", "_entry", F.lit(0).alias("_slot")), allowMissingColumns=True)
    group = ["_series", "_chunk"]
    return marked.repartition(*group).sortWithinPartitions(*group, "_slot", *order)


def _summarise(rows: DataFrame, entries: DataFrame | None, order: list[str], run: str) -> DataFrame:
    """What every chunk of ``rows`` does to the price and last run it is entered with."""
    types = _arrow(SUMMARY.fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, state, moved, n = None, None, False, 0
        def done():
            return [(*chunk, moved, n, *(state or (None,) * 5))] if chunk and n else []

        for batch in batches:
            out = []
            for series, number, entry, price, run_id, now in zip(
                *[batch.column(c).to_pylist() for c in ("_series", "_chunk", "_entry", "price", run, "_us")]
            ):
                if (series, number) != chunk:
                    out += done()
                    chunk, state, moved, n = (series, number), None, False, 0
                if entry is not None:
                    state = (entry["current"], None, None, 0, entry["last"])
                    continue
                after, flags = advance(state, price, run_id, now)
                moved, state, n = moved or state is None or flags[0], after, n + 1
            yield _batch(out, types)
        yield _batch(done(), types)

    return _seeded(rows, entries, order).select("_series", "_chunk", "_entry", "price", run, "_us").mapInArrow(walk, SUMMARY)


def _batch(rows: list[tuple], types: list[pa.Field]) -> pa.RecordBatch:
    values = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, types)], [f.name for f in types])


def _entries_between(chunked: DataFrame, order: list[str], run: str) -> DataFrame:
    """The state every chunk but a series' first is entered with."""
    long_series = chunked.filter(F.col("_chunk") > 0).select("_series").distinct()
    work = persist_table(chunked.join(long_series, "_series", "left_semi").select("_series", "_chunk", "price", run, "_us", *[
        c for c in order if c not in ("price", run)]), "tracker-chunks")
    known = persist_table(_summarise(work, None, order, run), "tracker-summaries")
    met = None
    while True:
        later = known.select("_series", (F.col("_chunk") + 1).alias("_chunk"), "current", "last")
        later = persist_table(later.join(known.select("_series", "_chunk"), ["_series", "_chunk"], "left_semi"), "tracker-entries")
        changed = later
        if met is not None:
            old = met.select("_series", "_chunk", F.col("current").alias("_c"), F.col("last").alias("_l"))
            changed = later.join(old, ["_series", "_chunk"], "left").filter(
                ~(F.col("current").eqNullSafe(F.col("_c")) & F.col("last").eqNullSafe(F.col("_l")))).select(*later.columns)
        changed = persist_table(changed, "tracker-changed")
        if changed.isEmpty():
            break
        nothing = F.lit(None)
        entries = changed.select("_series", "_chunk", F.struct(
            "current", nothing.cast("double").alias("previous"), nothing.cast("long").alias("since"),
            F.lit(0).cast("long").alias("runs"), "last", F.lit(0).cast("long").alias("position")).alias("_entry"))
        redo = _summarise(work.join(changed.select("_series", "_chunk"), ["_series", "_chunk"], "left_semi"), entries, order, run)
        kept = known.join(changed.select("_series", "_chunk"), ["_series", "_chunk"], "left_anti")
        known, met = persist_table(kept.unionByName(redo), "tracker-summaries"), later

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, position, out = None, 0, []
        for r in pdf.sort_values("_chunk").itertuples(index=False):
            if state is not None:
                out.append((r[0], int(r[1]), dict(zip(ENTRY.names, (*state, position)))))
            if r.moved:
                state = (r.current, _none(r.previous), int(r.since), int(r.runs), _none(r.last))
            else:
                state = (*state[:3], state[3] + int(r.runs), _none(r.last))
            position += int(r.rows)
        return pd.DataFrame(out, columns=["_series", "_chunk", "_entry"])

    # A group here holds one row per chunk of a series.
    return known.groupBy("_series").applyInPandas(compose, T.StructType([*SUMMARY.fields[:2], T.StructField("_entry", ENTRY)]))


def _none(value):
    return None if value is None or value != value else value


def track_changes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], run: str, keep: Sequence[str], time: str = "seen_at",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Persistence of every observation's price within its series.

    Rows are streamed in time order with six values of state; nothing is
    collected, and chunks of a long series are walked by different tasks.
    """
    keys, order, keep = list(keys), list(order), list(keep)
    ship_package(df.sparkSession)
    rows = df.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))).filter(F.col("price").isNotNull())
    needed = list(dict.fromkeys([*keys, *order, *keep, run, "price", "_us"]))
    chunked, cut = chunk_series(rows.select(*needed), keys, F.col("_us"), chunk_rows)
    named = chunked.withColumn("_series", series_key(keys))
    entries = None
    if cut:
        named = persist_table(named, "tracked-rows")
        entries = persist_table(_entries_between(named, order, run), "tracker-entries")
    out_columns = list(dict.fromkeys([*keys, *keep]))
    types = _arrow(TRACKED.fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, state, position = None, None, 0
        for batch in batches:
            picked, results = [], []
            for i, (series, number, entry, price, run_id, now) in enumerate(zip(
                *[batch.column(c).to_pylist() for c in ("_series", "_chunk", "_entry", "price", run, "_us")]
            )):
                if (series, number) != chunk:
                    chunk, state, position = (series, number), None, 0
                if entry is not None:
                    state, position = tuple(entry[f] for f in ENTRY.names[:5]), entry["position"]
                    continue
                position += 1
                state, flags = advance(state, price, run_id, now)
                picked.append(i)
                results.append((*state[:4], *flags, position))
            kept = batch.select(out_columns).take(pa.array(picked, pa.int64()))
            done = _batch(results, types)
            yield pa.RecordBatch.from_arrays([*kept.columns, *done.columns], [*out_columns, *[f.name for f in types]])

    ready = _seeded(named, entries, order)
    schema = T.StructType([ready.schema[c] for c in out_columns] + TRACKED.fields)
    return ready.select(*dict.fromkeys(["_series", "_chunk", "_entry", "price", run, "_us", *out_columns])).mapInArrow(walk, schema)


def latest_states(tracked: DataFrame, keys: Sequence[str]) -> DataFrame:
    columns = ["current_price", "previous_price", "first_seen_us", "persisted_runs"]
    last = tracked.groupBy(*keys).agg(F.max_by(F.struct(*columns), "position").alias("_s"))
    return last.select(*keys, "_s.*")


def unstable(states: DataFrame) -> DataFrame:
    return states.filter(F.col("persisted_runs") < STABLE_RUNS)


def tracker_statistics(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count(F.lit(1)).alias("total_tracked"),
        F.count_if(F.col("persisted_runs") >= STABLE_RUNS).alias("stable"),
        F.count_if(F.col("persisted_runs") < STABLE_RUNS).alias("unstable"),
    )
