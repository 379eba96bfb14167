"""Keyed state on a stream, with each series applied in event-time order.

Rows wait in keyed state until the watermark has passed them; timers at the
newest times of each series and micro-batch then release all rows up to
theirs, in the batch's order: time, then id by its own type. Rows
behind the watermark are dropped by Spark and counted in its
``numRowsDroppedByWatermark`` metric. The watermark never passes the newest row;
a source that has ended says so with a closing row (``closing_row``), which is
later than all others, frees them and is not returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.fold import RESULT, STATE, Rule, step
from tidemark.operators.rules import Baseline
from tidemark.operators.tracker import TRACKED, advance
from tidemark.plans.skew import series_key
from tidemark.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WAITING = T.StructType([
    T.StructField("us", T.LongType()),
    T.StructField("ident", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("run", T.StringType()),
])

TRACK_STATE = T.StructType([
    T.StructField("current_price", T.DoubleType()),
    T.StructField("previous_price", T.DoubleType()),
    T.StructField("first_seen_us", T.LongType()),
    T.StructField("runs", T.LongType()),
    T.StructField("last_run", T.StringType()),
    T.StructField("position", T.LongType()),
])


def _clean(value):
    return None if value is None or value != value else value


class OrderedProcessor(StatefulProcessor):
    """Runs ``apply(state tuple or None, row) -> (state tuple, output tuple)`` in time order."""

    def __init__(self, apply: Callable, state: T.StructType, outputs: list[str], whole_ids: bool):
        self.apply, self.state_type, self.outputs = apply, state, outputs
        # Ids of whole numbers are ordered as numbers, others as text; missing ones come first, as in a batch.
        self.place = (lambda r: (r[0], r[1] is not None, int(r[1] or 0))) if whole_ids else (lambda r: (r[0], r[1] is not None, r[1] or ""))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_type)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        times: set[int] = set()
        for pdf in rows:
            pdf = pdf[~pdf["closing"].astype(bool)]
            arrived = [(int(us), _clean(ident), _clean(price), _clean(run))
                       for us, ident, price, run in zip(pdf["us"], pdf["ident"], pdf["price"], pdf["run"])]
            if arrived:
                self.waiting.appendList(arrived)
            # Timers are in milliseconds; rounding up never fires before the row's own time.
            times.update(row[0] // 1000 + 1 for row in arrived)
        # The newest row of all may wait for good; the timer before it frees the rest of its series.
        for due in sorted(times)[-2:]:
            self.handle.registerTimer(due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = list(self.waiting.get())
        ready = sorted((r for r in rows if r[0] <= due), key=self.place)
        rest = [r for r in rows if r[0] > due]
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for us, ident, price, run in ready:
            state, result = self.apply(state, (us, price, run))
            out.append((*key, ident, *result))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if state is not None:
            self.state.update(state)
        columns = ["_series", "ident", *self.outputs]
        yield pd.DataFrame(out, columns=columns, dtype=object)

    def close(self) -> None:
        pass


CLOSING = "_closing"


def closing_row(rows: DataFrame, time: str = "seen_at", after: str = "1 second") -> DataFrame:
    """One row of the stream's schema, ``after`` the newest of ``rows``, that ends the source; null elsewhere."""
    last = rows.agg((F.max(F.col(time).cast("timestamp")) + F.expr(f"INTERVAL {after}")).alias(time)).filter(F.col(time).isNotNull())
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != time else F.col(time) for f in rows.schema.fields]
    return last.select(*[c for c, f in zip(nothing, rows.schema.fields) if f.name != CLOSING], F.lit(True).alias(CLOSING))


def _is_closing(stream: DataFrame) -> Column:
    return F.coalesce(F.col(CLOSING), F.lit(False)) if CLOSING in stream.columns else F.lit(False)


def _run_ordered(stream: DataFrame, keys: list[str], ident: str, time: str, delay: str, run: str | None,
                 apply: Callable, state: T.StructType, result: T.StructType) -> DataFrame:
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    clock = F.col(time).cast("timestamp")
    # Null keys are series too, which grouped pandas rows cannot tell apart: group by one text and read the keys from it.
    rows = stream.select(
        series_key(keys).alias("_series"), clock.alias("event_time"), F.unix_micros(clock).alias("us"), F.col(ident).cast("string").alias("ident"),
        F.col("price").cast("double").alias("price"),
        (F.col(run) if run else F.lit(None)).cast("string").alias("run"), _is_closing(stream).alias("closing"),
    ).withWatermark("event_time", delay)
    schema = T.StructType([T.StructField("_series", T.StringType()), T.StructField("ident", T.StringType())] + result.fields)
    whole_ids = isinstance(stream.schema[ident].dataType, T.IntegralType)
    processor = OrderedProcessor(apply, state, [f.name for f in result.fields], whole_ids)
    out = rows.groupBy("_series").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    named = F.from_json("_series", T.StructType([stream.schema[k] for k in keys]))
    return out.withColumn("_keys", named).select("_keys.*", *out.columns[1:])


def stream_fold(
    stream: DataFrame, keys: list[str], rule: Rule, *, ident: str, time: str = "seen_at", delay: str = "0 seconds",
    acceptance: bool = False,
) -> DataFrame:
    """The gated fold on a stream: the same ``step`` as the batch fold, state kept by Spark."""

    def apply(state, row):
        base = Baseline() if state is None else Baseline(*state)
        result = step(base, row[1], row[0], {}, rule, acceptance)
        return base.snapshot(), result

    return _run_ordered(stream, keys, ident, time, delay, None, apply, STATE, RESULT)


def stream_tracker(
    stream: DataFrame, keys: list[str], run: str, *, ident: str, time: str = "seen_at", delay: str = "0 seconds"
) -> DataFrame:
    """Price persistence over scrape runs on a stream."""

    def apply(state, row):
        before = None if state is None else tuple(state[:5])
        position = 1 if state is None else state[5] + 1
        after, flags = advance(before, row[1], row[2], row[0])
        return (*after, position), (*after[:4], *flags, position)

    return _run_ordered(stream, keys, ident, time, delay, run, apply, TRACK_STATE, TRACKED)


def start_to_table(stream: DataFrame, out: str, checkpoint: str):
    """Start a run over the input available now, appending to a Parquet table.

    A later run with the same checkpoint continues where this one ended.
    """
    return (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
