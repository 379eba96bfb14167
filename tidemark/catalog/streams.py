"""The stateful operators on file streams of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import EV, event_observations, query, r6, r6_sql, rounded, with_sql
from tidemark.catalog.quality import TRACK
from tidemark.catalog.scoring import fold_sql, z_parts
from tidemark.operators import rules as R
from tidemark.session import scratch_path
from tidemark.streaming import ordered as O


def arrivals(spark, d, build, label: str, parts: int = 3, events=None):
    """Events arriving in time slices, then a closing row; after each the stream runs and stops, and later resumes.

    All slices together are the whole table.
    """
    events = event_observations(spark, d) if events is None else events
    events = events.withColumn(O.CLOSING, F.lit(False))
    source, out, checkpoint = (scratch_path(spark, f"{label}-{k}") for k in ("input", "output", "checkpoint"))
    clock = F.unix_micros("seen_at")
    cuts = events.agg(F.percentile_approx(clock, [i / parts for i in range(1, parts)])).first()[0]
    edges = [None, *cuts, None]
    slices = []
    for low, high in zip(edges, edges[1:]):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (clock >= low)
        if high is not None:
            inside = inside & (clock < high)
        slices.append(events.filter(inside))
    for arriving in [*slices, O.closing_row(events)]:
        arriving.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(events.schema).parquet(source))
        O.start_to_table(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_gated_zscore", with_sql(EV, fold_sql("user_id", "event_id", "SELECT * FROM ev", *z_parts(1.5)),
    body=f"""SELECT ident AS event_id, n AS observation_count, {r6_sql('z', 'price_zscore')}, flagged, {r6_sql('score', 'score')} FROM walk
  WHERE rn > 0""", recursive=True))
def stream_gated_zscore(spark, d):
    out = arrivals(spark, d, lambda s: O.stream_fold(s, ["user_id"], R.zscore_rule(1.5), ident="event_id"), "stream-fold")
    return rounded(out, "price_zscore", "score").select(
        F.col("ident").cast("long").alias("event_id"), "observation_count", "price_zscore", "flagged", "score")


@query("stream_change_persistence", with_sql(TRACK, body=f"""SELECT event_id, {r6_sql('prev', 'previous_price')}, changed AS price_changed, runs AS persisted_runs,
  stable AS is_stable FROM tw""", recursive=True))
def stream_change_persistence(spark, d):
    def build(stream):
        runs = stream.withColumns({"price": F.round(F.col("price") / 10), "run": F.date_format("seen_at", "yyyy-MM-dd")})
        return O.stream_tracker(runs, ["user_id"], "run", ident="event_id")

    out = arrivals(spark, d, build, "stream-tracker")
    return out.select(F.col("ident").cast("long").alias("event_id"), r6("previous_price", "previous_price"),
                      "price_changed", "persisted_runs", "is_stable")
