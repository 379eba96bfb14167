"""The gated fold: a price joins its series' baseline only if it was not flagged.

Rows are shuffled once by series, sorted by time inside each partition and
walked batch by batch with a bounded state (30 prices), so no series is ever
held in memory. A series longer than ``chunk_rows`` is cut into time chunks
that run in parallel: every chunk first runs from a guessed entry state, then
chunks whose entry differs from the exit of the chunk before are run again
until all agree. The result equals the sequential walk.

A model (``model``) scores rows against the same baselines. Series do not depend
on each other, so the k-th rows of all series of a batch go through the model
together: one matrix a round in place of one call a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.rules import DEPTH, Baseline, tree_inputs
from tidemark.plans.skew import CHUNK_ROWS, chunk_series, null_safe_join, series_key
from tidemark.session import persist_table, ship_package

STATE = T.StructType([
    T.StructField("prices", T.ArrayType(T.DoubleType())),
    T.StructField("last_price", T.DoubleType()),
    T.StructField("last_change", T.LongType()),
    T.StructField("unchanged", T.LongType()),
    T.StructField("held_price", T.DoubleType()),
    T.StructField("held_since", T.LongType()),
])

RESULT = T.StructType([
    T.StructField("observation_count", T.LongType()),
    T.StructField("rolling_mean", T.DoubleType()),
    T.StructField("rolling_std", T.DoubleType()),
    T.StructField("price_zscore", T.DoubleType()),
    T.StructField("price_change_pct", T.DoubleType()),
    T.StructField("consecutive_unchanged", T.LongType()),
    T.StructField("days_since_change", T.DoubleType()),
    T.StructField("flagged", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("types", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
])

Rule = Callable[[float, Baseline, dict], tuple]


class Model(Protocol):
    """Scores rows of model inputs; ``columns`` are the row's columns it needs besides, list_price among them."""

    columns: Sequence[str]

    def scores(self, inputs: np.ndarray, rows: Sequence[dict]) -> Sequence[float | None]: ...


def _none(value):
    """Missing values of a pandas row as None."""
    return None if value is None or value != value else value


def listed(column: pa.Array) -> list:
    """``to_pylist``, quicker for columns without values, as states mostly are, and for numbers without nulls."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count == 0 and (pa.types.is_floating(column.type) or pa.types.is_integer(column.type)):
        return column.to_numpy().tolist()
    return column.to_pylist()


def state_from(value) -> Baseline:
    if value is None:
        return Baseline()
    get = value.get if isinstance(value, dict) else lambda k: getattr(value, k)
    prices = get("prices")
    whole = {k: _none(get(k)) for k in ("last_change", "unchanged", "held_since")}
    return Baseline(
        [] if prices is None else [float(p) for p in prices], _none(get("last_price")),
        None if whole["last_change"] is None else int(whole["last_change"]),
        int(whole["unchanged"] or 0), _none(get("held_price")),
        None if whole["held_since"] is None else int(whole["held_since"]),
    )


def step(base: Baseline, price: float | None, now: int, row: dict, rule: Rule,
         acceptance: bool = False, tolerance: float = 0.02, hours: float = 24.0) -> tuple:
    """Score one observation and update the baseline; shared by batch and stream."""
    value = 0.0 if price is None else price
    accepted = acceptance and base.released(value, now, tolerance, hours)
    n = len(base.prices)
    mean, std = base.mean_std() if n else (None, None)
    days = None if base.last_change is None else (now - base.last_change) / 8.64e10
    z, change, unchanged = base.zscore(value), base.change(value), base.unchanged
    flagged, score, severity, types, _ = rule(value, base, row)
    if accepted:
        flagged = False
    elif flagged:
        if acceptance:
            base.hold(value, now, tolerance)
    else:
        base.accept(value, now)
    return n, mean, std, z, change, unchanged, days, flagged, score, severity, types, accepted


class _Stretch:
    """Rows ``at`` to ``end`` of one series within a batch, and its baseline."""

    __slots__ = ("at", "end", "base", "rule")

    def __init__(self, at: int, end: int, base: Baseline, rule: Rule):
        self.at, self.end, self.base, self.rule = at, end, base, rule

    def next_row(self, column: dict[str, list], finished: list) -> bool:
        """Move to the next observation, past entry states and end markers."""
        while self.at < self.end:
            if column["_state"][self.at] is not None:
                self.base = state_from(column["_state"][self.at])
            elif column["_end"][self.at]:
                finished.append((column["_series"][self.at], self.base.snapshot()))
            else:
                return True
            self.at += 1
        return False

    def base_for(self, column: dict[str, list], acceptance: bool, tolerance: float, hours: float) -> Baseline:
        """The baseline the row will be judged by: a held price that is released by it counts already."""
        if not acceptance or self.base.held_price is None:
            return self.base
        after = Baseline(*self.base.snapshot())
        after.released(_none(column["price"][self.at]) or 0.0, column["_us"][self.at], tolerance, hours)
        return after


def _walker(keep: list[str], extra: list[str], rules: dict[str, Rule] | Rule,
            acceptance: bool, tolerance: float, hours: float, emit: str, model: Model | None = None):
    """mapInArrow body over rows sorted by series, entry state first, then time.

    Series are told apart by ``_series``, one non-null text per key, and rows to
    keep stay Arrow rows, so that keys of any type, nulls included, pass unchanged.
    """
    result_types = [pa.field(f.name, to_arrow_type(f.dataType)) for f in RESULT.fields]
    state_type = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in STATE.fields])

    def rule_of(candidate):
        return rules[candidate] if isinstance(rules, dict) else rules

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, base = None, Baseline()
        for batch in batches:
            column = {c: listed(batch.column(c)) for c in ("_series", "_state", "price", "_us", "_end", "_candidate", *extra)}
            starts = [i for i, k in enumerate(column["_series"]) if i == 0 or k != column["_series"][i - 1]]
            bases = [base if column["_series"][i] == series else Baseline() for i in starts[:1]] + [Baseline() for _ in starts[1:]]
            results, finished = [None] * batch.num_rows, []
            stretches = [_Stretch(at, end, b, rule_of(column["_candidate"][at])) for at, end, b in
                         zip(starts, [*starts[1:], batch.num_rows], bases)]
            waiting = stretches
            while waiting:
                # One row of each series; without a model a series runs to its end at once.
                at = [s for s in waiting if s.next_row(column, finished)]
                rows = [{c: column[c][s.at] for c in extra} for s in at]
                if model is not None and at:
                    inputs = [tree_inputs(_none(column["price"][s.at]) or 0.0, _none(r["list_price"]), s.base_for(column, acceptance, tolerance, hours))
                              for s, r in zip(at, rows)]
                    for row, score in zip(rows, model.scores(np.array(inputs), rows)):
                        row["model_score"] = score
                for s, row in zip(at, rows):
                    results[s.at] = step(s.base, _none(column["price"][s.at]), column["_us"][s.at], row, s.rule, acceptance, tolerance, hours)
                    s.at += 1
                    while model is None and s.next_row(column, finished):
                        row = {c: column[c][s.at] for c in extra}
                        results[s.at] = step(s.base, _none(column["price"][s.at]), column["_us"][s.at], row, s.rule, acceptance, tolerance, hours)
                        s.at += 1
                waiting = [s for s in at if s.at < s.end]
            if stretches:
                series, base = column["_series"][-1], stretches[-1].base
            if emit == "rows":
                picked = [i for i, r in enumerate(results) if r is not None]
                rows = pa.Table.from_batches([batch.select(keep)]).take(pa.array(picked, pa.int64()))
                values = list(zip(*[results[i] for i in picked])) if picked else [[] for _ in result_types]
                columns = [*[c.combine_chunks() for c in rows.columns], *[pa.array(v, f.type) for v, f in zip(values, result_types)]]
                yield pa.RecordBatch.from_arrays([_whole(c) for c in columns], [*keep, *[f.name for f in result_types]])
            else:
                names = [f.name for f in STATE.fields]
                states = pa.array([dict(zip(names, s)) for _, s in finished], state_type)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in finished], pa.string()), states], ["_series", "_state"])

    return walk


def _whole(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def baseline_states(
    train: DataFrame, keys: Sequence[str], order: Sequence[str], depth: int = DEPTH
) -> DataFrame:
    """Entry state per series: its newest ``depth`` non-null prices in time order.

    ``max_by``-style top rows are found with a window; the array holds at most
    ``depth`` values whatever the series' length.
    """
    from pyspark.sql import Window

    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    top = (
        train.filter(F.col("price").isNotNull())
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= depth)
    )
    packed = top.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("pos"), F.col("price")))),
            lambda s: s.price,
        ).alias("prices")
    )
    nothing = F.lit(None)
    return packed.select(
        *keys,
        F.struct(
            F.col("prices"),
            F.element_at("prices", -1).alias("last_price"),
            nothing.cast("long").alias("last_change"),
            F.lit(0).cast("long").alias("unchanged"),
            nothing.cast("double").alias("held_price"),
            nothing.cast("long").alias("held_since"),
        ).alias("_state"),
    )


def _sorted_input(rows: DataFrame, states: DataFrame | None, keys: list[str], order: list[str],
                  with_ends: bool) -> DataFrame:
    """Observations plus, per series, an entry-state row before and an end marker after them."""
    ship_package(rows.sparkSession)
    marked = rows.withColumn("_state", F.lit(None).cast(STATE)).withColumn("_slot", F.lit(1)) \
        .withColumn("_end", F.lit(False))
    parts = marked
    if states is not None:
        seeds = states.select(*keys, "_state").withColumn("_slot", F.lit(0)).withColumn("_end", F.lit(False))
        parts = parts.unionByName(seeds, allowMissingColumns=True)
    if with_ends:
        ends = rows.select(*keys).distinct().withColumn("_slot", F.lit(2)).withColumn("_end", F.lit(True))
        parts = parts.unionByName(ends, allowMissingColumns=True)
    parts = parts.withColumn("_series", series_key(keys))
    # The row's time and tie-break give a total order inside each series.
    return parts.repartition("_series").sortWithinPartitions("_series", "_slot", *order)


def gated_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rule: Rule | dict[str, Rule],
    *,
    keep: Sequence[str],
    extra: Sequence[str] = (),
    states: DataFrame | None = None,
    acceptance: bool = False,
    tolerance: float = 0.02,
    hours: float = 24.0,
    time: str = "seen_at",
    chunk_rows: int | None = CHUNK_ROWS,
    model: Model | None = None,
) -> DataFrame:
    """Score every row of ``df`` against its series' gated baseline.

    ``rule`` may be a dict keyed by the last key column (a candidate name), for
    folds repeated per candidate. ``states`` seeds series with earlier prices.
    ``model`` scores rows for rules that read ``model_score`` (``rules.model_rule``).
    """
    keys, order, keep = list(keys), list(order), list(keep)
    extra = list(dict.fromkeys([*extra, *(model.columns if model else ())]))
    rows, states, run_keys = _prepare(df, keys, order, keep, extra, states, rule, acceptance,
                                      tolerance, hours, time, chunk_rows, model)
    ready = _sorted_input(rows, states, run_keys, order, with_ends=False)
    fields = [ready.schema[c] for c in keep]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + RESULT.fields)
    walk = _walker(keep, extra, rule, acceptance, tolerance, hours, "rows", model)
    return _columns_read(ready, keys, keep, extra, rule).mapInArrow(walk, schema)


def _columns_read(ready: DataFrame, keys: list[str], keep: list[str], extra: list[str], rule) -> DataFrame:
    """What the walk reads; ``_candidate`` is the key a rule is chosen by, where there are several."""
    candidate = F.col(keys[-1]) if isinstance(rule, dict) else F.lit(None).cast("string")
    own = ["_series", "_state", "price", "_us", "_end"]
    return ready.withColumn("_candidate", candidate).select(*dict.fromkeys([*own, "_candidate", *keep, *extra]))


def _prepare(df, keys, order, keep, extra, states, rule, acceptance, tolerance, hours, time, chunk_rows, model=None):
    clock: Column = F.unix_micros(F.col(time).cast("timestamp"))
    needed = list(dict.fromkeys([*keys, *order, *keep, *extra, "price"]))
    rows = df.withColumn("_us", clock).select(*needed, "_us")
    if chunk_rows is None:
        return rows, states, keys
    chunked, cut = chunk_series(rows, keys, F.col("_us"), chunk_rows)
    if not cut:
        return rows, states, keys
    run_keys = [*keys, "_chunk"]
    args = (run_keys, keys, order, keep, extra, rule, acceptance, tolerance, hours, model)
    chunked = persist_table(chunked, "fold-chunks")
    return chunked, _settle_chunks(chunked, states, *args), run_keys


def _exit_states(rows, entries, run_keys, keys, order, keep, extra, rule, acceptance, tolerance, hours, model=None):
    ready = _sorted_input(rows, entries, run_keys, order, with_ends=True)
    walk = _walker(keep, extra, rule, acceptance, tolerance, hours, "states", model)
    schema = T.StructType([T.StructField("_series", T.StringType()), T.StructField("_state", STATE)])
    out = _columns_read(ready, keys, [], extra, rule).mapInArrow(walk, schema)
    named = rows.select(*run_keys).distinct().withColumn("_series", series_key(run_keys))
    return named.join(out, "_series").select(*run_keys, "_state")


def _settle_chunks(chunked, states, run_keys, keys, order, keep, extra, rule, acceptance, tolerance, hours, model=None):
    """Entry states of all chunks such that each equals the exit of the chunk before."""
    args = (run_keys, keys, order, keep, extra, rule, acceptance, tolerance, hours, model)
    # Only series with more than one chunk need settling.
    long_keys = chunked.filter(F.col("_chunk") > 0).select(*keys).distinct()
    work = null_safe_join(chunked, long_keys, keys, "left_semi")
    first = None
    if states is not None:
        first = states.withColumn("_chunk", F.lit(0)).select(*run_keys, "_state")
    entries = first
    exits = persist_table(_exit_states(work, entries, *args), "fold-exits")
    while True:
        proposed = exits.withColumn("_chunk", F.col("_chunk") + 1)
        known = chunked.select(*run_keys).distinct()
        proposed = null_safe_join(proposed, known, run_keys, "left_semi")
        if first is not None:
            proposed = proposed.unionByName(first)
        proposed = persist_table(proposed, "fold-entries")
        if entries is None:
            changed = proposed
        else:
            old = entries.withColumnRenamed("_state", "_old")
            changed = null_safe_join(proposed, old, run_keys, "left").filter(
                ~F.to_json("_state").eqNullSafe(F.to_json("_old"))
            )
        changed = persist_table(changed.select(*run_keys), "fold-changed")
        if changed.isEmpty():
            return entries
        redo = null_safe_join(work, changed, run_keys, "left_semi")
        again = _exit_states(redo, null_safe_join(proposed, changed, run_keys, "left_semi"), *args)
        exits = persist_table(
            null_safe_join(exits, changed, run_keys, "left_anti").unionByName(again), "fold-exits"
        )
        entries = proposed


def final_states(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Rule, *,
    extra: Sequence[str] = (), states: DataFrame | None = None, acceptance: bool = False,
    tolerance: float = 0.02, hours: float = 24.0, time: str = "seen_at",
    chunk_rows: int | None = CHUNK_ROWS, model: Model | None = None,
) -> DataFrame:
    """State of every series after its last row, one row per series."""
    keys, order = list(keys), list(order)
    extra = list(dict.fromkeys([*extra, *(model.columns if model else ())]))
    rows, entry, run_keys = _prepare(df, keys, order, [], extra, states, rule, acceptance,
                                     tolerance, hours, time, chunk_rows, model)
    out = _exit_states(rows, entry, run_keys, keys, order, [], extra, rule, acceptance, tolerance, hours, model)
    if "_chunk" in run_keys:
        out = out.groupBy(*keys).agg(F.max_by("_state", "_chunk").alias("_state"))
    return out
