"""Many rules over one read: each candidate is folded against a baseline of its own.

Rows are shuffled and sorted once. Candidates start from the same baseline and
share it for as long as they decide alike; a baseline is copied only where its
candidates part. Statistics of a shared baseline are computed once, so a grid of
candidates costs little more than the few baselines they part into. Counts of rules
that differ by a cut alone (``rules.measured``) take one look per baseline and kind.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.fold import RESULT, Rule, _none, _sorted_input, listed, state_from
from tidemark.operators.rules import Baseline

COUNTS = ["tp", "fp", "fn", "tn"]


class Cohort:
    """Candidates of one series, in groups that share a baseline."""

    def __init__(self, rules: dict[str, Rule], state=None):
        self.rules = rules
        self.groups: list[tuple[Baseline, list[str]]] = [(state_from(state), list(rules))]
        self.failed: dict[str, str] = {}

    def step(self, price: float | None, now: int, row: dict, acceptance: bool, tolerance: float, hours: float) -> dict[str, tuple]:
        """Score one observation under every candidate: the results by name, as ``fold.step`` gives them.

        A candidate whose rule raises has no further results; ``failed`` holds the message.
        """
        value, found, after = 0.0 if price is None else price, {}, []
        for base, names in self.groups:
            accepted = acceptance and base.released(value, now, tolerance, hours)
            n = len(base.prices)
            mean, std = base.mean_std() if n else (None, None)
            days = None if base.last_change is None else (now - base.last_change) / 8.64e10
            z, change, unchanged = base.zscore(value), base.change(value), base.unchanged
            held, joining = [], []
            for name in names:
                try:
                    flagged, score, severity, types, _ = self.rules[name](value, base, row)
                except Exception as error:  # noqa: BLE001 - a failing candidate is reported, the others go on
                    self.failed[name] = f"{type(error).__name__}: {error}"
                    continue
                flagged = flagged and not accepted
                (held if flagged else joining).append(name)
                found[name] = (n, mean, std, z, change, unchanged, days, flagged, score, severity, types, accepted)
            if accepted:
                after.append((base, joining))
                continue
            if held:
                other = Baseline(*base.snapshot()) if joining else base
                if acceptance:
                    other.hold(value, now, tolerance)
                after.append((other, held))
            if joining:
                base.accept(value, now)
                after.append((base, joining))
        self.groups = after
        return found


class Spans:
    """Measured candidates of one series. Of one kind a row flags those with the lowest cuts, so a group that
    shares a baseline is a span of ascending cuts per kind, and it parts by cutting spans in two.

    ``kinds``: reach, cuts and names of each.
    """

    def __init__(self, kinds: list[tuple], state=None):
        self.kinds = kinds
        self.groups = [(state_from(state), [(k, 0, len(cuts)) for k, (_, cuts, _) in enumerate(kinds)])]
        self.failed: dict[str, str] = {}

    def count(self, price: float | None, now: int, flagged: list[list[int]], clear: list[list[int]]) -> None:
        """Count one observation: a span adds one at its beginning and takes it off behind its end."""
        value, after = 0.0 if price is None else price, []
        for base, spans in self.groups:
            held, joining = [], []
            for k, lo, hi in spans:
                reach, cuts, names = self.kinds[k]
                try:
                    middle = reach(value, base, cuts, lo, hi)
                except Exception as error:  # noqa: BLE001 - failing candidates are reported, the others go on
                    self.failed.update(dict.fromkeys(names[lo:hi], f"{type(error).__name__}: {error}"))
                    continue
                if middle > lo:
                    flagged[k][lo] += 1
                    flagged[k][middle] -= 1
                    held.append((k, lo, middle))
                if middle < hi:
                    clear[k][middle] += 1
                    clear[k][hi] -= 1
                    joining.append((k, middle, hi))
            if held:
                after.append((base.copy() if joining else base, held))
            if joining:
                base.accept(value, now)
                after.append((base, joining))
        self.groups = after


def _kinds(rules: dict[str, Rule]) -> list[tuple] | None:
    """The rules by kind with their cuts in order; None unless all are measured."""
    if not all(hasattr(r, "kind") for r in rules.values()):
        return None
    found: dict[tuple, list] = {}
    for name, rule in rules.items():
        found.setdefault(rule.kind, []).append((rule.cut, name, rule.reach))
    ordered = [sorted(members, key=lambda m: m[:2]) for members in found.values()]
    return [(members[0][2], [m[0] for m in members], [m[1] for m in members]) for members in ordered]


def _cohorts(batch: pa.RecordBatch, column: dict[str, list], fresh, current: list) -> Iterator[tuple[int, Cohort | Spans]]:
    """Rows of a batch with the candidates of their series, as ``fresh(state)`` gives them; ``current`` carries [series, candidates] between batches."""
    for i, series in enumerate(column["_series"]):
        if series != current[0]:
            current[:] = [series, fresh(None)]
        if column["_state"][i] is not None:
            current[1] = fresh(column["_state"][i])
            continue
        yield i, current[1]


def _ready(df, keys, order, columns, states, time) -> DataFrame:
    needed = list(dict.fromkeys([*keys, *order, *columns, "price"]))
    rows = df.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))).select(*needed, "_us")
    ready = _sorted_input(rows, states, list(keys), list(order), with_ends=False)
    return ready.select(*dict.fromkeys(["_series", "_state", "price", "_us", *columns]))


def fold_many(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rules: dict[str, Rule], *, keep: Sequence[str],
    extra: Sequence[str] = (), states: DataFrame | None = None, acceptance: bool = False, tolerance: float = 0.02,
    hours: float = 24.0, time: str = "seen_at", name: str = "detector",
) -> DataFrame:
    """``gated_fold`` for several rules at once: a row per observation and rule, from one preload and one shuffle.

    One task walks a series; use ``gated_fold`` for series that must be cut.
    """
    keep, extra = list(keep), list(extra)
    ready = _ready(df, keys, order, [*keep, *extra], states, time)
    schema = T.StructType([ready.schema[c] for c in keep] + [T.StructField(name, T.StringType())] + RESULT.fields)
    types = [to_arrow_type(f.dataType) for f in RESULT.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = [None, None]
        for batch in batches:
            column = {c: listed(batch.column(c)) for c in ("_series", "_state", "price", "_us", *extra)}
            picked, names, results = [], [], []
            for i, cohort in _cohorts(batch, column, partial(Cohort, rules), current):
                row = {c: column[c][i] for c in extra}
                for rule, result in cohort.step(_none(column["price"][i]), column["_us"][i], row, acceptance, tolerance, hours).items():
                    picked.append(i)
                    names.append(rule)
                    results.append(result)
            kept = batch.select(keep).take(pa.array(picked, pa.int64()))
            values = list(zip(*results)) if results else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(names, pa.string()), *[pa.array(v, t) for v, t in zip(values, types)]], schema.names)

    return ready.mapInArrow(walk, schema)


def count_many(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rules: dict[str, Rule], by: Sequence[str], *,
    truth: str = "truth", extra: Sequence[str] = (), states: DataFrame | None = None, time: str = "seen_at",
) -> DataFrame:
    """Confusion counts of every candidate per ``by``: ``candidate_id``, tp, fp, fn, tn, ``status``, ``message``.

    Counts leave the tasks once a batch, never rows. A candidate that raises
    anywhere in a group of ``by`` has status 'error' there, with a message and null counts.
    """
    by, extra = list(by), list(extra)
    ready = _ready(df, keys, order, [*by, truth, *extra], states, time)
    fields = [ready.schema[c] for c in by]
    counted = T.StructType([*fields, T.StructField("candidate_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS],
                            T.StructField("message", T.StringType())])
    types = [to_arrow_type(f.dataType) for f in counted.fields]
    kinds = _kinds(rules)

    def measured(batch: pa.RecordBatch, column: dict[str, list], current: list, counts: dict, messages: dict) -> None:
        tallies: dict[tuple, tuple] = {}
        for i, spans in _cohorts(batch, column, partial(Spans, kinds), current):
            group, real = tuple(column[c][i] for c in by), bool(column[truth][i])
            if (group, real) not in tallies:
                tallies[group, real] = tuple([[0] * (len(cuts) + 1) for _, cuts, _ in kinds] for _ in range(2))
            spans.count(_none(column["price"][i]), column["_us"][i], *tallies[group, real])
            for name, message in spans.failed.items():
                messages[(*group, name)] = message
        for (group, real), tally in tallies.items():
            for kind, (_, _, names) in enumerate(kinds):
                for name, hit, passed in zip(names, accumulate(tally[0][kind]), accumulate(tally[1][kind])):
                    if hit or passed:
                        cell = counts.setdefault((*group, name), [0, 0, 0, 0])
                        cell[0 if real else 1] += hit
                        cell[2 if real else 3] += passed

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = [None, None]
        for batch in batches:
            column = {c: listed(batch.column(c)) for c in dict.fromkeys(["_series", "_state", "price", "_us", truth, *by, *extra])}
            counts, messages = {}, {}
            if kinds is not None:
                measured(batch, column, current, counts, messages)
            for i, cohort in _cohorts(batch, column, partial(Cohort, rules), current) if kinds is None else ():
                group, real = tuple(column[c][i] for c in by), bool(column[truth][i])
                row = {c: column[c][i] for c in extra}
                for name, result in cohort.step(_none(column["price"][i]), column["_us"][i], row, False, 0.0, 0.0).items():
                    cell = counts.setdefault((*group, name), [0, 0, 0, 0])
                    cell[(0 if real else 1) if result[7] else (2 if real else 3)] += 1
                for name, message in cohort.failed.items():
                    messages[(*group, name)] = message
            rows = [(*k, *counts.get(k, (0, 0, 0, 0)), messages.get(k)) for k in {**counts, **messages}]
            values = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], counted.names)

    sums = ready.mapInArrow(walk, counted).groupBy(*by, "candidate_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.min("message").alias("message"))
    failed = F.col("message").isNotNull()
    return sums.select(
        *by, "candidate_id", *[F.when(~failed, F.col(c)).alias(c) for c in COUNTS],
        F.when(failed, "error").otherwise("ok").alias("status"), F.coalesce("message", F.lit("")).alias("message"),
    )
