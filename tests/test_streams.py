"""A stream with a closing row gives what the batch gives, also where many rows share a time."""

import datetime as dt

import numpy as np
import pytest

from tidemark.catalog import streams
from tidemark.operators import fold as G
from tidemark.operators import rules as R
from tidemark.streaming import ordered as O

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("kind", ["STRING", "LONG"])
def test_stream_equals_batch_on_whole_days(spark, kind):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        ident = int(rng.integers(1, 10**9)) if kind == "LONG" else "x" * int(rng.integers(0, 3)) + str(i)
        price = None if i % 29 == 3 else float(rng.choice([100.0, 101.0, 130.0, 300.0]))
        rows.append((ident, [1, 2, 3, None][i % 4] if kind == "LONG" else i % 3, T0 + dt.timedelta(days=int(i // 30)), price))
    frame = spark.createDataFrame(rows, f"obs_id {kind}, product_id LONG, seen_at TIMESTAMP, price DOUBLE")
    out = streams.arrivals(spark, "", lambda s: O.stream_fold(s, ["product_id"], R.zscore_rule(1.2), ident="obs_id"), "test-stream", events=frame)
    got = sorted((str(r.ident), r.observation_count, r.flagged, round(r.score, 9), r.severity) for r in out.collect())
    batch = G.gated_fold(frame, ["product_id"], ["seen_at", "obs_id"], R.zscore_rule(1.2), keep=["obs_id"])
    assert got == sorted((str(r.obs_id), r.observation_count, r.flagged, round(r.score, 9), r.severity) for r in batch.collect())
    assert len(got) == len(rows) and any(r[2] for r in got)
