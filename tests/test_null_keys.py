"""Null keys are a series, keys beyond 2^53 stay apart, and chunk sizes change no row."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import fold as G
from tidemark.operators import inject as I
from tidemark.operators import outliers as U
from tidemark.operators import rules as R
from tidemark.operators.tracker import track_changes

T0 = dt.datetime(2024, 1, 1)
ORDER = ["seen_at", "obs_id"]
BIG = 2**53


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(8), []
    for key, n in ((None, 90), (BIG, 12), (BIG + 1, 12), (3, 140)):
        for i in range(n):
            price = float(rng.choice([100.0, 101.0, 105.0, 180.0]))
            # Three observations share each time.
            out.append((f"{key}-{i:04d}", key, "SHOP", price, price + 5, T0 + dt.timedelta(hours=i // 3), f"r{i // 4}"))
    schema = "obs_id STRING, product_id LONG, competitor_id STRING, price DOUBLE, list_price DOUBLE, seen_at TIMESTAMP, run_id STRING"
    return spark.createDataFrame(out, schema).repartition(3).cache()


def run(df, name, chunk):
    keys = ["product_id"]
    if name == "fold":
        return G.gated_fold(df, keys, ORDER, R.zscore_rule(1.2), keep=["obs_id", *keys], chunk_rows=chunk)
    if name == "states":
        out = G.final_states(df, keys, ORDER, R.zscore_rule(1.2), chunk_rows=chunk)
        return out.select(F.col("product_id").cast("string").alias("obs_id"), "_state.prices", "_state.last_price")
    if name == "runs":
        return X.unchanged_runs(df, keys, ORDER, chunk_rows=chunk).select("obs_id", *keys, "consecutive_unchanged", "last_change_at")
    if name == "features":
        return X.rolling_features(df, keys, ORDER, chunk_rows=chunk).select("obs_id", *keys, "observation_count", F.round("rolling_mean", 9))
    if name == "outliers":
        return U.series_outliers(df, keys, "price", "obs_id", slice_rows=chunk).select("obs_id", *keys, F.round("z", 9), "is_outlier")
    if name == "tracker":
        return track_changes(df, keys, ORDER, "run_id", ["obs_id"])
    named = df.withColumn("currency", F.lit("C")).withColumn("product_name", F.lit("a product"))
    return I.inject(named, keys, rate=0.2).select("obs_id", *keys, "anomaly_type", F.round("price", 9))


@pytest.mark.parametrize("name", ["fold", "states", "runs", "features", "outliers", "tracker", "inject"])
def test_same_rows_at_two_chunk_sizes(rows, name):
    whole = sorted(map(str, run(rows, name, 10_000).collect()))
    assert len(whole) == (4 if name == "states" else 254)
    assert sorted(map(str, run(rows, name, 40).collect())) == whole


def test_neighbouring_large_keys_do_not_mix(rows):
    out = run(rows, "fold", 10_000).filter(F.col("product_id") == BIG + 1).orderBy("obs_id").collect()
    assert [r.observation_count for r in out][:1] == [0] and len(out) == 12
    nulls = run(rows, "tracker", None).filter("product_id is null").agg(F.max("position")).first()[0]
    assert nulls == 90
