"""Models inside the gated fold: equal to one sequential walk, also over cut series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import types as ST

from tidemark.operators import fold as G
from tidemark.operators import forest as T
from tidemark.operators import rules as R

T0 = dt.datetime(2024, 1, 1)
KEYS, ORDER = ["product_id"], ["seen_at", "obs_id"]


def made_rows():
    rng = np.random.default_rng(12)
    rows = []
    for key, n in ((1, 180), (2, 33), (3, 2), (None, 20), (4, 33)):
        for i in range(n):
            price = None if i % 17 == 5 else float(rng.choice([100.0, 101.0, 240.0, 20.0], p=[0.5, 0.3, 0.1, 0.1]) + rng.integers(0, 3))
            rows.append((f"{key}-{i:04d}", key, price, None if i % 4 else 105.0, "A" if key in (1, 2) else "B" if key != 4 else "C", T0 + dt.timedelta(hours=int(i * 7))))
    return rows


def grown(spark):
    rng = np.random.default_rng(1)
    trees = []
    for scope in ("A", "B"):
        for t in range(5):
            sample = np.abs(rng.normal(size=(32, 12))) * [100, 1, 1, 1, 100, 20, 90, 120, 1, 0.3, 0.4, 0.5]
            nodes = T.grow_tree(sample, rng, 1.0, False)
            trees.append((scope, t, *[nodes[f.name] or None if f.name != "psi" else 32 for f in T.TREE_FIELDS]))
    schema = ST.StructType([ST.StructField("scope", ST.StringType()), ST.StructField("tree", ST.IntegerType()), *T.TREE_FIELDS])
    limits = spark.createDataFrame([("A", 0.4, 0.8), ("B", 0.35, 0.9)], "scope STRING, score_low DOUBLE, score_high DOUBLE")
    return spark.createDataFrame(trees, schema), limits


def plain_walk(rows, model, limits, threshold, acceptance):
    forests = T._load(model.collect(), ["scope"], 12)
    known = {(r.scope,): (r.score_low, r.score_high) for r in limits.collect()}
    out, bases, rule = {}, {}, R.model_rule(threshold)
    for ident, key, price, list_price, scope, seen in sorted(rows, key=lambda r: (r[5], r[0])):
        base = bases.setdefault(key, R.Baseline())
        now = int((seen - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        probe = R.Baseline(*base.snapshot())
        if acceptance:
            probe.released(price or 0.0, now, 0.02, 24.0)
        trees = forests.get((scope,))
        score = None
        if trees:
            x = np.array([R.tree_inputs(price or 0.0, list_price, probe)])
            raw = 2.0 ** -(sum(T.tree_paths(x, t)[0] for t in trees) / len(trees) / T.average_path(32))
            low, high = known[(scope,)]
            score = min(max((raw - low) / (high - low), 0.0), 1.0)
        result = G.step(base, price, now, {"model_score": score}, rule, acceptance)
        out[ident] = (result[0], result[7], round(result[8], 9), result[9], result[10], result[11])
    return out


@pytest.mark.parametrize("acceptance", [False, True])
@pytest.mark.parametrize("chunk_rows, model_bytes", [(None, 1 << 28), (40, 1 << 28), (None, 1)])
def test_gated_forest_equals_walk(spark, monkeypatch, acceptance, chunk_rows, model_bytes):
    monkeypatch.setattr(T, "MODEL_BYTES", model_bytes)
    rows, (model, limits) = made_rows(), grown(spark)
    df = spark.createDataFrame(rows, "obs_id STRING, product_id LONG, price DOUBLE, list_price DOUBLE, scope STRING, seen_at TIMESTAMP")
    got = T.gated_forest(df.repartition(3), ["scope"], model, limits, KEYS, ORDER, R.model_rule(0.7), keep=["obs_id"],
                         acceptance=acceptance, chunk_rows=chunk_rows).collect()
    found = {r.obs_id: (r.observation_count, r.flagged, round(r.score, 9), r.severity, r.types, r.accepted) for r in got}
    want = plain_walk(rows, model, limits, 0.7, acceptance)
    assert len(got) == len(rows) and found == want
    flags = [v[1] for v in want.values()]
    assert 0 < sum(flags) < len(flags)


def test_rows_of_a_round_share_one_call(spark):
    """Two series of one batch: as many calls as the longer one has rows."""
    class Counting:
        columns = ["list_price"]

        def scores(self, inputs, rows):
            assert inputs.shape == (len(rows), 12)
            return [float(len(rows))] * len(rows)

    rows = [(f"{k}{i:02d}", k, 100.0 + i, None, "A", T0 + dt.timedelta(hours=i)) for k, n in ((1, 9), (2, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "obs_id STRING, product_id LONG, price DOUBLE, list_price DOUBLE, scope STRING, seen_at TIMESTAMP")
    got = G.gated_fold(df.coalesce(1), KEYS, ORDER, R.model_rule(9.0), keep=["obs_id", "product_id"], model=Counting()).collect()
    assert len(got) == 13 and {r.score for r in got} <= {1.0, 2.0}


def test_plain_trees_are_walked_together(monkeypatch):
    """The same paths to the last bit, without a walk per tree."""
    rng = np.random.default_rng(8)
    X = rng.normal(size=(1_300, 12)).round(1)
    X[5, 3] = np.nan
    trees = []
    for n in (1, 2, 64, 256, 256):
        nodes = T.grow_tree(X[10 : 10 + n], rng, 0.75, False)
        trees.append({k: np.asarray(nodes[k]) for k in ("feature", "cut", "left", "right", "path")} | {"normals": None, "psi": n})
    want = sum(T.tree_paths(X, t) for t in trees) / len(trees)

    def walked(X, tree):
        raise AssertionError("one tree alone")

    monkeypatch.setattr(T, "tree_paths", walked)
    for size in (1, 7, 1_300):
        assert T.Grove(trees).paths(X[:size]).tolist() == want[:size].tolist()
