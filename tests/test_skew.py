"""The skew-safe paths give the plain results when limits force them."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cutforest as CF
from tidemark.operators import features as X
from tidemark.operators import fold as G
from tidemark.operators import forest as T
from tidemark.operators import outliers as U
from tidemark.operators import rules as R
from tidemark.operators.tracker import track_changes
from tidemark.plans import skew as K

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """One series with most rows, some short ones, repeated times and prices."""
    rng = np.random.default_rng(5)
    rows = []
    for key, n in ((1, 260), (2, 40), (3, 3)):
        for i in range(n):
            price = float(rng.choice([100.0, 101.0, 105.0, 180.0])) if i % 11 else float(rng.normal(100, 30))
            rows.append((f"{key}-{i:04d}", key, price, T0 + dt.timedelta(hours=int(i * 0.8))))
    df = spark.createDataFrame(rows, "obs_id STRING, product_id LONG, price DOUBLE, seen_at TIMESTAMP")
    return df.repartition(4).cache()


ORDER = ["seen_at", "obs_id"]


def frame(df, *sort):
    return df.toPandas().sort_values(list(sort)).reset_index(drop=True)


def test_windows_over_chunks(hot):
    plain = frame(X.rolling_features(hot, ["product_id"], ORDER), "obs_id")
    cut = frame(X.rolling_features(hot, ["product_id"], ORDER, chunk_rows=50), "obs_id")
    pd.testing.assert_frame_equal(plain, cut[plain.columns], rtol=1e-9)
    short = frame(X.history_arrays(hot, ["product_id"], ORDER, depth=5, chunk_rows=10), "obs_id")
    full = frame(X.history_arrays(hot, ["product_id"], ORDER, depth=5), "obs_id")
    assert [list(h) for h in short.history] == [list(h) for h in full.history]


@pytest.mark.parametrize("acceptance", [False, True])
def test_fold_over_chunks(hot, acceptance):
    def run(rows):
        return frame(G.gated_fold(hot, ["product_id"], ORDER, R.zscore_rule(1.2), keep=["obs_id"],
                                  acceptance=acceptance, chunk_rows=rows), "obs_id")
    pd.testing.assert_frame_equal(run(None), run(60))


def test_runs_over_chunks(hot):
    plain = frame(X.unchanged_runs(hot, ["product_id"], ORDER), "obs_id")
    cut = frame(X.unchanged_runs(hot, ["product_id"], ORDER, chunk_rows=40), "obs_id")
    pd.testing.assert_frame_equal(plain, cut[plain.columns])


def test_final_states_over_chunks(hot):
    def run(rows):
        out = G.final_states(hot, ["product_id"], ORDER, R.zscore_rule(1.2), chunk_rows=rows)
        return frame(out.select("product_id", F.to_json("_state").alias("s")), "product_id")
    pd.testing.assert_frame_equal(run(None), run(60))


def test_tracker_ignores_partitioning(hot):
    runs = hot.withColumn("run", F.date_format("seen_at", "yyyyMMdd"))
    a = frame(track_changes(runs, ["product_id"], ORDER, "run", ["obs_id"]), "obs_id")
    b = frame(track_changes(runs.repartition(7), ["product_id"], ORDER, "run", ["obs_id"]), "obs_id")
    pd.testing.assert_frame_equal(a, b)


def test_row_numbers_and_cuts(hot):
    u = F.crc32(F.col("obs_id")) / 2.0**32
    df = hot.withColumn("u", u)
    got = frame(K.bucketed_row_number(df, ["product_id"], F.floor(F.col("u") * 16), [F.col("u"), F.col("obs_id")]), "obs_id")
    want = got.sort_values(["product_id", "u", "obs_id"]).groupby("product_id").cumcount() + 1
    assert (got.row_number == want.sort_index()).all()
    for n in (1, 17, 260):
        limits = df.select("product_id").distinct().withColumn("_limit", F.lit(n).cast("long"))
        cut = K.hash_cut(df, ["product_id"], "u", "obs_id", limits)
        kept = K.join_small(df, cut, ["product_id"], "left").filter(K.up_to_cut("u", "obs_id")).toPandas()
        ids = set(kept.obs_id)
        sizes = got.groupby("product_id").size()
        expected = set(got[(got.row_number <= n) & (got.product_id.map(sizes) >= n)].obs_id)
        assert ids == expected


def test_percentiles_by_slices(hot):
    ps = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    pdf = hot.toPandas()
    for rows in (10**9, 20):
        got = frame(K.exact_percentiles(hot, ["product_id"], "price", ps, slice_rows=rows), "product_id")
        for _, r in got.iterrows():
            values = pdf[pdf.product_id == r.product_id].price
            assert [r[k] for k in ps] == pytest.approx([np.quantile(values, p) for p in ps.values()])


def brute_sn(x):
    x = np.asarray(x)
    n = len(x)
    inner = np.median(np.abs(x[:, None] - x[None, :]), axis=1)
    return np.median(inner) * (n / (n - 0.9) if n % 2 else 1.0)


def test_sn_of_long_series(hot):
    pdf = hot.toPandas()
    want = {k: brute_sn(g.price) for k, g in pdf.groupby("product_id")}
    for rows in (10**9, 30):
        got = {r.product_id: r.sn for r in U.series_sn(hot, ["product_id"], "price", "obs_id", rows).collect()}
        assert got == pytest.approx(want)


def test_forest_properties(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{i}", "s", *map(float, rng.normal(0, 1, 3))) for i in range(400)] + [("far", "s", 12.0, -12.0, 12.0)]
    df = spark.createDataFrame(rows, "obs_id STRING, scope STRING, a DOUBLE, b DOUBLE, c DOUBLE")
    small = spark.createDataFrame([("x", "tiny", 0.0, 0.0, 0.0)], df.schema)
    for extended in (False, True):
        opts = dict(features=["a", "b", "c"], trees=30, sample=64, extended=extended)
        model = T.fit_forest(df.unionByName(small), ["scope"], **opts)
        assert model.filter("scope = 'tiny'").count() == 0
        got = T.score_forest(df, ["scope"], model, ["a", "b", "c"]).toPandas().set_index("obs_id").isolation
        assert got.idxmax() == "far" and got.between(0, 1).all()
        again = T.score_forest(df.repartition(3), ["scope"], T.fit_forest(df.repartition(5), ["scope"], **opts), ["a", "b", "c"])
        assert again.toPandas().set_index("obs_id").isolation.sort_index().tolist() == pytest.approx(got.sort_index().tolist())
    assert T.average_path(1) == 0.0 and T.average_path(256) == pytest.approx(10.2447, abs=1e-3)


def walk_sizes(node):
    if node[6] is not None:
        return 1
    n = walk_sizes(node[1]) + walk_sizes(node[2])
    assert node[5] == n and node[1][0] is node and node[2][0] is node
    return n


def test_cut_tree_keeps_its_counts():
    rng = np.random.default_rng(2)
    tree = CF.CutTree(16, "t")
    for i in range(200):
        leaf = tree.add(list(map(float, rng.integers(0, 4, 3))))
        assert walk_sizes(tree.root) == min(i + 1, 16)
        total, depth, node, level = 0.0, 0, leaf, []
        while node[0] is not None:
            up = node[0]
            level.append((up[2] if up[1] is node else up[1])[5])
            node = up
        for k, size in enumerate(reversed(level), start=1):
            total += size / k
        assert tree.displacement(leaf) == (pytest.approx(total), len(level) + 1)


def plain_cut_forest(rows, trees, size, block):
    """Every tree walks each block of the order after the window of rows before it."""
    out, scopes = {}, {}
    for r in sorted(rows, key=lambda r: (r.seen_at, r.obs_id)):
        scopes.setdefault(r.product_id, []).append(r)
    for key, own in scopes.items():
        text = json.dumps({"product_id": key}, separators=(",", ":"))
        for start in range(0, len(own), block):
            for t in range(trees):
                tree = CF.CutTree(size, f"42|{text}|{start // block}|{t}")
                for n, r in enumerate(own[max(0, start - size):start + block], max(0, start - size)):
                    leaf = tree.add([float(r.x), float(r.y)])
                    if n >= start:
                        out.setdefault((r.obs_id, n + 1), []).append(tree.displacement(leaf))
    return {k: (round(np.mean([d for d, _ in v]), 9), np.mean([d for _, d in v])) for k, v in out.items()}


def test_cut_forest_blocks_equal_walk(hot):
    df = hot.withColumn("x", F.col("price")).withColumn("y", F.col("price") * 2)
    df = df.unionByName(df.filter("product_id = 2").withColumns({"product_id": F.lit(None).cast("long"), "obs_id": F.concat(F.lit("n"), "obs_id")}))

    def run(frame, rows):
        got = CF.cut_forest_scores(frame, ["product_id"], ORDER, ident="obs_id", features=["x", "y"], trees=3, tree_size=16, block_rows=48,
                                   slice_rows=rows)
        return {(r.obs_id, r.seen): (round(r.raw_score, 9), r.depth) for r in got.collect()}

    whole = run(df, 1000)
    assert whole == plain_cut_forest(df.collect(), 3, 16, 48)
    assert whole == run(df, 20)
    # What follows a row does not change its scores.
    early = df.filter(F.col("seen_at") < T0 + dt.timedelta(hours=90))
    first = run(early, 1000)
    assert len(first) < len(whole) and all(whole[k] == v for k, v in first.items())


@pytest.mark.parametrize("prices", ["jumping", "steady", "drifting"])
def test_tracker_over_chunks(spark, prices):
    rng, rows = np.random.default_rng(17), []
    for key, n in ((1, 300), (None, 120), (3, 5)):
        for i in range(n):
            price = {"jumping": float(rng.choice([0.0, 100.0, 100.5, 101.5, 140.0])), "steady": 100.0 + i % 2 * 0.5, "drifting": 100.0 * 1.003**i}[prices]
            run = None if i % 23 == 7 else f"r{i // 3}"
            rows.append((f"{key}-{i:04d}", key, None if i % 31 == 9 else price, run, T0 + dt.timedelta(hours=i // 2)))
    df = spark.createDataFrame(rows, "obs_id STRING, product_id LONG, price DOUBLE, run STRING, seen_at TIMESTAMP").repartition(3)

    def run_with(limit):
        got = track_changes(df, ["product_id"], ORDER, "run", ["obs_id"], chunk_rows=limit)
        return sorted((tuple(r) for r in got.collect()), key=str)

    whole, state, want = run_with(10_000), {}, []
    for ident, key, price, run, seen in sorted(rows, key=lambda r: (r[4], r[0])):
        if price is not None:
            before, position = state.get(key, (None, 0))
            now = int((seen - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
            from tidemark.operators.tracker import advance

            after, flags = advance(before, price, run, now)
            state[key] = after, position + 1
            want.append((key, ident, *after[:4], *flags, position + 1))
    assert whole == sorted(want, key=str)
    assert run_with(25) == whole
