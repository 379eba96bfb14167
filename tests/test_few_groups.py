"""Joins with tables of a row per group, forests over rows with nested columns, counts by flag patterns."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.catalog import models
from tidemark.operators import cascade as C
from tidemark.operators import forest as T
from tidemark.operators import inject as I
from tidemark.operators import metrics as M


def test_injection_shuffles_no_rows_by_its_groups(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(400).select(
            F.col("id").cast("string").alias("obs_id"), (F.col("id") % 2).cast("string").alias("g"),
            (F.col("id") + 1.0).alias("price"), (F.col("id") + 2.0).alias("list_price"), F.lit("CURRENCY_1").alias("currency"))
        out = I.inject(df, by=["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        counts = {r.g: r.n for r in out.filter("is_injected").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert counts == {"0": 20, "1": 20}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hyperplane_paths_equal_a_walk_row_by_row():
    rng = np.random.default_rng(5)
    X = rng.lognormal(size=(300, 4))
    grown = T.grow_tree(X[:64], rng, 0.5, True)
    tree = {k: np.asarray(grown[k]) for k in ("feature", "cut", "left", "right", "path")}
    tree["normals"] = np.asarray(grown["normals"]).reshape(-1, 4)

    def walk(x):
        node = 0
        while tree["feature"][node] >= 0:
            node = tree["left" if x @ tree["normals"][node] < tree["cut"][node] else "right"][node]
        return tree["path"][node]

    assert T.tree_paths(X, tree).tolist() == [walk(x) for x in X]


def test_forest_scores_leave_other_columns_as_they_are(spark):
    rows = [(i, float(i % 7), float(i % 5), "a" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "obs_id INT, x DOUBLE, y DOUBLE, g STRING").withColumn(
        "nested", F.struct(F.array(F.lit("t"), F.lit(None).cast("string")).alias("types"), F.col("x").alias("score")))
    model = T.fit_forest(df.filter("g IS NOT NULL"), ["g"], features=["x", "y"], trees=3, sample=16).cache()
    out = {r.obs_id: r for r in T.score_forest(df, ["g"], model, ["x", "y"]).collect()}
    assert all((out[i].isolation is None) == (g is None) for i, _, _, g in rows)
    assert all(out[i].nested.types == ["t", None] and out[i].nested.score == x for i, x, _, _ in rows)


def test_combinations_counted_by_patterns_equal_their_own_counts(spark):
    def member(flag, score):
        return F.struct(flag.alias("flagged"), score.alias("score"), F.lit("high").alias("severity"),
                        F.when(flag, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("types"), F.lit(False).alias("insufficient"))

    i = F.col("id")
    df = spark.range(240).select(
        F.when(i % 10 < 3, "new_products").otherwise("new_prices").alias("dataset_split"), (i % 4 == 0).alias("truth"),
        (i % 13).alias("observation_count"), member(i % 3 == 0, (i % 7) / 7).alias("sanity"),
        member(i % 5 == 0, (i % 11) / 11).alias("zscore"), member(i % 2 == 0, (i % 9) / 9).alias("iforest"))
    pooled = M.add_combined(models._combined(df, list(C.COMBINATIONS), "dataset_split"))
    key = ("combination", "dataset_split")
    got = {(r[0], r[1]): tuple(r[2:]) for r in pooled.groupBy(*key).agg(*M.weighted_confusion("_rows")).collect()}
    for name, spec in C.COMBINATIONS.items():
        own = M.add_combined(df.withColumn("predicted", C.combination_flag(spec, ["sanity", "zscore", "iforest"])))
        for r in own.groupBy("dataset_split").agg(*M.confusion()).collect():
            assert got[name, r[0]] == tuple(r[1:]), name
