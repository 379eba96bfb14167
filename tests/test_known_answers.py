"""Known answers carried over from the fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import scales, text
from tidemark.operators import cascade as C
from tidemark.operators import classify as K
from tidemark.operators import detectors as D
from tidemark.operators import features as X
from tidemark.operators import fold as G
from tidemark.operators import history as H
from tidemark.operators import inject as I
from tidemark.operators import metrics as M
from tidemark.operators import reports as P
from tidemark.operators import rules as R
from tidemark.operators import sweeps as W
from tidemark.operators.tracker import advance
from tidemark.plans import preparation as PR
from tidemark.sources import observations as O
from tidemark.sources import scrapes as J

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)


def series(spark, rows):
    """rows of (product, price) one day apart per product."""
    seen, out = {}, []
    for i, (p, price) in enumerate(rows):
        k = seen[p] = seen.get(p, -1) + 1
        out.append((f"r{i:04d}", p, "SHOP", price, T0 + k * DAY))
    return spark.createDataFrame(out, "obs_id STRING, product_id LONG, competitor_id STRING, price DOUBLE, seen_at TIMESTAMP")


def fold(df, rule, **options):
    out = G.gated_fold(df, ["product_id"], ["seen_at", "obs_id"], rule, keep=["obs_id"], **options)
    return out.orderBy("obs_id").toPandas()


def test_split_counts(spark):
    df = series(spark, [(i, 100.0 + i + j) for i in range(10) for j in range(6)])
    got = {r["dataset_split"]: (r["n_rows"], r["n_products"]) for r in PR.split_inventory(PR.split_observations(df)).collect()}
    assert got == {"train": (32, 8), "new_prices": (16, 8), "new_products": (12, 2)}


def test_single_product_trains(spark):
    df = series(spark, [(1, 1.0)] * 5)
    got = {r["dataset_split"]: r["n_rows"] for r in PR.split_inventory(PR.split_observations(df)).collect()}
    assert got == {"train": 3, "new_prices": 2}
    with pytest.raises(ValueError):
        PR.require_products(df)


def test_minimum_history(spark):
    df = series(spark, [(1, 1.0)] * 5 + [(2, 1.0)] * 6 + [(3, 1.0)] * 8)
    assert {r.product_id for r in H.minimum_history(df, 6).collect()} == {2, 3}
    assert H.parse_levels(["mh10", 5, "5"]) == [5, 10]
    for bad in ("x", 0, "mh-1"):
        with pytest.raises(ValueError):
            H.parse_levels([bad])


@pytest.mark.parametrize("values, mad, sn", [
    ([1.0, 2.0, 3.0, 4.0, 5.0], 1.4826, 5 / 4.1),
    ([10.0, 11.0, 10.5, 10.2, 9.8, 10.1, 10.3, 50.0], 0.37065, 0.35),
    ([5.0] * 5, 0.0, 0.0),
])
def test_scales(spark, values, mad, sn):
    row = spark.createDataFrame([(values,)], "v ARRAY<DOUBLE>").select(
        scales.sd_scale(F.col("v")), scales.mad_scale(F.col("v")), scales.sn_scale(F.col("v")),
        scales.hybrid_z(F.col("v"), F.lit(7.0), "max").alias("h"),
    ).first()
    assert row[0] == pytest.approx(np.std(values))
    assert row[1] == pytest.approx(mad) and row[2] == pytest.approx(sn)
    assert (row[3] is None) == (mad == 0)
    base = R.Baseline(values)
    assert 1.4826 * base.mad() == pytest.approx(mad) and base.sn() == pytest.approx(sn)


def test_degenerate_scale_is_not_flagged(spark):
    out = fold(series(spark, [(1, 5.0)] * 3 + [(1, 9.0)]), R.modified_rule("mad"))
    assert not out.flagged.any()


def one_price(spark, kind, price, list_price, currency="CURRENCY_1"):
    df = spark.createDataFrame([("a", price, list_price, currency, "a long product name", kind)],
                               "obs_id STRING, price DOUBLE, list_price DOUBLE, currency STRING, product_name STRING, anomaly_type STRING")
    return I.apply_types(df, 7, "obs_id").first()


def test_currency_swap(spark):
    r = one_price(spark, "currency_swap", 100.0, None)
    assert (r.price, r.currency, r.change_pct) == (1000.0, "CURRENCY_5", 9.0)


def test_list_price_follows_spike_and_floor(spark):
    r = one_price(spark, "price_spike", 100.0, 120.0)
    assert r.list_price / 120.0 == pytest.approx(r.price / 100.0) and 200 <= r.price <= 500
    r = one_price(spark, "price_drop", 1.5, 30.0)
    assert r.price == 1.0 and r.list_price == pytest.approx(20.0)
    r = one_price(spark, "title_collapse", 10.0, None)
    assert r.product_name == "a lon"


def test_injection_counts(spark):
    df = series(spark, [(i % 7, 10.0 + i) for i in range(200)]).withColumn(
        "list_price", F.when(F.col("product_id") < 3, F.col("price") * 1.2)).withColumn("currency", F.lit("CURRENCY_2"))
    out = I.inject(df, rate=0.1).toPandas()
    assert out.is_injected.sum() == 20
    assert (out.injection_phase == 1).sum() == 5
    assert out[out.injection_phase == 1].list_price.notna().all()
    again = I.inject(df.repartition(5), rate=0.1).toPandas()
    assert set(out[out.is_injected].obs_id) == set(again[again.is_injected].obs_id)


def test_flagged_price_stays_out_of_baseline(spark):
    rows = [(1, p) for p in (10.0, 11.0, 12.0, 500.0, 11.5, 10.5)]
    out = fold(series(spark, rows), R.zscore_rule(3.0))
    assert out.flagged.tolist() == [False, False, False, True, False, False]
    assert out.observation_count.tolist() == [0, 1, 2, 3, 3, 4]
    assert out.rolling_mean[4] == pytest.approx(11.0)


def test_unchanged_price_only_lengthens_its_run(spark):
    out = fold(series(spark, [(1, 10.0), (1, 10.0), (1, 10.0), (1, 12.0), (1, 13.0)]), R.zscore_rule(3.0))
    assert out.observation_count.tolist() == [0, 1, 1, 1, 2]
    assert out.consecutive_unchanged.tolist() == [0, 0, 1, 2, 0]


def test_persistence_acceptance(spark):
    rows = [(1, p) for p in (10.0, 11.0, 12.0, 50.0, 50.5, 50.2)]
    out = fold(series(spark, rows), R.zscore_rule(3.0), acceptance=True)
    assert out.accepted.tolist() == [False, False, False, False, True, False]
    assert out.flagged.tolist() == [False, False, False, True, False, False]
    plain = fold(series(spark, rows), R.zscore_rule(3.0))
    assert plain.flagged.tolist() == [False, False, False, True, True, True]


def test_preloaded_state_has_no_change_time(spark):
    train = series(spark, [(1, p) for p in (10.0, 10.0, 11.0)])
    states = G.baseline_states(train, ["product_id"], ["seen_at", "obs_id"])
    test = series(spark, [(1, 10.5), (1, 10.7)]).withColumn("seen_at", F.col("seen_at") + F.expr("INTERVAL 9 DAYS"))
    out = fold(test, R.zscore_rule(3.0), states=states)
    assert out.observation_count.tolist() == [3, 4]
    assert out.days_since_change.isna().tolist() == [True, False]


@pytest.mark.parametrize("mode", ["mad", "sn", "weighted", "max", "mean"])
def test_expression_and_rule_agree(spark, mode):
    rng = np.random.default_rng(3)
    rows = [(list(map(float, rng.normal(50, 5, rng.integers(0, 31)))), float(rng.normal(50, 15))) for _ in range(60)]
    df = spark.createDataFrame(rows, "history ARRAY<DOUBLE>, price DOUBLE").withColumn("r", D.modified_zscore(mode))
    for r in df.collect():
        want = R.modified_rule(mode)(r.price, R.Baseline(r.history), {})
        assert (r.r.flagged, r.r.severity, r.r.insufficient) == (want[0], want[2], want[4])
        assert r.r.score == pytest.approx(want[1])


def test_one_vs_rest(spark):
    rows = [("s", "d", "a", True), ("s", "d", "b", True), ("s", "d", "a", False), ("s", "d", None, True), ("s", "d", None, False)]
    df = spark.createDataFrame(rows, "split STRING, detector STRING, anomaly_type STRING, predicted BOOLEAN")
    got = {r.anomaly_case: (r.tp, r.fp, r.fn, r.tn) for r in M.one_vs_rest(df, ["split", "detector"]).collect()}
    assert got == {"a": (1, 2, 1, 1), "b": (1, 2, 0, 2)}


def test_combined_scores_are_weighted(spark):
    rows = [("new_prices", 0.5, 0.6), ("new_products", 1.0, 0.2), ("combined", 0.0, 0.0)]
    df = spark.createDataFrame([("d", *r) for r in rows], "detector STRING, dataset_split STRING, f1 DOUBLE, g_mean DOUBLE")
    r = M.weighted_combined(df, ["detector"]).filter("dataset_split = 'combined'").first()
    assert r.f1 == pytest.approx(0.65) and r.g_mean == pytest.approx(0.48)


def test_promotion(spark):
    rows = [("a", 1.0, "ok"), ("b", 0.9, ""), ("c", 0.96, None), ("d", 0.2, "ok"), ("e", 2.0, "error")]
    df = spark.createDataFrame([("f", n, s, s, 0.0, st) for n, s, st in rows],
                               "family STRING, candidate_id STRING, rank_score DOUBLE, combined_f1 DOUBLE, default_distance DOUBLE, status STRING")
    assert {r.candidate_id for r in P.promoted(df, ["family"]).collect()} == {"a", "c"}
    low = df.filter("candidate_id <> 'c'")
    assert {r.candidate_id for r in P.promoted(low, ["family"]).collect()} == {"a", "b"}


def test_weighted_ensemble_leaves_short_history_out(spark):
    part = "STRUCT<flagged: BOOLEAN, score: DOUBLE, severity: STRING, types: ARRAY<STRING>, insufficient: BOOLEAN>"
    df = spark.createDataFrame([((True, 0.8, "high", ["x"], False), (False, 0.0, None, [], True))], f"a {part}, b {part}")
    r = df.select(C.weighted_ensemble({"a": 0.5, "b": 0.5}).alias("r")).first().r
    assert r.score == pytest.approx(0.8) and r.flagged and r.types == ["x"]
    rule = R.weighted_rule([(R.zscore_rule(), 0.5), (R.iqr_rule(), 0.5)])
    assert rule(90.0, R.Baseline([10.0, 11.0, 12.0]), {})[:2] == (True, 1.0)


def test_gate_stops_later_layers():
    layers = [{"rules": {"c": R.change_rule()}, "gate": True}, {"rules": {"z": R.zscore_rule()}, "min": 3}]
    base = R.Baseline([10.0, 11.0, 12.0], last_price=12.0)
    assert R.cascade_rule(layers)(90.0, base, {})[3] == "price_change"
    assert R.cascade_rule(layers, short_circuit=False)(90.0, base, {})[3] == "price_change,price_zscore"


def test_parsing(spark):
    lines = [
        '{"competitor_product_id":"1","competitor":"A_DK","scraped_at":"2024-01-01T00:00:00Z","pricing":{"price":{"currency":"EUR","current":[10,8]}}}',
        '{"competitor_product_id":"2","competitor":"A_DK","scraped_at":"2024-01-01T00:00:00Z","pricing":{"price":"x"},"api_product":{"name":"n","price":{"current":[5]}}}',
        '{"competitor_product_id":"3","competitor":"A_DK","scraped_at":"soon","pricing":{"price":3}}', "{oops", "  ", "[1]",
    ]
    parsed = J.parse_scrapes(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    good = {r.competitor_product_id: r for r in J.good_records(parsed).collect()}
    assert (good["1"].price, good["1"].list_price, good["1"].currency) == (8.0, 10.0, "EUR")
    assert (good["2"].price, good["2"].product_name, good["2"].currency) == (5.0, "n", "DKK")
    bad = sorted((r.error_type, tuple(r.missing_fields or ())) for r in J.rejects(parsed).collect())
    assert bad == [("json_decode_error", ()), ("json_decode_error", ()), ("missing_required_fields", ("scraped_at",))]


def test_title_similarity(spark):
    pairs = [("abcd", "abcd"), ("ABC ", "abc"), ("ab", "abc"), ("abcd", "bcde"), ("", "x"), (None, "x")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a STRING, b STRING").select(
        text.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 1.0, 2 / 3, 1 / 3, 0.0, 0.0])


def test_missing_score_is_zero_not_one(spark):
    r = spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(S.normalized_score(F.col("v"), 3.0)).first()
    assert r[0] is None


def test_tracker_compares_with_first_price():
    state, flags = advance(None, 100.0, "r1", 0)
    state, flags = advance(state, 100.9, "r2", 1)
    assert flags == (False, False, True)
    state, flags = advance(state, 101.2, "r3", 2)
    assert flags == (True, True, False) and state[1] == 100.0
    same, flags = advance(state, 500.0, "r3", 3)
    assert same == state and flags == (False, False, False)


def test_contract_and_names(spark):
    a = spark.createDataFrame([("x", 1)], "file_name STRING, n_rows LONG")
    O.assert_contract(a, a, ["n_rows"])
    with pytest.raises(ValueError):
        O.assert_contract(a, a.withColumn("n_rows", F.lit(2)), ["n_rows"])
    with pytest.raises(ValueError):
        X.check_feature_names(a)


def test_grids():
    assert W.candidate_id("hybrid_weighted", {"w": 0.25, "threshold": 2.0}) == "hybrid_weighted__threshold_2p000__w_0p250"
    assert W.refined_values("standard_zscore", "threshold", 2.0) == [2.0, 2.25, 2.5]
    assert len(W.coarse_grid("hybrid_weighted")) == 12
    assert W.refined_grid("hybrid_weighted", {"threshold": 2.0, "w": 0.25}) == [{"threshold": 2.0, "w": 0.25}]
    assert W.distance_to_default("iqr", {"multiplier": 2.5}) == pytest.approx(0.5)


def test_agreement(spark):
    rows = [("e", "a", 0.2), ("e", "b", 0.11), ("e", "c", -0.2), ("e", "d", 0.1), ("f", "a", 0.3)]
    df = spark.createDataFrame(rows, "ean STRING, competitor_id STRING, change_pct DOUBLE")
    got = {(r.ean, r.competitor_id): r.cross_competitor_agreement for r in K.cross_competitor_agreement(df).collect()}
    assert got[("e", "a")] == pytest.approx(1 / 3) and got[("e", "b")] == pytest.approx(2 / 3)
    assert got[("e", "c")] == 0 and got[("f", "a")] is None


def test_feature_differences():
    expected = ["price", "mean", "std"]
    assert X.feature_differences(["price", "std", "volume"], expected) == {"missing": ["mean"], "extra": ["volume"], "moved": ["std"]}
    X.check_model_features(expected, expected, "iforest")
    for names in (["price", "mean"], ["mean", "price", "std"], [*expected, "volume"], [*expected, "std"]):
        with pytest.raises(ValueError, match="iforest"):
            X.check_model_features(names, expected, "iforest")
