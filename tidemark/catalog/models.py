"""Forests, cut forests, reconstruction error and model-based combinations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tidemark.catalog.base import (
    OBS, ORDER, SERIES, event_observations, observations, query, rounded, stored, with_sql,
)
from tidemark.catalog.evaluation import observation_table, scored_base
from tidemark.catalog.features import ROLL, TREE
from tidemark.catalog.scoring import fold_select, fold_sql, folded
from tidemark.operators import cascade as C
from tidemark.operators import cutforest as R
from tidemark.operators import detectors as D
from tidemark.operators import features as X
from tidemark.operators import forest as T
from tidemark.operators import metrics as M
from tidemark.operators import reconstruction as E
from tidemark.operators import rules as G
from tidemark.plans.skew import join_small, small_table
from tidemark.session import persist_table


def feature_table(spark, d):
    """Training rows, stored once with no more than every model reads."""
    def build(s, p):
        rows = observation_table(s, p).select("obs_id", *SERIES, "seen_at", "country", "price", "list_price")
        feats = X.trainable(X.tree_features(X.rolling_features(rows, SERIES, ORDER)))
        return feats.select("obs_id", "country", "competitor_id", "seen_at", *X.TREE_FEATURES)

    return stored(spark, d, "tree-features", build)


def injected_features(spark, d):
    """Inputs of the injected rows beside their truth and detector results."""
    keep = ["obs_id", "country", "competitor_id", "segment", "dataset_split", "truth", "anomaly_type",
            "observation_count", "zscore", "sanity", "iqr", "threshold"]
    return X.tree_features(scored_base(spark, d)).select(*keep, *X.TREE_FEATURES)


OPTIONS = {"trees": 50, "sample": 256, "max_features": 0.75}


def country_trees(spark, d):
    return stored(spark, d, "country-trees", lambda s, p: T.fit_forest(feature_table(s, p), ["country"], **OPTIONS))


def country_limits(spark, d):
    def build(s, p):
        return T.calibrate(T.score_forest(feature_table(s, p), ["country"], country_trees(s, p)), ["country"])

    return stored(spark, d, "country-limits", build)


# What readers of the scored forest use beside its score.
FOREST_COLUMNS = ["obs_id", "country", "competitor_id", "dataset_split", "truth", "observation_count", "zscore", "sanity",
                  "price_zscore", "price_change_pct", "forest_score"]


def country_forest(spark, d):
    """Injected rows with the score of their country's forest."""
    def build(s, p):
        raw = T.score_forest(injected_features(s, p), ["country"], country_trees(s, p), name="_raw")
        scored = join_small(raw, F.broadcast(country_limits(s, p)), ["country"], "left")
        return scored.withColumn("forest_score", T.normalized(F.col("_raw"))).select(*FOREST_COLUMNS)

    return stored(spark, d, "country-forest", build)


# A small forest given as a table, so that SQL can walk it too: inputs by their place in TREE_FEATURES, -1 is a leaf.
FIXED_TREES = [
    (0, [8, -1, 9, -1, -1], [1.537, 0.0, 0.313, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0.0, 5.0, 0.0, 3.0, 1.0], None, 8),
    (1, [10, 10, -1, -1, -1], [1.413, 0.587, 0.0, 0.0, 0.0], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [0.0, 0.0, 1.2, 1.5, 6.0], None, 8),
    (2, [8, -1, -1], [-1.537, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 1.4, 5.5], None, 8),
]
FIXED_LOW, FIXED_HIGH = 0.3, 0.9
_Z, _C, _M = ("CASE WHEN n >= 3 THEN coalesce(z, 0.0) ELSE 0.0 END", "CASE WHEN n >= 3 THEN coalesce(c, 0.0) ELSE 0.0 END",
              "CASE WHEN n < 3 THEN 0.0 WHEN m > 0 THEN p / m ELSE 1.0 END")
_PATHS = f"""(CASE WHEN {_Z} <= 1.537 THEN 5.0 WHEN {_C} <= 0.313 THEN 3.0 ELSE 1.0 END
  + CASE WHEN {_M} > 1.413 THEN 1.2 WHEN {_M} <= 0.587 THEN 1.5 ELSE 6.0 END + CASE WHEN {_Z} <= -1.537 THEN 1.4 ELSE 5.5 END)::DOUBLE"""
_FIXED = f"least(greatest((pow(2.0::DOUBLE, -({_PATHS}) / 3 / {T.average_path(8)!r}::DOUBLE) - 0.3::DOUBLE) / 0.6::DOUBLE, 0.0), 1.0)"


@query("gated_tree_table", with_sql(OBS, fold_sql(", ".join(SERIES), "obs_id", "SELECT * FROM obs", f"{_FIXED} >= 0.5", _FIXED,
    f"CASE WHEN {_FIXED} >= 0.9 THEN 'critical' WHEN {_FIXED} >= 0.8 THEN 'high' WHEN {_FIXED} >= 0.7 THEN 'medium' ELSE 'low' END"),
    body=fold_select("obs_id"), recursive=True))
def gated_tree_table(spark, d):
    """A forest given as a table, scoring inside the fold."""
    trees = spark.createDataFrame(FIXED_TREES, ST.StructType([ST.StructField("tree", ST.IntegerType()), *T.TREE_FIELDS]))
    limits = spark.createDataFrame([(FIXED_LOW, FIXED_HIGH)], "score_low DOUBLE, score_high DOUBLE")
    out = T.gated_forest(observations(spark, d), [], trees, limits, SERIES, ORDER, G.model_rule(0.5), keep=["obs_id"])
    return folded(out, "obs_id")


@query("isolation_forest_gated")
def isolation_forest_gated(spark, d):
    """Every observation under its country's forest, flagged prices kept out of the baseline of later ones."""
    out = T.gated_forest(observations(spark, d), ["country"], country_trees(spark, d), country_limits(spark, d), SERIES, ORDER,
                         G.model_rule(0.4), keep=["obs_id", "country"])
    return folded(out, "obs_id", "country")


@query("gated_cascade_default")
def gated_cascade_default(spark, d):
    """The default preset: sanity gate, three statistical detectors from 3 observations on, the forest from 5 on."""
    rows = D.evaluation_features(observations(spark, d)).withColumn("s", D.sanity()).withColumns({
        "s_flagged": F.col("s.flagged"), "s_score": F.col("s.score"), "s_severity": F.col("s.severity"),
        "s_types": F.array_join("s.types", ","),
    })
    members = {"sanity": G.row_rule("s"), "zscore": G.zscore_rule(), "iqr": G.iqr_rule(), "threshold": G.change_rule(),
               "iforest": G.model_rule(0.5)}
    rule = G.cascade_rule([
        {**item, "rules": {m: members[m] for m in item["members"]}} for item in C.PRESETS["default"]
    ])
    out = T.gated_forest(rows, ["country"], country_trees(spark, d), country_limits(spark, d), SERIES, ORDER, rule,
                         keep=["obs_id"], extra=["s_flagged", "s_score", "s_severity", "s_types"])
    return folded(out, "obs_id", "types")


def _metrics(df, score, by, cut):
    scored = df.withColumn("predicted", F.coalesce(F.col(score) >= cut, F.lit(False)))
    out = M.with_rates(scored.groupBy(*by).agg(*M.confusion()))
    return rounded(out, "precision", "recall", "f1", "g_mean").select(*by, "tp", "fp", "fn", "tn", "precision", "recall", "f1", "g_mean")


@query("isolation_forest_scores")
def isolation_forest_scores(spark, d):
    out = country_forest(spark, d)
    return rounded(out, "forest_score").select("obs_id", "country", "forest_score", (F.col("forest_score") >= 0.4).alias("flagged"))


@query("extended_forest_scores")
def extended_forest_scores(spark, d):
    train = feature_table(spark, d)
    out, _, _ = T.train_and_score(train, injected_features(spark, d), ["country"], extended=True, trees=50, sample=256, max_features=0.75)
    return rounded(out, "forest_score").select("obs_id", "country", "forest_score", (F.col("forest_score") >= 0.4).alias("flagged"))


@query("cut_forest_stream_scores")
def cut_forest_stream_scores(spark, d):
    """Streaming cut forest per event type, every point inserted before it is scored."""
    events = event_observations(spark, d).withColumn("list_price", F.lit(None).cast("double"))
    rolled = X.rolling_features(events, ["user_id"], ["seen_at", "event_id"])
    depth = rolled.select("event_id", "observation_count")
    inputs = X.tree_features(rolled)
    scores = R.cut_forest_scores(inputs, ["event_type"], ["seen_at", "event_id"], ident="event_id", trees=16)
    # Training scores are those of the first half of the stream: rows up to the middle position of their type.
    scores = persist_table(scores, "cut-forest-scores")
    halves = small_table(scores.groupBy("event_type").agg((F.max("seen") / 2).alias("_half")), "cut-forest-halves")
    limits = T.calibrate(join_small(scores, halves, ["event_type"]).filter("seen <= _half"), ["event_type"], "raw_score")
    out = R.cut_forest_flags(scores.join(depth, "event_id"), limits, ["event_type"], 0.6)
    return rounded(out, "raw_score", "stream_score", "score", "depth").select(
        "event_id", "event_type", "raw_score", "stream_score", "score", "depth", "flagged"
    )


@query("reconstruction_scores")
def reconstruction_scores(spark, d):
    """Error of each injected row against the 95th percentile of the training errors."""
    train = feature_table(spark, d)
    model = E.fit_reconstruction(train)
    cut = E.error_percentiles(E.reconstruction_errors(train, model), [95.0])
    errors = E.reconstruction_errors(injected_features(spark, d), model).join(F.broadcast(cut))
    ratio = F.col("reconstruction_error") / F.col("p95_0")
    return rounded(errors.withColumns({"ratio": ratio, "severity": E.severity_by_ratio(ratio)}), "reconstruction_error", "ratio").select(
        "obs_id", "reconstruction_error", "ratio", (F.col("ratio") > 1).alias("flagged"), "severity"
    )


@query("reconstruction_percentile_sweep")
def reconstruction_percentile_sweep(spark, d):
    """One training, thresholds at percentiles of the training errors, metrics of each."""
    train = feature_table(spark, d)
    model = E.fit_reconstruction(train)
    cuts = E.error_percentiles(E.reconstruction_errors(train, model)).first().asDict()
    errors = E.reconstruction_errors(injected_features(spark, d), model)
    out = M.threshold_sweep(errors, ["dataset_split"], "reconstruction_error", sorted(set(cuts.values())))
    names = ["threshold", "precision", "recall", "f1", "g_mean"]
    return rounded(out, *names).select("dataset_split", "tp", "fp", "fn", "tn", *names)


@query("reconstruction_recalibration")
def reconstruction_recalibration(spark, d):
    """Thresholds recalibrated on new data, per country."""
    train = feature_table(spark, d)
    model = E.fit_reconstruction(train)
    errors = E.reconstruction_errors(injected_features(spark, d).filter(~F.col("truth")), model)
    out = E.error_percentiles(errors, [90.0, 95.0, 99.0], ["country"])
    return rounded(out, "p90_0", "p95_0", "p99_0")


@query("training_status_by_run", with_sql(OBS, ROLL, TREE, """ts AS (SELECT competitor_id, strftime(seen_at, '%Y%m') AS month, count(*) AS n_rows FROM tree WHERE """
    + " OR ".join(f"abs({c}) > 1e-8" for c in X.TREE_FEATURES[4:]) + """ GROUP BY ALL)""",
    body="""SELECT competitor_id, month, n_rows, CASE WHEN n_rows < 10 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN n_rows < 10 THEN 'need 10 rows, got ' || n_rows ELSE '' END AS message FROM ts"""))
def training_status_by_run(spark, d):
    rows = feature_table(spark, d).withColumn("month", F.date_format("seen_at", "yyyyMM"))
    return T.training_status(rows, ["competitor_id", "month"])


@query("model_registry")
def model_registry(spark, d):
    train = feature_table(spark, d)
    _, model, limits = T.train_and_score(train, train, ["competitor_id"], trees=20, sample=128)
    info = T.model_info(model, limits, ["competitor_id"], {"trees": 20, "sample": 128})
    return rounded(info, "score_offset", "score_scale")


@query("forest_threshold_sweep")
def forest_threshold_sweep(spark, d):
    out = M.threshold_sweep(country_forest(spark, d), ["country", "dataset_split"], "forest_score", [0.3, 0.4, 0.5, 0.6, 0.7])
    return rounded(out, *M.METRICS).select("country", "dataset_split", "threshold", "tp", "fp", "fn", "tn", *M.METRICS)


def grid_inputs(spark, d):
    """Training and scored rows with no more columns than a grid of forests reads."""
    train = feature_table(spark, d).select("obs_id", *X.TREE_FEATURES)
    return train, injected_features(spark, d).select("dataset_split", "truth", *X.TREE_FEATURES)


@query("forest_parameter_grid")
def forest_parameter_grid(spark, d):
    """Trees x samples x features x thresholds; combined score is the plain mean of the splits."""
    from tidemark.operators.reports import combine_splits

    train, rows = grid_inputs(spark, d)
    tables = None
    for trees, sample, share in ((20, 64, 1.0), (20, 256, 0.75), (40, 256, 1.0)):
        scored, _, _ = T.train_and_score(train, rows, [], trees=trees, sample=sample, max_features=share)
        sweep = M.threshold_sweep(scored, ["dataset_split"], "forest_score", [0.4, 0.5, 0.6]).withColumn(
            "config", F.lit(f"trees={trees},sample={sample},features={share}"))
        tables = sweep if tables is None else tables.unionByName(sweep)
    out = combine_splits(tables, ["config", "threshold"], ["precision", "recall", "f1", "g_mean"], {"new_prices": 0.5, "new_products": 0.5})
    return rounded(out, "precision", "recall", "f1", "g_mean")


@query("extended_forest_two_pass")
def extended_forest_two_pass(spark, d):
    """First pass over a coarse grid, second around its best configuration."""
    train, rows = grid_inputs(spark, d)

    def run(trees: int, share: float):
        scored, _, _ = T.train_and_score(train, rows, [], trees=trees, sample=128, max_features=share, extended=True)
        return M.threshold_sweep(scored, [], "forest_score", [0.4, 0.5, 0.6]).select(
            F.lit(trees).alias("trees"), F.lit(share).alias("share"), "threshold", "f1", "g_mean")

    # Read twice, for the best one and for the result: six rows, so the forests score once.
    first = persist_table(run(10, 0.5).unionByName(run(10, 1.0)), "first-pass")
    best = first.orderBy(F.desc("g_mean"), F.desc("f1"), "share").first()
    second = run(20, float(best["share"]))
    out = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    return rounded(out, "f1", "g_mean")


@query("wider_model_on_competitor")
def wider_model_on_competitor(spark, d):
    """Each competitor's rows under its country's model."""
    return _metrics(country_forest(spark, d), "forest_score", ["competitor_id", "country"], 0.5)


@query("granularity_scenarios")
def granularity_scenarios(spark, d):
    """Segment model on its segment, on each competitor, and each competitor's own model."""
    train, rows = feature_table(spark, d), injected_features(spark, d)
    wide = country_forest(spark, d)
    own, _, _ = T.train_and_score(train, rows, ["competitor_id"], **OPTIONS)
    parts = [
        (wide, "country", "segment_on_segment"), (wide, "competitor_id", "segment_on_competitor"),
        (own, "competitor_id", "competitor_on_competitor"),
    ]
    out = None
    for df, by, name in parts:
        part = _metrics(df.withColumn("dataset", F.col(by)), "forest_score", ["dataset"], 0.5).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def with_forest(spark, d):
    return country_forest(spark, d).withColumn("iforest", T.forest_outcome(F.col("forest_score"), 0.5))


def _combined(df, names, by):
    """Confusion counts of some combinations per ``by``, from one read: rows are counted by their flags first."""
    flags = [F.coalesce(C.combination_flag(C.COMBINATIONS[n], ["sanity", "zscore", "iforest"]), F.lit(False)) for n in names]
    patterns = df.select(by, "truth", F.array(*flags).alias("_flags")).groupBy(by, "truth", "_flags").agg(F.count(F.lit(1)).alias("_rows"))
    entries = F.array(*[F.struct(F.lit(n).alias("combination"), F.get("_flags", F.lit(i)).alias("predicted")) for i, n in enumerate(names)])
    return patterns.withColumn("_e", F.explode(entries)).select(by, "truth", "_rows", "_e.*")


@query("named_combinations")
def named_combinations(spark, d):
    """The nine named combinations, pooled metrics with weighted F1 and G on the combined rows."""
    parts = _combined(with_forest(spark, d), list(C.COMBINATIONS), "dataset_split")
    metrics = M.with_rates(M.add_combined(parts).groupBy("combination", "dataset_split").agg(*M.weighted_confusion("_rows")))
    out = M.weighted_combined(metrics, ["combination"])
    return rounded(out, "precision", "recall", "f1", "g_mean").select("combination", "dataset_split", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "g_mean")


@query("finalists_by_country")
def finalists_by_country(spark, d):
    parts = _combined(with_forest(spark, d), C.FINALISTS, "country")
    out = M.with_rates(parts.groupBy("combination", "country").agg(*M.weighted_confusion("_rows")))
    return rounded(out, "precision", "recall", "f1", "g_mean").select("combination", "country", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "g_mean")


@query("cascade_production")
def cascade_production(spark, d):
    """Sanity gate, isolation forest, then z-score from three observations on."""
    result = C.cascade(C.PRESETS["production"], ["sanity", "zscore", "iforest"])
    out = with_forest(spark, d).withColumn("r", result).select("obs_id", "r.*")
    return rounded(out, "score", "confidence").withColumn("types", F.array_join("types", ","))
