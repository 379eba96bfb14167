"""Isolation forests, plain and extended, as tables of trees.

A forest is one row per (scope, tree). Training draws a bounded pool of rows
per scope and builds one tree per group of at most ``sample`` rows; scoring
streams rows past the trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators.features import TREE_FEATURES
from tidemark.plans.skew import HASH_BUCKETS, bucketed_row_number, hash_cut, join_small, small_table, up_to_cut
from tidemark.session import persist_table, ship_package

MINIMUM_ROWS = 10
# Broadcast at most this many bytes of trees at a time; more scopes are scored in several passes.
MODEL_BYTES = 256 * 1024 * 1024


def average_path(n: float) -> float:
    """c(n): expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


TREE_FIELDS = [
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("cut", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("path", T.ArrayType(T.DoubleType())),
    T.StructField("normals", T.ArrayType(T.DoubleType())),
    T.StructField("psi", T.IntegerType()),
]


def grow_tree(X: np.ndarray, rng: np.random.Generator, max_features: float, extended: bool) -> dict:
    """One random tree as parallel node arrays; a leaf has feature -1 and its path length.

    Plain: the cut is on one of the tree's features. Extended: on a random
    hyperplane, with all but ceil(share x d) of its components zero.
    """
    n, d = X.shape
    limit = int(math.ceil(math.log2(n))) if n > 1 else 0
    share = min(d, max(1, math.ceil(d * max_features)))
    allowed = rng.choice(d, size=share, replace=False)
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "path", "normals")}

    def add(feature: int, cut: float, path: float, normal: np.ndarray | None) -> int:
        nodes["feature"].append(feature)
        nodes["cut"].append(cut)
        nodes["left"].append(-1)
        nodes["right"].append(-1)
        nodes["path"].append(path)
        if extended:
            nodes["normals"].extend(np.zeros(d) if normal is None else normal)
        return len(nodes["feature"]) - 1

    stack = [(np.arange(n), 0, -1, "left")]
    while stack:
        rows, depth, parent, side = stack.pop()
        part = X[rows]
        done = depth >= limit or len(rows) <= 1
        if not done:
            low, high = part.min(axis=0), part.max(axis=0)
            open_features = [f for f in allowed if high[f] > low[f]]
            done = not extended and not open_features
        if done:
            here = add(-1, 0.0, depth + average_path(len(rows)), None)
        elif extended:
            normal = rng.normal(size=d)
            normal[rng.choice(d, size=d - share, replace=False)] = 0.0
            cut = float(normal @ rng.uniform(low, high))
            inside = part @ normal < cut
            here = add(0, cut, 0.0, normal)
        else:
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            inside = part[:, f] <= cut
            here = add(f, cut, 0.0, None)
        if parent >= 0:
            nodes[side][parent] = here
        if not done:
            stack.append((rows[inside], depth + 1, here, "left"))
            stack.append((rows[~inside], depth + 1, here, "right"))
    return nodes


def tree_paths(X: np.ndarray, tree: dict) -> np.ndarray:
    """Path length of every row in one tree, all rows moving down together."""
    if tree["normals"] is not None:
        return _hyperplane_paths(X, tree)
    feature, cut = tree["feature"], tree["cut"]
    node = np.zeros(len(X), dtype=np.int64)
    rows = np.arange(len(X))
    moving = feature[node] >= 0
    while moving.any():
        at, who = node[moving], rows[moving]
        inside = X[who, feature[at]] <= cut[at]
        node[moving] = np.where(inside, tree["left"][at], tree["right"][at])
        moving = feature[node] >= 0
    return tree["path"][node]


def _hyperplane_paths(X: np.ndarray, tree: dict) -> np.ndarray:
    """The same node by node: a hyperplane meets all rows of its node at once."""
    paths, stack = np.empty(len(X)), [(0, np.arange(len(X)))]
    while stack:
        node, rows = stack.pop()
        if tree["feature"][node] < 0:
            paths[rows] = tree["path"][node]
            continue
        inside = np.einsum("ij,j->i", X[rows], tree["normals"][node]) < tree["cut"][node]
        for child, part in ((tree["left"][node], rows[inside]), (tree["right"][node], rows[~inside])):
            if len(part):
                stack.append((child, part))
    return paths


# Rows that walk a whole forest together; their nodes should fit a processor's cache.
WALK_ROWS = 512


class Grove:
    """The mean path of rows in a forest. Plain trees are one table of nodes, so rows take a level of all trees in one step."""

    def __init__(self, trees: list[dict]):
        self.trees = trees
        self.norm = average_path(max(t["psi"] for t in trees)) or 1.0
        self.flat = all(t["normals"] is None for t in trees)
        if self.flat:
            sizes = [len(t["feature"]) for t in trees]
            self.roots = np.cumsum([0, *sizes[:-1]])
            at = np.repeat(self.roots, sizes)
            feature, cut, left, right, path = (np.concatenate([t[k] for t in trees]) for k in ("feature", "cut", "left", "right", "path"))
            # A leaf leads to itself, whatever the value.
            leaf, own = feature < 0, np.arange(len(feature))
            self.feature, self.cut, self.path = np.where(leaf, 0, feature).astype(np.int64), cut.astype(float), path.astype(float)
            self.child = np.stack([np.where(leaf, own, left + at), np.where(leaf, own, right + at)], axis=1).ravel().astype(np.int64)
            self.depth, here = 0, self.roots
            while not leaf[here].all():
                here, self.depth = np.unique(self.child.reshape(-1, 2)[here]), self.depth + 1

    def paths(self, X: np.ndarray) -> np.ndarray:
        if not self.flat:
            return sum(tree_paths(X, t) for t in self.trees) / len(self.trees)
        X, out = np.ascontiguousarray(X), np.empty(len(X))
        for at in range(0, len(X), WALK_ROWS):
            part = X[at : at + WALK_ROWS]
            values, first = part.ravel(), (np.arange(len(part)) * X.shape[1])[:, None]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(self.depth):
                inside = values.take(self.feature.take(node) + first) <= self.cut.take(node)
                node = self.child.take(2 * node + 1 - inside)
            # One sum in the trees' order, as adding them one by one.
            out[at : at + len(part)] = np.cumsum(self.path.take(node), axis=1)[:, -1]
        return out / len(self.trees)

    def scores(self, X: np.ndarray) -> np.ndarray:
        return np.power(2.0, -self.paths(X) / self.norm)


def fit_forest(
    df: DataFrame, by: Sequence[str], *, ident: str = "obs_id", features: Sequence[str] = tuple(TREE_FEATURES),
    trees: int = 100, sample: int = 256, max_features: float = 1.0, extended: bool = False, seed: int = 42,
) -> DataFrame:
    """Tree table of one forest per scope; scopes with too few rows are left out.

    At most trees x sample rows per scope take part: they are cut out by hash,
    ordered by hash, and tree t takes ``sample`` consecutive ones from its own
    starting point (disjoint whenever the pool is large enough).
    """
    by, features = list(by), list(features)
    ship_package(df.sparkSession)
    base = df.select(*by, ident, *features).withColumn("_u", S.hash_uniform(seed, "forest", F.col(ident)))
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MINIMUM_ROWS)
    limits = sizes.select(*by, F.least(F.col("_n"), F.lit(trees * sample)).cast("long").alias("_limit"))
    limits = small_table(limits, "forest-sizes")
    cut = small_table(hash_cut(base, by, "_u", ident, limits), "forest-cut")
    pool = join_small(base, cut, by).filter(up_to_cut("_u", ident))
    ranked = bucketed_row_number(
        pool.drop("_cut_u", "_cut_id"), by, F.floor(F.col("_u") * HASH_BUCKETS), [F.col("_u"), F.col(ident)], "_rank"
    )
    sized = join_small(ranked, limits, by)
    stride = F.greatest(F.lit(1), F.floor(F.col("_limit") / trees))
    ids = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.col("_rank") - 1 - t * stride, F.col("_limit")) < sample,
    )
    rows = sized.withColumn("tree", F.explode(ids)).select(*by, "tree", "_rank", *features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        key = [pdf[c].iloc[0] for c in [*by, "tree"]]
        text = "|".join(str(k) for k in [seed, *key])
        rng = np.random.default_rng(int(hashlib.md5(text.encode()).hexdigest()[:15], 16))
        nodes = grow_tree(pdf[features].to_numpy(dtype=float), rng, max_features, extended)
        nodes["normals"] = nodes["normals"] or None
        return pd.DataFrame([[*key, *[nodes[f.name] if f.name != "psi" else len(pdf) for f in TREE_FIELDS]]],
                            columns=[*by, "tree", *[f.name for f in TREE_FIELDS]])

    schema = T.StructType([df.schema[c] for c in by] + [T.StructField("tree", T.IntegerType())] + TREE_FIELDS)
    return rows.groupBy(*by, "tree").applyInPandas(build, schema)


def training_status(df: DataFrame, by: Sequence[str], minimum: int = MINIMUM_ROWS) -> DataFrame:
    """Rows per scope and whether a model can be trained on them."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    few = F.col("n_rows") < minimum
    return out.withColumns({
        "status": F.when(few, "error").otherwise("ok"),
        "message": F.when(few, F.concat(F.lit(f"need {minimum} rows, got "), F.col("n_rows"))).otherwise(""),
    })


def _load(rows: list, by: list[str], d: int) -> dict[tuple, list[dict]]:
    forests: dict[tuple, list[dict]] = {}
    for r in rows:
        tree = {k: np.asarray(r[k]) for k in ("feature", "cut", "left", "right", "path")}
        tree["normals"] = None if r["normals"] is None else np.asarray(r["normals"]).reshape(-1, d)
        tree["psi"] = r["psi"]
        forests.setdefault(tuple(r[c] for c in by), []).append(tree)
    return forests


def _scope_batches(model: DataFrame, by: list[str]) -> list[list[tuple]]:
    """Scopes grouped so that the trees of a group stay under MODEL_BYTES."""
    node_bytes = F.when(F.col("normals").isNull(), F.size("feature") * 28).otherwise(
        F.size("feature") * 28 + F.size("normals") * 8
    )
    sizes = model.groupBy(*by).agg(F.sum(node_bytes).alias("b")).collect()  # one row per scope
    batches, held = [[]], 0
    for r in sorted(sizes, key=lambda r: str(tuple(r))):
        if batches[-1] and held + r["b"] > MODEL_BYTES:
            batches.append([])
            held = 0
        batches[-1].append(tuple(r[c] for c in by))
        held += r["b"]
    return batches


def score_forest(
    df: DataFrame, by: Sequence[str], model: DataFrame, features: Sequence[str] = tuple(TREE_FEATURES),
    name: str = "isolation",
) -> DataFrame:
    """Add 2^(-mean path / c(psi)) of each row in its scope's forest, null without one.

    ``model`` should be a written table. Its trees are broadcast in batches of
    checked size; rows are never shuffled.
    """
    by, features = list(by), list(features)
    spark = df.sparkSession
    ship_package(spark)
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.DoubleType())])
    batches = _scope_batches(model, by)
    parts = []
    for batch in batches:
        chosen = model
        if len(batches) > 1:
            scopes = spark.createDataFrame(batch, T.StructType([df.schema[c] for c in by]))
            chosen = model.join(F.broadcast(scopes), by, "left_semi")
        shared = spark.sparkContext.broadcast(_load(chosen.collect(), by, len(features)))

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groves = {k: Grove(trees) for k, trees in shared.value.items()}
            for batch in batches:
                n = batch.num_rows
                out = np.full(n, np.nan)
                X = batch.select(features).to_pandas().to_numpy(dtype=float)
                groups = batch.select(by).to_pandas().groupby(by, sort=False).indices if by else {(): np.arange(n)}
                for key, where in groups.items():
                    grove = groves.get(key if isinstance(key, tuple) else (key,))
                    if grove:
                        out[where] = grove.scores(X[where])
                # The other columns pass as they are: nested ones would cost more than the forest.
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=np.isnan(out))], schema.names)

        part = df
        if len(batches) > 1:
            part = df.join(F.broadcast(scopes), by, "left_semi")
        parts.append(part.mapInArrow(walk, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if len(batches) > 1:
        known = model.select(*by).distinct()
        out = out.unionByName(df.join(known, by, "left_anti").withColumn(name, F.lit(None).cast("double")))
    return out


@dataclass
class FoldModel:
    """Forests of several scopes with the extremes of their training scores, for ``fold.gated_fold``.

    ``shared`` broadcasts {scope: (trees, low, high)}; rows of other scopes have no score.
    """

    by: list[str]
    shared: object
    groves: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.by, "list_price"]

    def scores(self, inputs: np.ndarray, rows: Sequence[dict]) -> list[float | None]:
        found, scopes = [None] * len(rows), {}
        for i, row in enumerate(rows):
            scopes.setdefault(tuple(row[c] for c in self.by), []).append(i)
        for scope, where in scopes.items():
            trees, low, high = self.shared.value.get(scope, ((), 0.0, 1.0))
            if trees:
                if scope not in self.groves:
                    self.groves[scope] = Grove(trees)
                raw = self.groves[scope].scores(inputs[where])
                scaled = np.clip((raw - low) / ((high - low) if high > low else 1.0), 0.0, 1.0)
                for i, value in zip(where, scaled.tolist()):
                    found[i] = value
        return found


def gated_forest(
    df: DataFrame, by: Sequence[str], model: DataFrame, limits: DataFrame, keys: Sequence[str], order: Sequence[str],
    rule: Callable, *, keep: Sequence[str], **options,
) -> DataFrame:
    """Every row scored by its scope's forest inside the gated fold, where flagged prices stay out of the baseline.

    A series lies in one scope. ``model`` and ``limits`` are written tables of
    ``fit_forest`` and ``calibrate``; trees are broadcast in batches of checked
    size, each batch folding the series of its scopes. Rows of a scope without a
    forest are judged without a model, which flags none and accepts all.
    """
    from tidemark.operators.fold import gated_fold

    by, spark = list(by), df.sparkSession
    known = {tuple(r[c] for c in by): (r["score_low"], r["score_high"]) for r in limits.collect()}  # one row per scope
    batches = _scope_batches(model, by)
    parts = []
    for batch in batches:
        chosen, rows = model, df
        if len(batches) > 1:
            scopes = F.broadcast(spark.createDataFrame(batch, T.StructType([df.schema[c] for c in by])))
            chosen, rows = model.join(scopes, by, "left_semi"), df.join(scopes, by, "left_semi")
        forests = _load(chosen.collect(), by, len(TREE_FEATURES))
        shared = spark.sparkContext.broadcast({k: (v, *known.get(k, (0.0, 1.0))) for k, v in forests.items()})
        parts.append(gated_fold(rows, keys, order, rule, keep=keep, model=FoldModel(by, shared), **options))
    if len(batches) > 1:
        rest = df.join(model.select(*by).distinct(), by, "left_anti")
        parts.append(gated_fold(rest, keys, order, rule, keep=keep, model=FoldModel(by, spark.sparkContext.broadcast({})), **options))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def calibrate(scored: DataFrame, by: Sequence[str], name: str = "isolation") -> DataFrame:
    """Extremes of the training scores per scope, for min-max normalising."""
    return scored.groupBy(*by).agg(F.min(name).alias("score_low"), F.max(name).alias("score_high"))


def normalized(raw: Column) -> Column:
    """Training min-max to 0..1, higher is more anomalous, clipped."""
    span = F.col("score_high") - F.col("score_low")
    value = (raw - F.col("score_low")) / F.when(span > 0, span).otherwise(1.0)
    return F.when(value.isNull(), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def forest_outcome(score: Column, threshold: float) -> Column:
    """Detector struct: flags from the threshold on, type by z-score, then by change."""
    from tidemark.operators.detectors import outcome

    flagged = score >= threshold
    kind = F.when(F.abs("price_zscore") > 2, "price_zscore").when(
        F.abs("price_change_pct") > 0.2, "price_change"
    ).otherwise("price_zscore")
    hit = F.coalesce(flagged, F.lit(False))
    types = F.when(hit, F.array(kind)).otherwise(F.array().cast("array<string>"))
    return outcome(flagged, score, F.when(hit, S.severity_by_score(score)), types, score.isNull())


def train_and_score(
    train: DataFrame, rows: DataFrame, by: Sequence[str], *, ident: str = "obs_id", name: str = "forest_score", **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit, calibrate on the training rows and score ``rows``: (scored rows, model, calibration)."""
    by = list(by)
    model = persist_table(fit_forest(train, by, ident=ident, **options), "forest")
    limits = small_table(calibrate(score_forest(train, by, model), by), "forest-limits")
    scored = score_forest(rows, by, model, name="_raw")
    out = join_small(scored, limits, by, "left").withColumn(name, normalized(F.col("_raw")))
    return out.drop("_raw", "score_low", "score_high"), model, limits


def model_info(model: DataFrame, limits: DataFrame, by: Sequence[str], config: dict) -> DataFrame:
    """Registry row per scope: configuration, feature names, size, offset and scale."""
    info = model.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trees"), F.max("psi").alias("sample_size"), F.sum(F.size("feature")).alias("n_nodes")
    )
    return info.join(limits, list(by)).withColumns({
        "score_offset": F.col("score_low"), "score_scale": F.col("score_high") - F.col("score_low"),
        "feature_names": F.lit(",".join(TREE_FEATURES)), "config": F.lit(str(sorted(config.items()))),
    }).drop("score_low", "score_high")
