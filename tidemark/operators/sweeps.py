"""Candidate grids and staged parameter sweeps."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import metrics as M
from tidemark.operators import reports as P
from tidemark.operators import rules as R
from tidemark.operators.candidates import COUNTS, count_many
from tidemark.operators.fold import Rule
from tidemark.plans.skew import null_safe_join
from tidemark.session import persist_table

# Per family the parameters with coarse values, bounds, default, and refinement radius and step.
FAMILIES: dict[str, dict[str, dict]] = {
    "standard_zscore": {
        "threshold": {"coarse": [2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0], "bounds": (2.0, 5.0), "default": 3.0, "radius": 0.5, "step": 0.25},
    },
    "modified_mad": {
        "threshold": {"coarse": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "bounds": (1.0, 6.0), "default": 2.0, "radius": 0.5, "step": 0.25},
    },
    "modified_sn": {
        "threshold": {"coarse": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "bounds": (1.0, 6.0), "default": 2.0, "radius": 0.5, "step": 0.25},
    },
    "hybrid_weighted": {
        "threshold": {"coarse": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "bounds": (1.0, 6.0), "default": 2.0, "radius": 0.0, "step": 0.25},
        "w": {"coarse": [0.25, 0.75], "bounds": (0.0, 1.0), "default": 0.5, "radius": 0.0, "step": 0.25},
    },
    "hybrid_max": {
        "threshold": {"coarse": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "bounds": (1.0, 6.0), "default": 2.0, "radius": 0.5, "step": 0.25},
    },
    "hybrid_avg": {
        "threshold": {"coarse": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "bounds": (1.0, 6.0), "default": 2.0, "radius": 0.5, "step": 0.25},
    },
    "iqr": {
        "multiplier": {"coarse": [1.0, 1.5, 2.0, 2.5, 3.0], "bounds": (1.0, 3.0), "default": 1.5, "radius": 0.5, "step": 0.25},
    },
    "threshold": {
        "price_change_threshold": {"coarse": [0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50], "bounds": (0.10, 0.50), "default": 0.20, "radius": 0.05, "step": 0.025},
    },
}


def candidate_id(family: str, params: dict[str, float]) -> str:
    parts = [family] + [f"{k}_{params[k]:.3f}" for k in sorted(params)]
    return "__".join(parts).replace(".", "p")


def candidate_id_column(family: Column, name: Column, value: Column) -> Column:
    """The id of a one-parameter candidate from columns."""
    return F.regexp_replace(F.concat(family, F.lit("__"), name, F.lit("_"), F.format_string("%.3f", value)), r"\.", "p")


def distance_to_default(family: str, params: dict[str, float]) -> float:
    """Mean distance to the defaults, each in units of the parameter's range."""
    spec = FAMILIES[family]
    gaps = [abs(params[k] - s["default"]) / (s["bounds"][1] - s["bounds"][0]) for k, s in spec.items()]
    return sum(gaps) / len(gaps)


def coarse_grid(family: str) -> list[dict[str, float]]:
    spec = FAMILIES[family]
    return [dict(zip(spec, combo)) for combo in itertools.product(*[s["coarse"] for s in spec.values()])]


def refined_values(family: str, parameter: str, centre: float) -> list[float]:
    """The values one radius around ``centre``, in steps, that lie in the bounds; at the edge the bound itself.

    Counted in whole thousandths, the precision of candidate ids.
    """
    s = FAMILIES[family][parameter]
    middle, radius, step, low, high = (round(1000 * v) for v in (centre, s["radius"], s["step"], *s["bounds"]))
    around = range(middle - radius, middle + radius + 1, step)
    return sorted({min(max(v, low), high) / 1000 for v in around})


def refined_grid(family: str, best: dict[str, float]) -> list[dict[str, float]]:
    spec = FAMILIES[family]
    axes = [refined_values(family, k, best[k]) for k in spec]
    return [dict(zip(spec, combo)) for combo in itertools.product(*axes)]


def candidate_table(spark: SparkSession, families: Sequence[str]) -> DataFrame:
    """The coarse candidates of some families: ids, main parameter and distance to default."""
    rows = [
        (f, candidate_id(f, p), float(next(iter(p.values()))), distance_to_default(f, p))
        for f in families for p in coarse_grid(f)
    ]
    return spark.createDataFrame(rows, "family STRING, candidate_id STRING, threshold DOUBLE, default_distance DOUBLE")


def single_parameter(family: str) -> str:
    names = list(FAMILIES[family])
    if len(names) != 1:
        raise ValueError(f"{family} has several parameters")
    return names[0]


def label_candidates(df: DataFrame) -> DataFrame:
    """Candidate id and distance to default from ``family`` and ``threshold``."""
    name, default, span = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for family, spec in FAMILIES.items():
        if len(spec) != 1:
            continue
        parameter, s = next(iter(spec.items()))
        here = F.col("family") == family
        name = F.when(here, parameter).otherwise(name)
        default = F.when(here, s["default"]).otherwise(default)
        span = F.when(here, s["bounds"][1] - s["bounds"][0]).otherwise(span)
    return df.withColumns({
        "candidate_id": candidate_id_column(F.col("family"), name, F.col("threshold")),
        "default_distance": F.abs(F.col("threshold") - default) / span,
    })


def refine_range(family_scores: dict[str, tuple], step_grid: bool = True) -> dict[str, tuple]:
    """Every value a refinement could ask for: the whole range by half the coarse step."""
    out = {}
    for family, (score, _) in family_scores.items():
        s = FAMILIES[family][single_parameter(family)]
        low, high = s["bounds"]
        count = int(round((high - low) / s["step"]))
        out[family] = (score, [round(low + i * s["step"], 3) for i in range(count + 1)])
    return out


def staged_sweep(
    rows: DataFrame, scope: Sequence[str], scores: dict[str, Column | str], attempt: str = "attempt",
    first_attempt: object = None, truth: str = "truth",
) -> DataFrame:
    """Screen the coarse grid on one attempt, promote, evaluate fully, refine around the best.

    One histogram per (scope, attempt, split, family) over the finest grid
    holds the counts every stage needs, so the stages differ only in which
    candidates they look at. Returns one best candidate per scope and family.
    """
    scope = list(scope)
    coarse = {f: (s, FAMILIES[f][single_parameter(f)]["coarse"]) for f, s in scores.items()}
    fine = refine_range(coarse)
    grid = {f: (s, sorted(set(fine[f][1]) | set(coarse[f][1]))) for f, (s, _) in coarse.items()}
    by = [*scope, attempt, "dataset_split"]
    counts = M.sweep_metrics(M.sweep_histogram(rows, by, grid, truth), by, grid)
    table = label_candidates(counts)
    keys = [*scope, "family", "candidate_id", "threshold", "default_distance"]

    def averaged(part: DataFrame) -> DataFrame:
        return P.candidate_averages(part.withColumnRenamed(attempt, "attempt"), keys, M.METRICS)

    in_coarse = F.lit(False)
    for f, (_, values) in coarse.items():
        in_coarse = in_coarse | ((F.col("family") == f) & F.col("threshold").isin([float(v) for v in values]))
    screen = averaged(table.filter(in_coarse & (F.col(attempt) == first_attempt)))
    chosen = P.promoted(screen, [*scope, "family"]).select(*scope, "family", "candidate_id")
    full = averaged(table.join(chosen, [*scope, "family", "candidate_id"], "left_semi")).withColumn("stage", F.lit("coarse"))
    centre = P.best_candidate(full.drop("stage"), [*scope, "family"]).select(
        *scope, "family", F.col("threshold").alias("_centre")
    )
    radius = F.lit(0.0)
    for f in coarse:
        s = FAMILIES[f][single_parameter(f)]
        radius = F.when(F.col("family") == f, s["radius"]).otherwise(radius)
    near = table.join(centre, [*scope, "family"]).filter(
        F.abs(F.col("threshold") - F.col("_centre")) <= radius + 1e-9
    ).drop("_centre")
    refined = averaged(near).withColumn("stage", F.lit("refine"))
    fresh = refined.join(full.select(*scope, "family", "candidate_id"), [*scope, "family", "candidate_id"], "left_anti")
    return P.best_candidate(full.unionByName(fresh), [*scope, "family"])


def rule_of(family: str, params: dict[str, float]) -> Rule:
    """The fold's rule of a candidate."""
    if family == "standard_zscore":
        return R.zscore_rule(params["threshold"])
    if family == "iqr":
        return R.iqr_rule(params["multiplier"])
    if family == "threshold":
        return R.change_rule(params["price_change_threshold"])
    mode = family.removeprefix("modified_").removeprefix("hybrid_")
    return R.modified_rule(mode, params["threshold"], params.get("w", 0.5))


def refitted_sweep(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], scope: Sequence[str], *, families: Sequence[str] = tuple(FAMILIES),
    first_attempt: object, attempt: str = "attempt", truth: str = "truth", states: DataFrame | None = None,
) -> DataFrame:
    """Screen, promote, evaluate and refine candidates, each on baselines gated by its own decisions.

    Every stage is one pass over its rows for all its candidates together
    (``candidates.count_many``); candidates number what the families' grids
    allow, whatever the data. Returns every candidate evaluated: scope, family, candidate_id,
    parameters (``params``), stage ('screen', 'coarse' or 'refine'), averages, status
    and message; ``best`` marks each scope's and family's best one.
    """
    scope, keys, order = list(scope), list(keys), list(order)
    spark, by = rows.sparkSession, [*scope, attempt, "dataset_split"]
    series = list(dict.fromkeys([*keys, *scope, attempt, "dataset_split"]))

    def described(candidates: dict[str, tuple[str, dict]]) -> DataFrame:
        table = [(i, f, ",".join(f"{k}={p[k]:g}" for k in p), distance_to_default(f, p)) for i, (f, p) in candidates.items()]
        return F.broadcast(spark.createDataFrame(table, "candidate_id STRING, family STRING, params STRING, default_distance DOUBLE"))

    def averaged(part: DataFrame, candidates: dict[str, tuple[str, dict]], stage: str) -> DataFrame:
        counts = count_many(part, series, order, {i: rule_of(f, p) for i, (f, p) in candidates.items()}, by, truth=truth, states=states)
        counts = persist_table(counts, "candidate-counts")
        named = [*scope, "candidate_id"]
        metrics = M.with_rates(counts.filter("status = 'ok'").select(*by, "candidate_id", *COUNTS))
        good = P.candidate_averages(metrics.withColumnRenamed(attempt, "attempt"), named, M.METRICS)
        bad = counts.filter("status = 'error'").groupBy(*named).agg(F.min("message").alias("message"))
        keyed = counts.select(*named).distinct()
        out = _with(_with(keyed, bad, named), good, named)
        failed = F.col("message").isNotNull()
        measures = [c for c in good.columns if c not in named]
        out = out.select(*named, *[F.when(~failed, F.col(c)).alias(c) for c in measures],
                         F.when(failed, "error").otherwise("ok").alias("status"), F.coalesce("message", F.lit("")).alias("message"))
        return persist_table(out.join(described(candidates), "candidate_id").withColumn("stage", F.lit(stage)), f"sweep-{stage}")

    def chosen(df: DataFrame) -> dict[str, tuple[str, dict]]:
        return {i: candidates[i] for i in sorted(r.candidate_id for r in df.select("candidate_id").distinct().collect())}

    candidates = {candidate_id(f, p): (f, p) for f in families for p in coarse_grid(f)}
    group = [*scope, "family"]
    screen = averaged(rows.filter(F.col(attempt) == first_attempt), candidates, "screen")
    kept = persist_table(P.promoted(screen, group).select(*scope, "candidate_id"), "sweep-promoted")
    coarse = averaged(rows, chosen(kept), "coarse") if not kept.isEmpty() else screen.limit(0)
    coarse = coarse.join(kept, [*scope, "candidate_id"], "left_semi")
    centres = P.best_candidate(coarse.filter("status = 'ok'"), group).select(*scope, "candidate_id").collect()  # a row per scope and family
    wanted = []
    for r in centres:
        family, params = candidates[r.candidate_id]
        for p in refined_grid(family, params):
            candidates.setdefault(candidate_id(family, p), (family, p))
            wanted.append((*[r[c] for c in scope], candidate_id(family, p)))
    near = spark.createDataFrame(wanted, T.StructType([*[rows.schema[c] for c in scope], T.StructField("candidate_id", T.StringType())]))
    fresh = persist_table(near.distinct().join(coarse.select(*scope, "candidate_id"), [*scope, "candidate_id"], "left_anti"), "sweep-near")
    evaluated = kept.unionByName(fresh)
    parts = [screen.join(evaluated, [*scope, "candidate_id"], "left_anti"), coarse]
    if not fresh.isEmpty():
        parts.append(averaged(rows, chosen(fresh), "refine").join(fresh, [*scope, "candidate_id"], "left_semi"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = P.best_candidate(out.filter("stage != 'screen' AND status = 'ok'"), group).select(*scope, "candidate_id", F.lit(True).alias("_best"))
    return _with(out, best, [*scope, "candidate_id"]).withColumn("best", F.coalesce("_best", F.lit(False))).drop("_best")


def _with(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return null_safe_join(df, other, list(keys), "left")
