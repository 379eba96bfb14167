"""Layered cascades, weighted ensembles and their analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.metrics import guarded

COLD, WARM = 3, 5


def layer(name: str, members: Sequence[str], gate: bool = False, least: int = 0, most: int | None = None) -> dict:
    return {"name": name, "members": list(members), "gate": gate, "min": least, "max": most}


# Presets name detector struct columns.
PRESETS: dict[str, list[dict]] = {
    "production": [
        layer("sanity", ["sanity"], gate=True), layer("iforest", ["iforest"]), layer("zscore", ["zscore"], least=COLD),
    ],
    "default": [
        layer("sanity", ["sanity"], gate=True), layer("statistical", ["zscore", "iqr", "threshold"], least=COLD),
        layer("ml", ["iforest"], least=WARM),
    ],
    "statistical_only": [
        layer("sanity", ["sanity"], gate=True), layer("statistical", ["zscore", "iqr", "threshold"], least=COLD),
    ],
    "minimal": [layer("sanity", ["sanity"], gate=True), layer("zscore", ["zscore"], least=COLD)],
}

# The nine named combinations; scores of members are averaged where weights are given.
COMBINATIONS: dict[str, dict] = {
    "IF": {"layers": [layer("if", ["iforest"])]},
    "Z": {"layers": [layer("z", ["zscore"])]},
    "Sanity": {"layers": [layer("sanity", ["sanity"])]},
    "Sanity -> IF": {"layers": [layer("sanity", ["sanity"], gate=True), layer("if", ["iforest"])]},
    "Sanity -> Z": {"layers": [layer("sanity", ["sanity"], gate=True), layer("z", ["zscore"])]},
    "IF + Z 50/50": {"weights": {"iforest": 0.5, "zscore": 0.5}},
    "Sanity -> IF + Z": {"gate": "sanity", "weights": {"iforest": 0.5, "zscore": 0.5}},
    "Sanity -> Z(>=5) -> IF": {"layers": [
        layer("sanity", ["sanity"], gate=True), layer("z", ["zscore"], least=5), layer("if", ["iforest"])]},
    "Sanity -> Z(>=10) -> IF": {"layers": [
        layer("sanity", ["sanity"], gate=True), layer("z", ["zscore"], least=10), layer("if", ["iforest"])]},
}
FINALISTS = ["Sanity -> Z", "Sanity -> IF", "Sanity -> Z(>=10) -> IF", "Sanity -> Z(>=5) -> IF"]


def route(n: Column) -> Column:
    return F.when(n < COLD, "cold_start").when(n < WARM, "limited").otherwise("full")


def cascade(layers: Sequence[dict], available: Sequence[str], n: str = "observation_count",
            short_circuit: bool = True) -> Column:
    """Result struct of a cascade over detector struct columns in ``available``.

    A layer runs when the history fits and no gate before it fired; members
    that are not available are left out.
    """
    stopped = F.lit(False)
    ran: list[tuple[str, Column]] = []
    for item in layers:
        fits = F.col(n) >= item["min"]
        if item["max"] is not None:
            fits = fits & (F.col(n) <= item["max"])
        live = fits & ~stopped
        members = [m for m in item["members"] if m in available]
        ran += [(m, live) for m in members]
        if item["gate"] and short_circuit and members:
            fired = F.lit(False)
            for m in members:
                fired = fired | F.col(f"{m}.flagged")
            stopped = stopped | (live & fired)
    no_types = F.array().cast("array<string>")
    types = F.array_sort(F.array_distinct(F.flatten(F.array(
        *[F.when(live, F.col(f"{m}.types")).otherwise(no_types) for m, live in ran]
    ))))
    votes = sum((live.cast("int") for _, live in ran), F.lit(0))
    flagged = sum(((live & F.col(f"{m}.flagged")).cast("int") for m, live in ran), F.lit(0))
    scores = [F.when(live, F.col(f"{m}.score")).otherwise(0.0) for m, live in ran]
    severities = [F.when(live, F.col(f"{m}.severity")) for m, live in ran]
    return F.struct(
        (F.size(types) > 0).alias("flagged"),
        (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("score"),
        S.top_severity(*severities).alias("severity"),
        types.alias("types"),
        votes.cast("long").alias("votes"),
        F.when(votes > 0, flagged / votes).otherwise(0.0).alias("confidence"),
        route(F.col(n)).alias("route"),
        stopped.alias("short_circuited"),
    )


def weighted_ensemble(weights: dict[str, float], decide_at: float = 0.5) -> Column:
    """Weighted mean of scores over members with enough history and a positive weight."""
    used = {m: w for m, w in weights.items() if w > 0}
    live = {m: ~F.col(f"{m}.insufficient") for m in used}
    total = sum((F.when(live[m], F.lit(w)).otherwise(0.0) for m, w in used.items()), F.lit(0.0))
    points = sum((F.when(live[m], F.col(f"{m}.score") * w).otherwise(0.0) for m, w in used.items()), F.lit(0.0))
    score = F.when(total > 0, points / total).otherwise(0.0)
    flagged = (total > 0) & (score >= decide_at)
    types = F.array_sort(F.array_distinct(F.flatten(F.array(*[
        F.when(flagged & live[m], F.col(f"{m}.types")).otherwise(F.array().cast("array<string>")) for m in used
    ]))))
    return F.struct(
        flagged.alias("flagged"), score.alias("score"),
        F.when(flagged, S.severity_by_score(score, low_from=0.5)).alias("severity"), types.alias("types"),
    )


def combination_flag(spec: dict, available: Sequence[str]) -> Column:
    """Whether a named combination flags a row.

    A gate before a weighted ensemble has no weight of its own: where it fires, the
    other members do not run, no score is left to average, and the row is not flagged.
    """
    if "weights" not in spec:
        return cascade(spec["layers"], available).getField("flagged")
    flagged = weighted_ensemble(spec["weights"]).getField("flagged")
    if "gate" in spec:
        flagged = flagged & ~F.coalesce(F.col(f"{spec['gate']}.flagged"), F.lit(False))
    return flagged


def votes_confidence(votes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of detectors that flagged, and each detector's score.

    Votes are first reduced to one per detector, which bounds the score map.
    """
    one = votes.groupBy(*by, "detector").agg(
        F.max("flagged").alias("flagged"), F.max("score").alias("score")
    )
    entries = F.array_sort(F.collect_list(F.struct("detector", "score")))
    return one.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_detectors"),
        F.count_if("flagged").alias("flagged_count"),
        F.avg(F.col("flagged").cast("int")).alias("confidence"),
        F.map_from_entries(entries).alias("scores"),
    )


def weighted_confidence(votes: DataFrame, by: Sequence[str], weights: dict[str, float]) -> DataFrame:
    weight = F.coalesce(F.try_element_at(S.literal_map(weights), F.col("detector")), F.lit(1.0))
    return votes.groupBy(*by).agg(
        guarded(F.sum(F.when(F.col("flagged"), weight).otherwise(0.0)), F.sum(weight)).alias("weighted_confidence")
    )


def flag_patterns(df: DataFrame, detectors: Sequence[str], truth: str = "truth", by: Sequence[str] = ()) -> DataFrame:
    """Row counts per combination of detector flags and truth: at most 2^(k+1) rows per group.

    Every analysis of orders and overlaps below works on this table.
    """
    flags = [F.col(f"{n}.flagged").alias(n) for n in detectors]
    return df.select(*by, *flags, F.col(truth).alias("truth")).groupBy(*by, *detectors, "truth").agg(
        F.count(F.lit(1)).alias("n")
    )


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def overlap(patterns: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Jaccard of true positives, and what the second catches of the first's misses, per ordered pair."""
    names = F.array(*[F.lit(n) for n in detectors])
    pairs = patterns.withColumn("first", F.explode(names)).withColumn("second", F.explode(names))

    def flag(which: str) -> Column:
        value = F.lit(False)
        for n in detectors:
            value = F.when(F.col(which) == n, F.col(n)).otherwise(value)
        return value

    a, b, t = flag("first"), flag("second"), F.col("truth")
    out = pairs.groupBy("first", "second").agg(
        _count(a & b & t).alias("both"), _count((a | b) & t).alias("either"),
        _count(~a & t).alias("missed"), _count(~a & b & t).alias("caught"),
    )
    return out.withColumns({
        "jaccard": guarded(F.col("both"), F.col("either")),
        "catch_rate": F.when(F.col("missed") > 0, F.col("caught") / F.col("missed")),
    })


def order_analysis(patterns: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per position: new catches, cumulative recall and F1, marginal F1, share caught again later."""
    aggs = []
    t = F.col("truth")
    for i, name in enumerate(order):
        before, later = F.lit(False), F.lit(False)
        for m in order[:i]:
            before = before | F.col(m)
        for m in order[i + 1:]:
            later = later | F.col(m)
        so_far = before | F.col(name)
        aggs.append(F.struct(
            F.lit(i + 1).alias("position"), F.lit(name).alias("detector"),
            _count(F.col(name) & t & ~before).alias("unique_catches"),
            _count(F.col(name)).alias("flags"), _count(F.col(name) & later).alias("again"),
            _count(so_far & t).alias("tp"), _count(so_far & ~t).alias("fp"), _count(t).alias("positives"),
        ))
    rows = patterns.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    f1 = guarded(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))
    rows = rows.withColumns({
        "cumulative_recall": guarded(F.col("tp"), F.col("positives")),
        "cumulative_f1": f1,
        "unique_catch_rate": guarded(F.col("unique_catches"), F.col("positives")),
        "short_circuit_rate": guarded(F.col("again"), F.col("flags")),
    })
    from pyspark.sql import Window

    w = Window.orderBy("position")  # one row per detector
    return rows.withColumn(
        "marginal_f1", F.col("cumulative_f1") - F.coalesce(F.lag("cumulative_f1").over(w), F.lit(0.0))
    ).select("position", "detector", "unique_catches", "unique_catch_rate", "cumulative_recall",
             "cumulative_f1", "marginal_f1", "short_circuit_rate")


def _pattern_rows(patterns: DataFrame, detectors: Sequence[str]) -> list[tuple[frozenset, bool, int]]:
    """The pattern table on the driver: at most 2^(k+1) rows whatever the data."""
    rows = patterns.groupBy(*detectors, "truth").agg(F.sum("n").alias("n")).collect()
    return [(frozenset(d for d in detectors if r[d]), bool(r["truth"]), int(r["n"])) for r in rows]


def greedy_by_f1(spark: SparkSession, patterns: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Add the detector with the largest F1 gain until none helps; below .001 the rest follow by name."""
    rows = _pattern_rows(patterns, detectors)
    positives = sum(n for _, t, n in rows if t)

    def f1(chosen: set) -> float:
        tp = sum(n for s, t, n in rows if t and s & chosen)
        fp = sum(n for s, t, n in rows if not t and s & chosen)
        return 2 * tp / (tp + fp + positives) if tp else 0.0

    chosen, left, out, held = set(), sorted(detectors), [], 0.0
    while left:
        name = max(left, key=lambda x: (f1(chosen | {x}), [-ord(c) for c in x]))
        score = f1(chosen | {name})
        if score <= held:
            break
        gain = score - held
        for step in [name] + (sorted(set(left) - {name}) if gain < 0.001 else []):
            chosen.add(step)
            now = f1(chosen)
            out.append((len(out) + 1, step, now, now - held))
            held = now
            left.remove(step)
    return spark.createDataFrame(out, "position INT, detector STRING, cumulative_f1 DOUBLE, marginal_gain DOUBLE")


def greedy_by_catches(spark: SparkSession, patterns: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Order by most new catches among true anomalies, until nothing new is caught."""
    rows = [(s, n) for s, t, n in _pattern_rows(patterns, detectors) if t]
    total = sum(n for _, n in rows)
    chosen, left, out, caught = set(), sorted(detectors), [], 0
    while left:
        new = {x: sum(n for s, n in rows if x in s and not s & chosen) for x in left}
        name = max(left, key=lambda x: (new[x], [-ord(c) for c in x]))
        if new[name] == 0:
            break
        chosen.add(name)
        left.remove(name)
        caught += new[name]
        out.append((len(out) + 1, name, new[name], caught / total))
    return spark.createDataFrame(out, "position INT, detector STRING, new_catches LONG, cumulative_recall DOUBLE")


def history_bucket(n: Column) -> Column:
    return (
        F.when(n < 3, "0-3").when(n < 5, "3-5").when(n < 10, "5-10").when(n < 30, "10-30").otherwise("30-+")
    )


def anomaly_matrix(df: DataFrame, keep: Sequence[str], detectors: Sequence[str]) -> DataFrame:
    """One row per injected row with a flag per detector, any, all and the count."""
    flags = {n: F.col(f"{n}.flagged") for n in detectors}
    count = sum((f.cast("int") for f in flags.values()), F.lit(0))
    rows = df.filter(F.col("truth"))
    return rows.select(
        *keep, *[f.alias(n) for n, f in flags.items()], count.alias("n_detectors"),
        (count > 0).alias("any_detector"), (count == len(flags)).alias("all_detectors"),
    )
