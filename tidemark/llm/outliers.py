"""Quality rules: robust multivariate outliers per language and source.

Statistic vectors are counted from whole texts, transformed to be roughly
symmetric, and judged by their Mahalanobis distance from a minimum-covariance-
determinant (MCD) estimate of their group. The estimate starts twice, from medians
and quartiles and from spatial signs about the medians, and repeats concentration
steps while the determinant falls: take the ``h`` vectors nearest to the current
centre, estimate again from these. The start with the smaller determinant is kept.
No step holds the vectors of a group; a group is a histogram of distances with
moments per bin.

Estimates are made per language and source, per language, and over all rows. Each
is shrunk towards the next wider one with the weight n / (n + n0) of its rows, at
every size, so few rows of a source lean on its language without any switch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_parameters, key_of, let, shield, text_of, words
from tidemark.session import persist_table

FEATURES = ["f_length", "f_word", "f_symbol", "f_line", "f_repeat"]
DIMS = len(FEATURES)
# Features are whole multiples of 1 / GRID, so that sums are exact and do not depend on their order.
GRID = 4096
# Spread below which differences of a feature count as noise: added to every covariance. Each of the three shares
# alone can pass the cut: half of all lines duplicate are 7.2 floors, a fifth of the words repeated 7.3.
FLOOR = [0.25, 0.05, 0.2, 0.25, 0.15]
# The 0.999 quantile of the chi-squared distribution with five degrees of freedom.
CHI2_CUT = 20.515
# Bins of a distance: BIN_STEP per unit of ln(1 + d), the last one open.
BIN_STEP, BIN_LAST = 48, 1200
# Rows at which a group's own estimate weighs as much as the wider one's.
SHRINK_ROWS = 50
# Concentration ends when the logarithm of the determinant falls by less than this.
DET_STEP = 1e-2
# Products of spatial signs are whole multiples of 1 / SIGN_GRID.
SIGN_GRID = 1 << 20
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def repeated_words(w: Column, size: int = 5) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more, all occurrences counted.

    Windows are compared by a 64-bit hash of their words. Only texts with a
    repeated hash are sorted.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            again = F.filter(
                p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(s: Column) -> Column:
            steps = F.transform(s, lambda x, k: F.when(k == 0, F.lit(size)).otherwise(F.least(F.lit(size), x - F.get(s, k - 1))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, starts), total)

    return F.when(F.size(w) < size, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the counts of each whole text."""
    text = text_of()
    line_list = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(line_list, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counted = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    return docs.select(
        *[c for c in ("doc_id", "lang", "source") if c in docs.columns],
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"), counted.alias("_counted"),
    ).select(
        "doc_id", "lang", "source", "_counted.n_words", "_counted.word_chars", "n_symbols",
        F.col("_lines.n").cast("long").alias("n_lines"), F.col("_lines.dup").cast("long").alias("n_dup_lines"),
        "_counted.n_repeat_words",
    ).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def _features() -> dict[str, Column]:
    n = F.greatest("n_words", F.lit(1))
    raw = {
        "f_length": F.log(n),
        "f_word": F.log((F.col("word_chars") + 1) / n),
        "f_symbol": F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "f_line": F.log1p(10 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "f_repeat": F.log1p(10 * F.col("n_repeat_words") / n),
    }
    return {k: F.round(v * GRID).cast("long") for k, v in raw.items()}


def _cholesky(params: DataFrame) -> DataFrame:
    """Adds ``inverse``: the lower triangle of the inverse Cholesky factor of ``cov``, by rows."""
    at = lambda i, j: F.col("cov")[i * (i + 1) // 2 + j]
    for j in range(DIMS):
        for i in range(j, DIMS):
            rest = at(i, j)
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            # The floors on the diagonal keep the pivots positive.
            params = params.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"_l{j}{j}"))
    for j in range(DIMS):
        for i in range(j, DIMS):
            value = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                value = value - F.col(f"_l{i}{k}") * F.col(f"_m{k}{j}")
            params = params.withColumn(f"_m{i}{j}", value / F.col(f"_l{i}{i}"))
    kept = F.array(*[F.col(f"_m{i}{j}") for i, j in PAIRS])
    names = [c for c in params.columns if c not in ("cov", "log_det") and not c.startswith(("_l", "_m"))]
    log_det = sum(2 * F.log(F.col(f"_l{i}{i}")) for i in range(DIMS))
    return params.select(*names, "cov", kept.alias("inverse"), log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance; products are rounded by the grid, so equal rows get equal distances."""
    x = [F.col(f) / GRID - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(DIMS):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col("inverse")[i * (i + 1) // 2 + j] * x[j]
        total = total + y * y
    return total


def _starts(vectors: DataFrame) -> DataFrame:
    """Two starts per group. Values are on a grid, so the exact percentiles need few counts."""
    coarse = [F.percentile(F.round(F.col(f) / 64), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in FEATURES]
    unit = 64.0 / GRID
    quartiles = vectors.groupBy("grp").agg(*coarse)
    variance = [F.pow((F.col(f)[2] - F.col(f)[0]) * unit / 1.349, 2) + FLOOR[i] ** 2 for i, f in enumerate(FEATURES)]
    medians = persist_table(
        quartiles.select("grp", F.array(*[F.col(f)[1] * unit for f in FEATURES]).alias("centre"), F.array(*variance).alias("variance")),
        "mcd-medians",
    )
    upright = F.array(*[F.col("variance")[i] if i == j else F.lit(0.0) for i, j in PAIRS])
    # Spatial signs: directions from the median. Their covariance has the axes of the bulk, whatever lies far out.
    z = [(F.col(f) / GRID - F.col("centre")[i]) / F.sqrt(F.col("variance")[i]) for i, f in enumerate(FEATURES)]
    norm = F.greatest(sum(x * x for x in z), F.lit(1e-12))
    placed = join_parameters(vectors, medians, "grp").select("grp", F.array(*z).alias("z"), norm.alias("norm"))
    signs = placed.groupBy("grp").agg(
        *[F.sum(F.round(F.col("z")[i] * F.col("z")[j] / F.col("norm") * SIGN_GRID).cast("decimal(20,0)")).cast("double").alias(f"u{i}{j}") for i, j in PAIRS],
        F.count(F.lit(1)).alias("n"),
    )
    spread = lambda i, j: F.col(f"u{i}{j}") / F.col("n") / SIGN_GRID * DIMS * F.sqrt(F.col("variance")[i] * F.col("variance")[j])
    tilted = F.array(*[spread(i, j) + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS])
    return medians.select("grp", F.lit(0).alias("start"), "centre", upright.alias("cov")).unionByName(
        medians.join(signs, "grp").select("grp", F.lit(1).alias("start"), "centre", tilted.alias("cov"))
    )


def _binned(vectors: DataFrame, params: DataFrame) -> DataFrame:
    placed = join_parameters(vectors, params, "grp")
    return placed.withColumn("_bin", F.least(F.floor(BIN_STEP * F.log1p(_distance())), F.lit(BIN_LAST)))


def _concentrate(vectors: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """One step: moments of the bins that hold the nearest ``share`` of each group, per start."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    moments = _binned(vectors, params).groupBy("grp", "start", "_bin").agg(
        F.count(F.lit(1)).alias("n"),
        *[exact(F.col(f)).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[exact(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in PAIRS],
    )
    along = Window.partitionBy("grp", "start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp", "start")
    near = moments.withColumn("_before", F.coalesce(F.sum("n").over(along), F.lit(0))).withColumn(
        "_all", F.sum("n").over(whole)
    ).filter(F.col("_before") < F.ceil(F.col("_all") * share))
    sums = near.groupBy("grp", "start").agg(
        F.sum("n").cast("double").alias("n"),
        *[F.sum(f"s{i}").cast("double").alias(f"s{i}") for i in range(DIMS)],
        *[F.sum(f"p{i}{j}").cast("double").alias(f"p{i}{j}") for i, j in PAIRS],
    )
    mean = [F.col(f"s{i}") / F.col("n") for i in range(DIMS)]
    cov = [
        (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) / float(GRID * GRID) + (FLOOR[i] ** 2 if i == j else 0.0)
        for i, j in PAIRS
    ]
    return _cholesky(sums.select("grp", "start", F.array(*[m / float(GRID) for m in mean]).alias("centre"), F.array(*cov).alias("cov")))


def minimum_determinant(vectors: DataFrame, share: float = 0.75, steps: int = 8) -> DataFrame:
    """``grp``, ``centre``, ``cov``, ``inverse`` and ``log_det`` of the better start per group.

    ``vectors``: ``grp`` and the features as whole multiples of 1 / GRID. A start
    ends when its determinant no longer falls, at the latest after ``steps``.
    """
    params = persist_table(_cholesky(_starts(vectors)).withColumn("_moving", F.lit(True)), "mcd-start")
    for step in range(steps):
        moving = params.filter("_moving")
        if moving.isEmpty():
            break
        new = _concentrate(vectors, moving.drop("_moving", "log_det", "cov"), share)
        fields = ("centre", "cov", "inverse", "log_det")
        both = params.join(new.select("grp", "start", F.struct(*fields).alias("_new")), ["grp", "start"], "left")
        # The starts themselves are no estimates of a subset, so the first step always counts.
        falls = F.col("_new").isNotNull() if step == 0 else F.coalesce(F.col("_new.log_det") < F.col("log_det") - DET_STEP, F.lit(False))
        params = persist_table(both.select(
            "grp", "start", *[F.when(falls, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields], falls.alias("_moving")
        ), "mcd-step")
    best = params.groupBy("grp").agg(F.min_by(F.struct("centre", "cov", "inverse", "log_det"), F.struct("log_det", "start")).alias("_best"))
    return persist_table(best.select("grp", "_best.*"), "mcd-best")


def _scaled(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """``grp``, ``n``, ``centre`` and ``cov``, the latter such that the median distance of a group is the one expected."""
    counts = _binned(vectors, params.select("grp", "centre", "inverse")).groupBy("grp", "_bin").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("grp").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = counts.withColumn("_upto", F.sum("n").over(along)).withColumn(
        "_all", F.sum("n").over(Window.partitionBy("grp"))
    ).filter(F.col("_upto") * 2 >= F.col("_all")).groupBy("grp").agg(F.min("_bin").alias("_bin"), F.max("_all").alias("n"))
    # A feature counts by the part of its variance that is not the floor; the median of such a weighted sum of squares
    # is that of a scaled chi-squared distribution with the same mean and variance.
    parts = [F.greatest(1 - FLOOR[i] ** 2 / F.col("cov")[i * (i + 3) // 2], F.lit(0.0)) for i in range(DIMS)]
    total, squares = sum(parts), sum(x * x for x in parts)
    usual = F.when(total > 0.05, total * F.pow(1 - 2 * squares / (9 * total * total), 3))
    scale = F.coalesce(F.expm1((F.col("_bin") + 0.5) / BIN_STEP) / usual, F.lit(1.0))
    return middle.join(params, "grp").select("grp", "n", "centre", F.transform("cov", lambda c: c * scale).alias("cov"))


def _mixed(own: Column, wider: Column, rows: int) -> Column:
    """``own`` shrunk towards ``wider``: centre and covariance of a mixture with ``own``'s weight n / (n + rows)."""
    w = own["n"] / (own["n"] + rows)
    apart = [own["centre"][i] - wider["centre"][i] for i in range(DIMS)]
    centre = [wider["centre"][i] + w * apart[i] for i in range(DIMS)]
    cov = [
        w * own["cov"][k] + (1 - w) * wider["cov"][k] + w * (1 - w) * apart[i] * apart[j] for k, (i, j) in enumerate(PAIRS)
    ]
    return F.struct(F.array(*centre).alias("centre"), F.array(*cov).alias("cov"))


def _levels() -> Column:
    """The groups of a row from the narrowest: language and source, language, all."""
    return F.array(key_of("lang", "source"), F.concat(F.lit("lang"), key_of("lang")), F.lit("all"))


def estimates(vectors: DataFrame, share: float, steps: int, shrink: int) -> DataFrame:
    """``grp`` (language and source), ``centre``, ``inverse``; ``vectors`` have ``levels`` and the features."""
    leveled = persist_table(vectors.select(F.explode("levels").alias("grp"), *FEATURES), "statistic-vectors")
    own = persist_table(_scaled(leveled, minimum_determinant(leveled, share, steps)), "mcd-scaled")
    groups = vectors.select("levels").distinct().select(F.col("levels")[0].alias("_pair"), F.posexplode("levels").alias("level", "grp"))
    # Three rows per group.
    chain = groups.join(own, "grp").groupBy("_pair").agg(F.sort_array(F.collect_list(F.struct("level", "n", "centre", "cov"))).alias("at"))
    at = F.col("at")
    tongue = chain.select("_pair", "at", _mixed(at[1], at[2], shrink).alias("wider"))
    final = tongue.select(F.col("_pair").alias("grp"), _mixed(at[0], F.col("wider"), shrink).alias("e")).select("grp", "e.*")
    return persist_table(_cholesky(final).select("grp", "centre", "inverse"), "mcd-estimate")


def judge(
    docs: DataFrame, share: float = 0.75, steps: int = 8, cut: float = CHI2_CUT, shrink: int = SHRINK_ROWS,
) -> DataFrame:
    """Counts, ``base_failed``, squared ``distance`` and ``kept`` per row of ``docs``.

    ``share`` of a group's vectors enter the estimate (rounded up to a whole bin
    of distances about two per cent wide). Distances are scaled, up or down, so
    that a group's median is the one expected of features that vary as much as the
    group's do; above ``cut`` a document is
    rejected. Rows that fail a base rule take no part in estimates and have no
    distance. The estimate per language and source is shrunk towards the
    language's and that towards all rows', each with weight n / (n + ``shrink``).

    Null or empty text has zero counts and fails the base rule. Null language or
    source is a value of its own. Repeated rows count as often as they occur.
    Texts are read whole; extra columns are not returned; no rows give no rows.
    """
    docs = shield(docs)
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    counted = persist_table(statistics(docs), "text-statistics")
    rows = counted.withColumns({"levels": _levels(), **_features()})
    final = estimates(rows.filter(~F.col("base_failed")).select("levels", *FEATURES), share, steps, shrink)
    scored = join_parameters(rows.withColumn("grp", F.col("levels")[0]), final, "grp", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), F.round(_distance(), 4))
    )
    return scored.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance", F.coalesce(F.col("distance") <= cut, F.lit(False)).alias("kept"),
    )
