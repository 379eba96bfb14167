"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; the model of a category sees the
words of the text and the probabilities of the categories before it. For
training these come from models that did not see the document (out of fold), so
that a later model meets inputs as uncertain as it will meet in use.

Features are presence of a word or of a word's beginning (some languages build
such words by ending). The vocabulary is chosen by a likelihood-ratio test on a
bounded sample of labelled documents; everything else reads all texts whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shield, text_of
from tidemark.session import persist_table

# Labelled documents used for fitting: the bound of the sample, chosen by a hash of the id.
SAMPLE_ROWS = 8_000
# Features of the models, by rank of the test over all categories.
VOCABULARY = 768
# Beginnings of words that are features; a feature must occur in so many sampled documents.
PREFIXES, MIN_DOCUMENTS = (4, 5, 6), 4
FOLDS, PENALTY, SEED = 3, 0.3, "toxicity-1"
# Cuts let at most this share of the clean documents through as false alarms, out of fold; they stay in these limits.
FALSE_ALARMS, CUT_RANGE = 0.002, (0.15, 0.5)
_EDGE = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class Chain:
    """``features`` by name; per category its name, weights (bias, features, earlier categories) and cut."""

    features: tuple[str, ...]
    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    cuts: tuple[float, ...]

    def predict(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n x categories) of documents given as (row, feature) pairs."""
        out = np.zeros((n, len(self.categories)))
        for k, w in enumerate(self.weights):
            words = np.bincount(rows, weights=w[1 : 1 + len(self.features)][columns], minlength=n)
            out[:, k] = _logistic(w[0] + words + out[:, :k] @ w[1 + len(self.features) :])
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def features_of(word: str) -> list[str]:
    """The word without marks at its ends in lower case ('=word') and its beginnings ('word-')."""
    bare = _EDGE.sub("", word).lower()
    if not bare:
        return []
    return ["=" + bare, *[bare[:n] + "-" for n in PREFIXES if len(bare) > n]]


def _pairs(texts: pa.Array, known: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct (text, feature) pairs of a batch; features are numbers in ``known`` or in the list returned."""
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    names: dict[str, int] = {} if known is None else known
    of_word: list[list[int]] = []
    for w in flat.dictionary.to_pylist():
        if known is None:
            of_word.append([names.setdefault(f, len(names)) for f in features_of(w)])
        else:
            of_word.append([names[f] for f in features_of(w) if f in names])
    size = np.array([len(x) for x in of_word], np.int64)
    values = np.array([v for x in of_word for v in x], np.int64)
    begin = np.cumsum(size) - size
    word = flat.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    count = size[word] if len(word) else np.zeros(0, np.int64)
    held = count > 0
    word, text, count = word[held], text[held], count[held]
    upto = np.cumsum(count)
    spots = np.repeat(begin[word] - (upto - count), count) + np.arange(int(count.sum()))
    width = max(len(names), 1)
    unique = np.unique(np.repeat(text, count) * width + values[spots]) if len(spots) else np.zeros(0, np.int64)
    return unique // width, unique % width, list(names)


def _counted(categories: int):
    """Documents per feature, in all and per category, of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns, names = _pairs(batch.column("text"))
            n = len(names)
            counts = [np.bincount(columns, minlength=n)]
            for k in range(categories):
                label = np.asarray(batch.column(f"y{k}").to_pylist(), float)
                counts.append(np.bincount(columns, weights=label[rows], minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], ["feature", "n", *[f"n{k}" for k in range(categories)]]
            )

    return run


def _gain(n: str, hit: str, total: int, positive: int):
    """Likelihood ratio of a feature and a category (twice the gain in nats)."""
    out = F.lit(0.0)
    a, b = F.col(hit).cast("double"), (F.col(n) - F.col(hit)).cast("double")
    c, d = positive - a, (total - positive) - b
    for seen, row, column in ((a, a + b, positive), (b, a + b, total - positive), (c, c + d, positive), (d, c + d, total - positive)):
        out = out + F.when(seen > 0, 2 * seen * F.log(seen * total / (row * column))).otherwise(0.0)
    return out


def _fit_one(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the first column is the bias, which is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = _logistic(x @ w)
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, features: Sequence[str], categories: Sequence[str]) -> Chain:
    """``x``: documents x features; ``labels``: documents x categories, in chain order."""
    earlier = np.zeros((len(x), 0))
    weights, cuts = [], []
    for k in range(len(categories)):
        full = np.hstack([np.ones((len(x), 1)), x, earlier])
        weights.append(_fit_one(full, labels[:, k]))
        unseen = np.zeros(len(x))
        for f in range(FOLDS):
            held = folds == f
            if held.any():
                part = _fit_one(full[~held], labels[~held, k]) if (~held).any() else np.zeros(full.shape[1])
                unseen[held] = _logistic(full[held] @ part)
        earlier = np.hstack([earlier, unseen[:, None]])
        clean = unseen[labels[:, k] == 0]
        cuts.append(float(np.clip(np.quantile(clean, 1 - FALSE_ALARMS) if len(clean) else CUT_RANGE[1], *CUT_RANGE)))
    return Chain(tuple(features), tuple(categories), tuple(weights), tuple(cuts))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, object], sample: int = SAMPLE_ROWS) -> Chain | None:
    """Fit a chain on at most ``sample`` labelled documents; None if there are none.

    ``categories`` maps names to boolean columns of ``labels``, in chain order. A
    document labelled twice has a category if one of its labels says so.
    """
    names = list(categories)
    flagged = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max(F.coalesce(categories[c], F.lit(False)).cast("int")).alias(f"y{k}") for k, c in enumerate(names)]
    )
    # The sample is bounded by its parameter, so it may be broadcast.
    drawn = flagged.withColumn("_u", F.sha2(F.concat_ws("|", F.lit(SEED), "doc_id"), 256)).orderBy("_u").limit(sample)
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", text_of().alias("text"))
    rows = persist_table(texts.join(F.broadcast(drawn), "doc_id"), "labelled-sample")
    totals = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"y{k}"), F.lit(0)) for k in range(len(names))]).first()
    if not totals[0]:
        return None
    schema = "feature string, n long, " + ", ".join(f"n{k} long" for k in range(len(names)))
    ys = [f"y{k}" for k in range(len(names))]
    counts = rows.select("text", *ys).mapInArrow(_counted(len(names)), schema).groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))]
    ).filter(F.col("n") >= MIN_DOCUMENTS)
    gains = [_gain("n", f"n{k}", totals[0], totals[k + 1]) for k in range(len(names)) if 0 < totals[k + 1] < totals[0]]
    chosen = [r[0] for r in counts.select("feature", (F.greatest(*gains) if len(gains) > 1 else [*gains, F.lit(0.0)][0]).alias("g"))
              .orderBy(F.col("g").desc(), "feature").limit(VOCABULARY).collect()]
    known = {f: i for i, f in enumerate(chosen)}

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column, _ = _pairs(batch.column("text"), known)
            found = np.split(column, np.searchsorted(at, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_u", *ys)], pa.array(found if batch.num_rows else [], pa.list_(pa.int64()))], ["_u", *ys, "f"]
            )

    # At most ``sample`` rows of at most VOCABULARY numbers.
    got = rows.select("_u", "text", *ys).mapInArrow(lists, "_u string, " + ", ".join(f"{y} int" for y in ys) + ", f array<bigint>").toPandas()
    got = got.sort_values(["_u", *ys], kind="stable")
    x = np.zeros((len(got), len(chosen)))
    for i, f in enumerate(got["f"]):
        x[i, np.asarray(f, int)] = 1.0
    folds = np.array([int(u[-6:], 16) % FOLDS for u in got["_u"]])
    return fit_chain(x, got[ys].to_numpy(float), folds, chosen, names)


def score(docs: DataFrame, chain: Chain | None, batch_rows: int = 1_000) -> DataFrame:
    """``docs`` without text plus a probability per category (``p_<name>``); 0 without a model.

    Null text is empty and takes the models' bias. Repeated rows give repeated
    results; no rows give no rows; texts are read whole.
    """
    names = list(chain.categories) if chain else []
    rows = docs.withColumn("_text", text_of())
    kept = [c for c in docs.columns if c not in {f"p_{n}" for n in names}]
    known = {f: i for i, f in enumerate(chain.features)} if chain else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                row, column, _ = _pairs(part.column("_text"), known)
                p = np.round(chain.predict(row, column, part.num_rows), 9)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], *[pa.array(p[:, k]) for k in range(len(names))]], [*kept, *[f"p_{n}" for n in names]]
                )

    if not names:
        return docs
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "_text").mapInArrow(run, schema + ", " + ", ".join(f"p_{n} double" for n in names))


def standard_categories() -> dict[str, object]:
    """Chain order: poor quality first, then toxic, then toxic text that is otherwise well formed."""
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    return {"poor": poor, "toxic": toxic, "toxic_prose": toxic & ~poor}


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` with a probability per category and ``rejected``: p_toxic at ``threshold`` (the chain's cut) or above.

    Without labelled rows nothing is rejected. Columns of ``docs`` stay (``text``
    only with ``keep_text``); those named as added ones are replaced.
    """
    categories = standard_categories()
    chain = train(shield(docs), shield(labels, ("doc_id", "quality", "toxic")), categories)
    added = [f"p_{c}" for c in categories] + ["rejected"]
    rows = shield(docs.drop(*added))
    names = docs.drop(*added).columns
    if chain is None:
        scored = rows.withColumns({f"p_{c}": F.lit(0.0) for c in categories})
    else:
        scored = score(rows, chain)
    if threshold is None:
        threshold = chain.cuts[chain.categories.index("toxic")] if chain else CUT_RANGE[1]
    scored = scored.withColumn("rejected", F.col("p_toxic") >= threshold).toDF(*names, *added)
    return scored if keep_text else scored.drop("text")
