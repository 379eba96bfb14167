"""Whitening, spelling variants and neighbour search beside plain implementations, and their edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import crosspolytope, variants, whitening

ROWS = "vec_id LONG, embedding ARRAY<FLOAT>"


def made_vectors(n=700, d=10, seed=3):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, d)) * np.linspace(2, 0.4, d)).astype(np.float32)
    v[n // 2 : n // 2 + 60] = v[5]  # one vector, many times
    v[-40:] = v[7] + rng.normal(size=(40, d)).astype(np.float32) * 0.01
    return v


def plain_whitening(x, k=4):
    distinct = np.unique(x, axis=0)
    mean = distinct.mean(axis=0)
    centred = distinct - mean
    values, axes = np.linalg.eigh(centred.T @ centred / len(distinct))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return len(distinct), distinct.sum(axis=0), values, (x - mean) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / len(distinct))


@pytest.mark.parametrize("d", [3, 10, 40])
def test_whitening_equals_eigendecomposition(spark, d):
    v = made_vectors(d=d)
    got = whitening.whiten(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], ROWS).repartition(3)).toPandas()
    x = np.floor(256 * v.astype(float))
    n, sums, _, white, explained = plain_whitening(x, min(4, d))
    assert len(got) == len(v) * min(4, d) and set(got.n) == {n}
    assert got.identity_error.max() < 1e-9
    for j, part in got.groupby("component"):
        mine = part.set_index("vec_id").whitened.loc[range(len(v))].to_numpy()
        assert np.allclose(mine * np.sign(mine @ white[:, j - 1]), white[:, j - 1], atol=1e-7)
        assert np.allclose(part.explained, explained[j - 1], rtol=1e-9)
    want = ((n * x.astype(int).astype(object) - sums.astype(int).astype(object)) ** 2).sum(axis=1)
    assert got[got.component == 1].set_index("vec_id").deviation.loc[range(len(v))].tolist() == want.tolist()


def test_leading_pairs_in_hard_spectra():
    rng = np.random.default_rng(5)
    for values in (np.r_[1e6, 5.0, 3.0, 2.9, np.linspace(2.8, 1.0, 60)], np.linspace(1.0, 0.9, 80), np.r_[4.0, 3.0, np.zeros(50)]):
        axes, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
        v = (axes * values) @ axes.T
        found, _ = whitening.leading(lambda q: v @ q, len(values), 4)
        assert np.allclose(found, np.sort(values)[::-1][:4], rtol=1e-9, atol=1e-9 * values[0])


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [1.5, 0.25]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [1.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], ROWS + ", n INT, component INT")
    got = whitening.whiten(frame).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(None, 1), (None, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert all(r.n == 2 for r in got) and all(r.whitened is None and r.explained == 0.0 for r in got if r.component == 2)
    assert all(abs(abs(r.whitened) - 1) < 1e-9 for r in got if r.component == 1)
    alike = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, ROWS)).collect()
    assert len(alike) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in alike} == {(0, None, None, None)}
    assert whitening.whiten(frame.filter("vec_id > 1")).filter("vec_id < 7").count() == 0
    assert whitening.whiten(frame.limit(0)).count() == 0
    far = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])], ROWS)).collect()
    assert {r.deviation for r in far if r.vec_id != 3} == {None} and len(far) == 6


def plain_neighbours(rows, k, divisor):
    kept = [(i, np.array(v, float)) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % divisor == 0:
            scores = [(-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j is None, j or 0) for b, (j, v) in enumerate(kept) if b != a]
            out += [(i, r + 1, None if none else j, round(-s, 6)) for r, (s, none, j) in enumerate(sorted((round(s, 12), n, j) for s, n, j in scores)[:k])]
    return sorted(out, key=str)


def test_search_equals_all_cosines_where_probes_suffice(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK_ROWS", 16)
    monkeypatch.setattr(crosspolytope, "QUERY_ROWS", 4)
    v = made_vectors(d=6)
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(50, v[50].tolist()), (100, v[3].tolist()), (None, v[5].tolist())]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    from pyspark.sql import functions as F

    got = crosspolytope.nearest(frame, F.col("vec_id") % 50 == 0, recall=1.0).collect()
    assert sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got), key=str) == plain_neighbours(rows, 5, 50)


@pytest.mark.parametrize("hashes", [1, 2])
def test_search_recall(spark, monkeypatch, hashes):
    from pyspark.sql import functions as F

    if hashes == 2:
        monkeypatch.setattr(crosspolytope, "BUCKET_ROWS", 2)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 16)) + rng.normal(size=(3000, 1)) * 0.2
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = {(r.query_id, r.vec_id) for r in crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0).collect()}
    w = v / np.linalg.norm(v, axis=1)[:, None]
    scores = w[::20] @ w.T
    scores[np.arange(150), np.arange(0, 3000, 20)] = -2
    true = {(20 * i, int(j)) for i, row in enumerate(np.argsort(-scores, axis=1)[:, :5]) for j in row}
    assert len(got) == len(true) and len(got & true) >= 0.93 * len(true)


def test_search_edges(spark):
    from pyspark.sql import functions as F

    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 2.0]), (7, [0.0, 0.0]), (8, None), (9, []), (100, [nan, 1.0]), (150, [1.0, None]), (None, [3.0, 0.1]), (200, [1.0])]
    frame = spark.createDataFrame([(*r, 5.0) for r in rows], ROWS + ", score DOUBLE")
    every = F.col("vec_id") % 50 == 0
    got = sorted((r.query_id, r.rank, -1 if r.vec_id is None else r.vec_id) for r in crosspolytope.nearest(frame, every).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, -1), (0, 2, -1), (0, 3, 50), (0, 3, 50), (50, 1, -1), (50, 2, 0), (50, 3, 0)]
    assert crosspolytope.nearest(frame.limit(0), every).count() == 0
    assert crosspolytope.nearest(frame.filter("vec_id is null"), every).count() == 0
    assert crosspolytope.nearest(frame.filter("vec_id = 50"), every).count() == 0


def plain_counts(docs):
    low, counts = {i: i + 32 for i in range(65, 91)}, collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def plain_groups(counts):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [o for o in counts if o != w and near(w, o)] for w in counts}
    form = {}
    for w, found in others.items():
        if found:
            best = min(found, key=lambda o: (-counts[o], o))
            if counts[best] >= 5 * counts[w]:
                form[w] = best
    root = {}
    for w in counts:
        r = w
        while r in form:
            r = form[r]
        root[w] = r
    return {(w, form.get(w), root[w], n, len(others[w]), counts.get(form.get(w))) for w, n in counts.items()}


def spelt(seed=11, n=160):
    rng, letters = random.Random(seed), "abcdeéèß×"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(30)]
    pool += [w[:i] + rng.choice(letters) + w[i + k :] for w in pool for i in (0, 2, len(w) - 1) for k in (0, 1)]
    pool += ["z" * 200 + "é" * j for j in (3, 4)] + ["A" + w for w in pool[:20]]
    weights = [1 / (i + 1) for i in range(len(pool))]
    return [(rng.choice([None, i, i]), rng.choice([" ", "-", "漢", " ", "\n"]).join(rng.choices(pool, weights, k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("chunk", [4 << 20, 64])
def test_word_counts_equal_plain(monkeypatch, chunk):
    monkeypatch.setattr(variants, "CHUNK_BYTES", chunk)
    docs = spelt()
    ids, texts = pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])
    counts = collections.Counter()
    for at, size in ((0, 70), (70, len(docs))):
        for word, n in zip(*variants.spoilt_counts(ids.slice(at, size - at), texts.slice(at, size - at))):
            counts[word] += n
    assert {w: n for w, n in counts.items() if n >= 5} == plain_counts(docs)


def test_variants_equal_plain(spark):
    docs = spelt()
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs] + [(None, None, 1, "x"), (3, "", 1, "x")], "doc_id LONG, text STRING, n INT, word STRING")
    got = variants.group_variants(frame.repartition(4)).collect()
    assert {tuple(r) for r in got} == plain_groups(plain_counts(docs)) and len(got) > 30
    assert variants.group_variants(frame.limit(0)).count() == 0
    assert variants.group_variants(frame.filter("text = ''")).count() == 0


def test_near_words_share_a_signature():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzé"
    for _ in range(400):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 14)))
        i = rng.randrange(len(word))
        other = rng.choice([word[:i] + rng.choice(letters) + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:]])
        a, b = variants.signatures([word, other])
        assert set(a) & set(b)
        c, d = variants.signatures([word, other], first=2, second=4)
        assert set(c) & set(d)


def test_variants_broadcast_no_words(spark):
    """A word table far under the broadcast threshold unfolds thirtyfold in its signatures."""
    frame = spark.createDataFrame(spelt(), "doc_id LONG, text STRING")
    words = variants.word_counts(frame).cache()
    words.count()
    for made in (variants.near_pairs(words), variants.group_variants(frame)):
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
