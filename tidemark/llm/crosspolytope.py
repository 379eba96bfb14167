"""Nearest neighbours by cosine with cross-polytope hashing.

A vector's direction is turned by pseudo-random rotations (three rounds of random
signs and a fast Hadamard transform) and goes to the nearest of the signed axes;
``hashes`` of these make a bucket of one of ``tables`` tables. A query looks into the
buckets nearest to it (multiprobe: those whose axes lose least against its own).
How many is found on a bounded sample of queries, whose true neighbours are
searched among all rows, so that ``recall`` of them is met.

Members of a bucket are ranked where they lie, as products of matrices, and only
the best of each query leave the task, so no pair is ever a row. Large buckets
are cut into blocks by a hash, and queries of buckets with many are cut as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_parameters, shield
from tidemark.llm.vectors import complete, matrix, of_common_length
from tidemark.session import persist_table, ship_package, spread

TABLES, RECALL = 4, 0.97
# Queries whose true neighbours tell how many buckets to probe, and probes at most with several hashes a bucket.
SAMPLE_QUERIES, MAX_PROBES = 256, 2048
# Rows of a block, queries of a cut, and rows a bucket should hold on average before it takes another hash.
BLOCK_ROWS, QUERY_ROWS, BUCKET_ROWS = 4096, 16384, 4096
ROUNDS, BATCH_ROWS = 3, 512
SLACK = 1e-9


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which loses nothing, and their lengths."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, of a power of two columns, keeping lengths."""
    rows, size = x.shape
    h = 1
    while h < size:
        x = x.reshape(rows, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, size)
        h *= 2
    return x / np.sqrt(size)


@dataclass
class Hashing:
    dimensions: int
    hashes: int
    tables: int = TABLES
    seed: int = 7

    @property
    def axes(self) -> int:
        return 2 * self.padded

    @property
    def padded(self) -> int:
        return 1 << max(0, (self.dimensions - 1).bit_length())

    def scores(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Coordinates on every signed axis, by row and hash of the table."""
        scaled, length = unit(vectors)
        padded = np.zeros((len(vectors), self.padded))
        padded[:, : self.dimensions] = scaled / length[:, None]
        made = np.empty((len(vectors), self.hashes, self.axes))
        for h in range(self.hashes):
            rng = np.random.default_rng((self.seed, table, h))
            turned = padded
            for _ in range(ROUNDS):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], self.padded))
            made[:, h, 0::2], made[:, h, 1::2] = turned, -turned
        return made

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        number = np.zeros(len(vectors), np.int64)
        for nearest in self.scores(vectors, table).argmax(axis=2).T:
            number = number * self.axes + nearest
        return number

    def probes(self, vectors: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets (or all) that lose least, best first, by row."""
        scores = self.scores(vectors, table)
        lost = scores.max(axis=2, keepdims=True) - scores
        number, loss = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
        for h in range(self.hashes):
            number = (number[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(vectors), -1)
            loss = (loss[:, :, None] + lost[:, h, None, :] ** 2).reshape(len(vectors), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :count]
            number, loss = np.take_along_axis(number, order, 1), np.take_along_axis(loss, order, 1)
        return number


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part."""
    plain = shield(df, (vec_id, vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return of_common_length(plain.filter(complete("v") & F.exists("v", lambda c: c != 0)), "v")


def cosines(queries: np.ndarray, members: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the members that can be among its best ``k`` and their cosines, summed in one order for any block."""
    q, q_length = unit(queries)
    m, m_length = unit(members)
    rough = (q @ m.T) / q_length[:, None] / m_length
    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    for i in range(len(q)):
        near = np.flatnonzero(rough[i] >= least[i] - SLACK)
        yield near, (q[i] * m[near]).sum(axis=1) / (q_length[i] * m_length[near])


FOUND = "query bigint, uid bigint, vec_id bigint, score double, same boolean"


def _best(query: pa.Array, q_ids: pa.Array, q: np.ndarray, uid: np.ndarray, ids: pa.Array, m: np.ndarray, k: int) -> pa.RecordBatch:
    """The best ``k`` + 1 members of one block for each query; one of them may be the query's own row."""
    nobody = np.iinfo(np.int64).max
    number = ids.fill_null(nobody).to_numpy(zero_copy_only=False)
    own = q_ids.to_numpy(zero_copy_only=False)
    rows, at, scores, same = [], [], [], []
    for i, (near, score) in enumerate(cosines(q, m, k + 1)):
        order = np.lexsort((uid[near], number[near], -score))[: k + 1]
        near, score = near[order], score[order]
        rows.append(np.full(len(near), i))
        at.append(near)
        scores.append(score)
        same.append((number[near] == own[i]) & (m[near] == q[i]).all(axis=1))
    rows, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, at))
    return pa.RecordBatch.from_arrays(
        [query.take(pa.array(rows)), pa.array(uid[at]), ids.take(pa.array(at)),
         pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(np.concatenate(same) if same else np.zeros(0, bool))],
        ["query", "uid", "vec_id", "score", "same"],
    )


def best_of_all(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """True neighbours of a bounded list of query rows among all ``rows`` (uid, vec_id, v)."""
    q = np.array([r.v for r in queries], np.float64)
    numbers, own = pa.array([r.query for r in queries]), pa.array([r.vec_id for r in queries], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _best(numbers, own, q, batch.column("uid").to_numpy(), batch.column("vec_id"), matrix(batch.column("v")), k)

    return merged(rows.mapInArrow(run, FOUND), k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """Per query the best ``k`` members found, the query's own row left out: ``rank``, ``uid``, ``vec_id``, ``score``."""
    once = found.groupBy("query", "uid", "vec_id", "score", "same").agg(F.lit(1).alias("_"))
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "uid"]
    near = once.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("i") <= k + 1)
    first_own = F.min(F.when(F.col("same"), F.col("i"))).over(Window.partitionBy("query"))
    ranked = near.withColumn("own", first_own)
    rank = F.col("i") - F.when(F.col("i") > F.col("own"), 1).otherwise(0)
    return ranked.filter(~F.col("i").eqNullSafe(F.col("own"))).select("query", rank.cast("int").alias("rank"), "uid", "vec_id", "score").filter(
        F.col("rank") <= k
    )


def probes_needed(hashing: Hashing, queries: np.ndarray, neighbours: list[np.ndarray], recall: float) -> int | None:
    """The fewest probes a table that reach ``recall`` of the neighbours, None if ``MAX_PROBES`` do not."""
    most = hashing.axes if hashing.hashes == 1 else MAX_PROBES
    ranks = []
    for i, near in enumerate(neighbours):
        if not len(near):
            continue
        least = np.full(len(near), most)
        for t in range(hashing.tables):
            order = hashing.probes(queries[i : i + 1], t, most)[0]
            place = {int(b): r for r, b in enumerate(order)}
            least = np.minimum(least, [place.get(int(b), most) for b in hashing.bucket(near, t)])
        ranks.append(least)
    if not ranks:
        return 1
    ranks = np.sort(np.concatenate(ranks))
    wanted = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])
    return wanted + 1 if wanted < most else None


def calibrate(rows: DataFrame, queries: DataFrame, k: int, tables: int, recall: float) -> tuple[Hashing, int]:
    """Hashing and probes, from the size of the table and at most ``SAMPLE_QUERIES`` queries of smallest hash.

    More hashes a bucket are for larger tables. Where the probes allowed do not
    reach ``recall``, buckets take fewer hashes; with one hash all of them can be
    probed, which is exact.
    """
    sample = queries.orderBy(F.xxhash64("query")).limit(SAMPLE_QUERIES).collect()
    d = len(sample[0].v)
    count = rows.count()
    true = best_of_all(rows, sample, k).join(rows.select("uid", "v"), "uid").select("query", "v").collect()
    held: dict[int, list] = {}
    for r in true:
        held.setdefault(r.query, []).append(r.v)
    vectors = np.array([r.v for r in sample], np.float64)
    near = [np.array(held.get(r.query, []), np.float64) for r in sample]
    axes = Hashing(d, 1).axes
    hashes = max(1, int(np.log(max(count, 2) / BUCKET_ROWS) / np.log(axes))) if count > BUCKET_ROWS else 1
    while True:
        hashing = Hashing(d, hashes, tables)
        probes = probes_needed(hashing, vectors, near, recall)
        if probes is not None or hashes == 1:
            return hashing, probes or hashing.axes
        hashes -= 1


def _index(hashing: Hashing, probes: int, numbers: tuple[str, ...]) -> Column | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                v = matrix(batch.column("v"))
                for t in range(hashing.tables):
                    buckets = hashing.probes(v, t, probes) if probes else hashing.bucket(v, t)[:, None]
                    width = buckets.shape[1]
                    lists = pa.ListArray.from_arrays(np.arange(0, buckets.size + 1, width, dtype=np.int32), pa.array(buckets.reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * batch.num_rows, pa.int32()), lists, *[batch.column(c) for c in numbers], batch.column("v")],
                        ["t", "buckets", *numbers, "v"],
                    )

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, members before queries."""
        group, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "bucket", "block", "cut", "kind")], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, stop in zip([0, *change], [*change, len(keys)], strict=True):
                key, part = tuple(keys[at][:4]), batch.slice(at, stop - at)
                if key != group:
                    group, parts, block = key, [], None
                if keys[at][4] == 0:
                    parts.append((part.column("number").to_numpy(), part.column("vec_id"), matrix(part.column("v"))))
                elif parts:
                    if block is None:
                        block = (np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
                    for i in range(0, part.num_rows, BATCH_ROWS):
                        some = part.slice(i, BATCH_ROWS)
                        yield _best(some.column("number"), some.column("vec_id"), matrix(some.column("v")), *block, k)

    return run


def nearest(
    df: DataFrame, chosen: Column, k: int = 5, tables: int = TABLES, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows found for each row that ``chosen`` holds for.

    ``chosen`` is a condition on ``vec_id``; rows it is null for are no queries. Score
    is the cosine in double precision, ties go to the smaller id, null ids last.
    Rows whose vector is null, empty, zero, not of the commonest length or holds a
    null, NaN or infinite entry take no part. A row never finds itself but does
    find others, also with its own id or vector; queries that are repeated rows
    get their result each. Fewer candidates than ``k`` are all returned, as far as
    found. Extra columns are not looked at; no queries give no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = usable(df, vec_id, vector)
    # Of equal vectors the k + 1 of smallest id can be among the best k of any query.
    alike = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    few = rows.withColumn("i", F.row_number().over(alike)).filter(F.col("i") <= k + 1).select("vec_id", "v")
    members = persist_table(spread(few.withColumn("uid", F.monotonically_increasing_id())), "members")
    asked = rows.filter(chosen).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    asked = persist_table(spread(asked.withColumn("query", F.monotonically_increasing_id())), "queries")
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if asked.isEmpty():
        return spark.createDataFrame([], result)
    hashing, probes = calibrate(members, asked, k, tables, recall)
    fields = f"v {dict(rows.dtypes)['v']}"
    place = "t int, buckets array<bigint>"
    stored = members.mapInArrow(_index(hashing, 0, ("uid", "vec_id")), f"{place}, uid bigint, vec_id bigint, {fields}")
    stored = stored.select("t", F.col("buckets")[0].alias("bucket"), F.col("uid").alias("number"), "vec_id", "v")
    probing = asked.mapInArrow(_index(hashing, probes, ("query", "vec_id")), f"{place}, query bigint, vec_id bigint, {fields}")
    probing = probing.select("t", F.explode("buckets").alias("bucket"), F.col("query").alias("number"), "vec_id", "v")
    sizes = stored.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    crowds = probing.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("asking"))
    shape = sizes.join(crowds, ["t", "bucket"]).select(
        "t", "bucket", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("asking") / QUERY_ROWS).cast("int").alias("cuts")
    )
    shape = persist_table(shape, "bucket-shapes").withColumn("place", F.struct("t", "bucket")).drop("t", "bucket")
    salt = F.xxhash64("number")
    both = join_parameters(stored.withColumn("place", F.struct("t", "bucket")), shape, "place").select(
        "t", "bucket", F.pmod(salt, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"),
        F.lit(0).alias("kind"), "number", "vec_id", "v",
    ).unionByName(join_parameters(probing.withColumn("place", F.struct("t", "bucket")), shape, "place").select(
        "t", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(salt, F.col("cuts")).cast("int").alias("cut"),
        F.lit(1).alias("kind"), "number", "vec_id", "v",
    ))
    group = ["t", "bucket", "block", "cut"]
    found = both.repartition(*group).sortWithinPartitions(*group, "kind").mapInArrow(_search(k), FOUND)
    best = merged(found, k).join(asked.select("query", F.col("vec_id").alias("query_id"), "times"), "query")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return best.select("query_id", "rank", "vec_id", "score", again.alias("_")).drop("_")
