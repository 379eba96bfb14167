"""Near duplicates by weighted Jaccard similarity of word shingles.

Signatures are BagMinHash: the weight axis of an element (here: how often a
shingle occurs) is cut into unit cells, grouped in dyadic intervals (0, 1],
(1, 2], (2, 4], ... Each interval of an element has a Poisson process whose rate
is its length times the number of registers; a point is passed down the halves of
the interval to a cell and to a register by bits of its hash, and counts if the
cell lies below the weight. A register keeps its earliest point, so two texts
agree in a register with a probability equal to their weighted Jaccard
similarity. Points later than all registers of a text cannot matter, which ends
the processes early.

Registers are banded; texts that share a band are candidates and are verified by
exact multiset overlap. Instead of all pairs of a band bucket, members are
compared with a pivot; see ``bucket_roots``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shield, text_of
from tidemark.session import persist_table

SHINGLE, SIMILARITY = 5, 0.8
# At similarity 0.8 a pair shares no band with probability 5e-4, at 0.85 with 2e-5: (1 - s^7)^32.
BANDS, BAND_ROWS = 32, 7
REGISTERS = BANDS * BAND_ROWS
# Bits of a text's parity marks for each of its shingles; few of the at most 2/9 of them in which texts of similarity
# 0.8 differ fall together then.
MARK_BITS = 4
BATCH_ROWS = 1_000
# Strangers of a bucket that become pivots in one round, at most.
PIVOTS = 1024
# Strangers of a bucket for each slice that its members are dealt to when they meet the pivots.
SLICE_STRANGERS = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bags(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of every distinct shingle of each text, ordered.

    A text with fewer than ``size`` words has one shingle of all of them; one
    without words has none.
    """
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) if w else 0 for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary)
    )
    word = hashes[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    held = word != 0  # splitting yields an empty word at either end of a text
    word, of = word[held], of[held]
    n = np.bincount(of, minlength=len(texts))
    begin = np.cumsum(n) - n
    last = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), last)
    at = np.repeat(begin - (np.cumsum(last) - last), last) + np.arange(len(text))
    shingle = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            inside = j < n[text]
            value = np.where(inside, word[np.minimum(at + j, max(len(word) - 1, 0))], np.uint64(0)) if len(word) else shingle
            shingle = mix(shingle * np.uint64(0xD6E8FEB86659FD93) + value + _GOLD)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    spots = np.flatnonzero(new)
    return text[spots], shingle[spots], np.diff(np.append(spots, len(text)))


def signatures(text: np.ndarray, element: np.ndarray, count: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of every text, infinite where it has no element."""
    weight = np.bincount(text, weights=count, minlength=texts)
    held = np.full((texts, registers), np.inf)
    todo = np.flatnonzero(weight > 0)
    # All registers are filled before this time but for one text in 10^6; those run again without it.
    bound = np.full(texts, np.inf)
    bound[todo] = (np.log(registers) + 14) / weight[todo]
    while len(todo):
        wanted = np.zeros(texts, bool)
        wanted[todo] = True
        mine = wanted[text]
        t_of, e_of, c_of = text[mine], element[mine], count[mine]
        blocks = int(np.ceil(np.log2(c_of.max()))) + 1 if c_of.max() > 1 else 1
        flat = held.reshape(-1)
        for k in range(blocks):
            low = 0 if k == 0 else 1 << (k - 1)  # the block is (low, low + cells]
            cells = 1 if k == 0 else low
            live = np.flatnonzero(c_of > low)
            owner, seed = t_of[live], mix(e_of[live] + np.uint64((int(_GOLD) * (k + 1)) % (1 << 64)))
            level, time, step = c_of[live] - low, np.zeros(len(live)), 0
            while len(owner):
                step += 1
                with np.errstate(over="ignore"):
                    draw = mix(seed + np.uint64((int(_GOLD) * step) % (1 << 64)))
                    time = time - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / (registers * cells)
                    early = np.flatnonzero(time <= bound[owner])
                    owner, seed, time, level = owner[early], seed[early], time[early], level[early]
                    place = mix(draw[early] ^ np.uint64(0xA0761D6478BD642F))
                register = ((place >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
                below = (place & np.uint64(cells - 1)).astype(np.int64) < level
                np.minimum.at(flat, owner[below] * registers + register[below], time[below])
                touched = np.unique(owner) if step % 4 == 1 else owner[:0]
                bound[touched] = np.minimum(bound[touched], held[touched].max(axis=1))
        todo = np.flatnonzero(~np.isfinite(held).all(axis=1) & wanted)
        bound[todo] = np.inf
        held[todo] = np.inf
    return held


def band_hashes(held: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    bits = held.view(np.uint64).reshape(len(held), -1, rows)
    out = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64) * _GOLD, bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, j])
    return out.view(np.int64)


def parity_marks(text: np.ndarray, element: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the texts, their marks one behind the other, and where each one's marks begin (64-bit words).

    Every occurrence of a shingle flips one bit, chosen by its hash. Two texts'
    marks differ in no more bits than the texts differ in occurrences, whatever
    falls together. The number of bits is a power of two near the weight, and the
    marks of half as many bits are the two halves' exclusive or.
    """
    weight = np.bincount(text, weights=count, minlength=texts).astype(np.int64)
    words = 1 << np.ceil(np.log2(np.maximum(weight * MARK_BITS / 64, 1))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(text, count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        spot = mix(np.repeat(element, count) + _GOLD * (turn.astype(np.uint64) + np.uint64(1)))
    bit = (spot & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)
    marks = np.zeros(begin[-1], np.uint64)
    np.bitwise_xor.at(marks, begin[owner] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return weight, marks.view(np.int64), begin


def may_reach(x: Column, y: Column, x_weight: Column, y_weight: Column, threshold: float) -> Column:
    """Whether two texts can have similarity ``threshold``, by their parity marks: false only where they cannot.

    Similarity s means that they differ in (1 - s) / (1 + s) of all their
    occurrences, and weights and marks differ in no more than that.
    """
    differ = (x_weight + y_weight) * ((1.0 - threshold) / (1.0 + threshold)) + 1e-6
    words = F.least(F.size(x), F.size(y))

    def folded(marks: Column) -> Column:
        halves = F.zip_with(F.slice(marks, F.lit(1), words), F.slice(marks, words + 1, words), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(marks) == words, marks).otherwise(halves)

    # Weights this near differ by less than half, so one has at most twice the bits of the other.
    unlike = F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, v: n + v)
    near = F.abs(x_weight - y_weight) <= differ
    return near & ((F.greatest(F.size(x), F.size(y)) > 2 * words) | (unlike <= differ))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            text, element, count = bags(part.column("text"))
            held = signatures(text, element, count, part.num_rows)
            bands = band_hashes(held)
            weight, marks, begin = parity_marks(text, element, count, part.num_rows)
            bands = pa.array([b if w else [] for b, w in zip(bands, weight, strict=True)], pa.list_(pa.int64()))
            marks = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(marks))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("node"), bands, pa.array(weight), marks], ["doc_id", "node", "bands", "weight", "marks"]
            )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two bags."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS // 2):
            part = batch.slice(at, BATCH_ROWS // 2)
            n = part.num_rows
            # A pivot's rows follow each other: its bag is made once per run of rows.
            pivots = part.column("b").dictionary_encode()
            which = pivots.indices.to_numpy()
            first = np.unique(which, return_index=True)[1]
            texts = pa.concat_arrays([part.column("a_text"), part.column("b_text").take(pa.array(first))])
            text, element, count = bags(texts)
            ends = np.searchsorted(text, np.arange(n + len(first) + 1))
            one = lambda i: (element[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]])
            found = [overlap(one(i), one(n + which[i])) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"]
            )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``similarity`` of each distinct pair of nodes (a, b)."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(_verify, "a bigint, b bigint, similarity double")


def bucket_roots(members: DataFrame, texts: DataFrame, marked: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Components (node, root) of the buckets' pairs of ``threshold`` or more; a node alone may be left out.

    ``members``: bucket, node; ``marked``: node, n, marks. First a bucket compares its members with one
    pivot. Who is then connected with the pivot, by whatever links, is at home.
    The others, strangers, become pivots of later rounds, some at a time, and are
    compared with the members they are not connected with, as far as these can be
    like them: 1 - similarity is a metric, so distances from the first pivot must
    not differ by more than 1 - threshold, and their parity marks must not differ
    in more bits than the threshold leaves (``may_reach``). Neither drops a pair of
    ``threshold``. A bucket without strangers is done.
    """
    reach = 1.0 - threshold + 1e-9
    # The text that meets most others is near the middle of its group and the best pivot for it.
    crowd = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"))
    weight = members.join(crowd, "bucket").groupBy("node").agg(F.sum("_size").alias("weight"))
    members = persist_table(members.join(weight, "node"), "bucket-weights")
    first = members.groupBy("bucket").agg(F.max(F.struct("weight", "node")).getField("node").alias("home"))
    held = persist_table(members.join(first, "bucket").filter("node != home"), "bucket-members")
    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    known = persist_table(verified(held.withColumnRenamed("home", "other").select(*pair).distinct(), texts), "verified-pairs")
    distances = known.select("a", "b", (1.0 - F.col("similarity")).alias("d"))
    active = held.withColumn("a", F.least("node", "home")).withColumn("b", F.greatest("node", "home")).join(
        distances, ["a", "b"]
    ).select("bucket", "node", "home", "d", "weight")
    roots = components(known.filter(F.col("similarity") >= threshold).select("a", "b"))
    while True:
        active = active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        homes = roots.select(F.col("node").alias("home"), F.col("root").alias("home_root"))
        active = active.join(homes, "home", "left").withColumn("stranger", F.col("root") != F.coalesce("home_root", "home"))
        spread = active.filter("stranger").groupBy("bucket").agg(
            F.min("d").alias("_low"), F.max("d").alias("_high"), F.count(F.lit(1)).alias("strangers")
        )
        active = persist_table(
            active.join(spread, "bucket").filter(
                F.col("stranger") | ((F.col("d") >= F.col("_low") - reach) & (F.col("d") <= F.col("_high") + reach))
            ).select("bucket", "node", "home", "d", "weight", "root", "stranger", "strangers"), "bucket-rest",
        )
        turn = F.when(F.col("strangers") > PIVOTS, F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).otherwise(F.col("node"))
        pivots = active.filter("stranger").groupBy("bucket", turn.alias("_r")).agg(
            F.max(F.struct("weight", "node", "d", "root", "strangers")).alias("p")
        ).select("bucket", *[F.col(f"p.{c}").alias(f"other_{c}" if c != "node" else "other") for c in ("node", "d", "root", "strangers")])
        pivots = persist_table(pivots, "bucket-pivots")
        if pivots.isEmpty():
            return roots
        others = pivots.join(marked.select(F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("marks").alias("other_marks")), "other")
        # Every slice of a crowded bucket meets all its pivots; the number of tasks follows the comparisons, not the bytes.
        slices = lambda n: F.ceil(F.col(n) / SLICE_STRANGERS)
        others = others.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices("other_strangers") - 1)))
        dealt = active.join(marked, "node").withColumn("slice", F.pmod(F.xxhash64("node"), slices("strangers"))).repartition(
            int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "slice"
        )
        likely = dealt.join(others, ["bucket", "slice"]).filter(
            (F.col("root") != F.col("other_root")) & (F.abs(F.col("d") - F.col("other_d")) <= reach)
            & may_reach(F.col("marks"), F.col("other_marks"), F.col("n"), F.col("other_n"), threshold)
        )
        pairs = likely.select(*pair).distinct().join(known, ["a", "b"], "left_anti")
        new = persist_table(verified(pairs, texts), "verified-pairs")
        known = persist_table(known.unionByName(new), "known-pairs")
        roots = joined_roots(roots, new.filter(F.col("similarity") >= threshold))
        active = active.join(pivots.select("bucket", F.col("other").alias("node")), ["bucket", "node"], "left_anti").select(
            "bucket", "node", "home", "d", "weight"
        )


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) with the components that ``links`` (a, b) join made one; only their roots are walked."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")
    ).filter("a != b")
    between = persist_table(between, "new-links")
    if between.isEmpty():
        return roots
    moved = components(between)
    kept = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    single = moved.join(roots, "node", "left_anti").select("node", "root")
    return persist_table(kept.select("node", F.coalesce("_to", "root").alias("root")).union(single), "roots")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for the nodes of ``edges`` (a, b).

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours to that.
    """
    edges = persist_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = persist_table(large.filter("u != v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        ).filter("u != v").distinct()
        edges = persist_table(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def duplicate_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``class_id`` (the smallest doc_id of its class) for every row of ``docs``.

    Classes are what links of similarity ``threshold`` or more connect, as far as
    the texts of a link share a band. Equal texts are one node from the start,
    however many there are. Texts without words are alike only if equal; one to
    four words are a single shingle. Null text is empty. A class without any
    doc_id has a null class_id. Where ids are null or repeated, unlike classes
    can have one class_id: ``root``, the smallest text hash of the class, tells
    them apart. Repeated rows give repeated results; extra
    columns are not returned; texts are read whole; no rows give no rows.
    """
    node = F.xxhash64(F.sha2(text_of(), 256))
    rows = shield(docs).select(F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"), text_of().alias("text"))
    signed = persist_table(rows.mapInArrow(
        _sign, "doc_id bigint, node bigint, bands array<bigint>, weight bigint, marks array<bigint>"
    ), "signatures")
    nodes = persist_table(signed.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("weight").alias("n"), F.first("marks").alias("marks")
    ), "texts")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = persist_table(members.join(crowded, "bucket"), "buckets")
    involved = members.select("node").distinct()
    # One text of each node: rows of the smallest id, and where ids repeat any one of equal texts.
    chosen = nodes.join(involved, "node").select("node", F.col("first_id").alias("_id"))
    picked = rows.join(chosen.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = persist_table(picked.groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")
    marked = nodes.join(involved, "node").select("node", "n", "marks")
    rooted = bucket_roots(members, texts, marked, threshold)
    named = nodes.select("node", "first_id").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = persist_table(named.join(heads, "root").select("node", "class_id", "root"), "classes")
    return signed.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "node", "root")


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest doc_id, null last, then of the smallest text hash.

    Rows equal in both are one text under one id, of which any stays.
    """
    columns, docs = docs.columns, shield(docs)
    classes = duplicate_classes(docs, threshold)
    heads = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("_head")).select(
        F.col("_head.node").alias("_node"), F.col("_head.doc_id").alias("_id")
    )
    keyed = docs.withColumn("_text", F.xxhash64(F.sha2(text_of(), 256)))
    kept = keyed.join(heads, (F.col("_text") == F.col("_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")))
    one = Window.partitionBy("_text").orderBy(*[F.col(c) for c in docs.columns if c in ("doc_id", "source", "lang")])
    return kept.withColumn("_i", F.row_number().over(one)).filter("_i = 1").select(*docs.columns).toDF(*columns)
