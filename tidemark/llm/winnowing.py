"""Document fingerprints by winnowing.

A text is its words; every run of ``k`` words has a hash; of every ``window``
consecutive hashes the smallest is selected, the rightmost of equal ones. Two
texts that share a run of ``k + window - 1`` words share a selected hash, and no
shared run shorter than ``k`` words is reported. Positions (index of the first
word of the run) stay with the hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, shield, text_of, words

K, WINDOW = 5, 8
# Neighbours are found inside buckets of the id order; their number is bounded, their bounds are parameters.
MAX_BUCKETS = 20_000


def gram_hashes(w: Column, k: int = K) -> Column:
    """Hash of every run of ``k`` words; a shorter text is one run; no words, none."""
    n = F.size(w)
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < k, F.array(F.xxhash64(w)))
        .otherwise(F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k))))
    )


def select_minima(h: Column, window: int = WINDOW) -> Column:
    """Array of (hash, pos): the rightmost minimum of each window, once; fewer hashes are one window."""
    n = F.size(h)
    span = F.least(n, F.lit(window))

    def rightmost(i: Column) -> Column:
        part = F.slice(h, i, span)
        return (i + span - F.array_position(F.reverse(part), F.array_min(part))).cast("int")

    spots = F.array_distinct(F.transform(F.sequence(F.lit(1), n - span + 1), rightmost))
    picked = F.transform(spots, lambda p: F.struct(F.get(h, p - 1).alias("hash"), (p - 1).alias("pos")))
    return F.when(n > 0, picked).otherwise(F.array().cast("array<struct<hash:bigint,pos:int>>"))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    return let(let(words(text), lambda w: gram_hashes(w, k)), lambda h: select_minima(h, window))


def fingerprint_digest(marks: Column) -> Column:
    """One text for a whole fingerprint, positions included."""
    listed = F.transform(marks, lambda m: F.concat_ws(":", F.hex(m["hash"]), m["pos"].cast("string")))
    return F.sha2(F.array_join(listed, ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Share of the selected hashes that both have: 1 for two empty fingerprints."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(F.array_union(a, b)))


def _bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds not above ``value``, by halving; null goes to the first bucket."""
    if not bounds:
        return F.lit(0)
    edges = F.lit(bounds).cast("array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        inside = (s["lo"] < s["hi"]) & (F.get(edges, middle) <= value)
        return F.struct(
            F.when(inside, middle + 1).otherwise(s["lo"]).alias("lo"),
            F.when(inside | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve, lambda s: s["lo"]))


def with_next(docs: DataFrame, carried: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """``docs`` with ``next_<name>`` for each carried column: its value in the following document.

    Documents follow ascending doc_id, null first, rows of one id by length and
    hash of the text; the last is followed by the first. Ids are cut into
    buckets at quantiles; the first rows of a bucket also visit the bucket
    before it, so that one shuffle finds every neighbour.
    """
    spark = docs.sparkSession
    wanted = min(buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    steps = [i / wanted for i in range(1, wanted)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * wanted))).first()[0]
    bounds = sorted(set(found or []))
    placed = docs.withColumn("_bucket", _bucket_of(F.col("doc_id"), bounds))
    # One row per bucket: bounded by the parameter, not by the data.
    firsts = {r[0]: r[1:] for r in placed.groupBy("_bucket").agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).collect()}
    held = sorted(firsts)
    before = {b: held[i - 1] for i, b in enumerate(held)}
    first_ids = F.lit([firsts.get(b, (None, False))[0] for b in range(len(bounds) + 1)]).cast("array<bigint>") if any(
        v[0] is not None for v in firsts.values()
    ) else F.array().cast("array<bigint>")
    has_null = F.lit(bool(firsts.get(0, (None, False))[1]))
    is_first = F.when(F.col("doc_id").isNull(), True).when((F.col("_bucket") == 0) & has_null, False).otherwise(
        F.col("doc_id") == F.get(first_ids, F.col("_bucket"))
    )
    previous = F.get(F.lit([before.get(b, 0) for b in range(len(bounds) + 1)]), F.col("_bucket"))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("visits"))
    visit = F.struct(previous.alias("b"), F.lit(True).alias("visits"))
    spread = placed.withColumn("_at", F.explode(F.when(is_first, F.array(own, visit)).otherwise(F.array(own))))
    rows = spread.withColumns({f"_c_{k}": v for k, v in carried.items()})
    order = Window.partitionBy("_at.b").orderBy(
        F.col("_at.visits"), F.col("doc_id").asc_nulls_first(), F.length(text_of()), F.xxhash64(text_of())
    )
    led = rows.withColumns({f"next_{k}": F.lead(f"_c_{k}").over(order) for k in carried})
    named = led.filter(~F.col("_at.visits")).withColumnsRenamed({f"_c_{k}": k for k in carried})
    return named.drop("_bucket", "_at")


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``marks``: the fingerprint of each whole text, one row per row.

    Null text is empty: no marks. Equal texts have equal marks; fewer than ``k``
    words are one run. Repeated rows give repeated results; extra columns are
    not returned; no rows give no rows.
    """
    return shield(docs).select("doc_id", F.length(text_of()).cast("long").alias("n_chars"), fingerprint(text_of(), k, window).alias("marks"))


def compare_with_edit(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last quarter (floor, in code points) replaced by as
    many code points from the start of the next document, or all it has. The
    cases of ``fingerprint_documents`` hold here too.
    """
    rows = shield(docs).select("doc_id", text_of().alias("text"))
    marks = fingerprint(F.col("text"), k, window)
    carried = {"whole": F.col("text"), "made": let(marks, lambda m: F.struct(
        F.transform(m, lambda x: x["hash"]).alias("hashes"), fingerprint_digest(m).alias("digest")
    ))}
    led = with_next(rows, carried)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_whole", F.lit(1), quarter))
    second = let(fingerprint(F.col("edited"), k, window), lambda m: F.struct(
        F.transform(m, lambda x: x["hash"]).alias("hashes"), fingerprint_digest(m).alias("digest")
    ))
    return led.select("doc_id", "text", "made", "next_made", n.cast("long").alias("n_chars"), edited.alias("edited")).select(
        "doc_id", "n_chars", "made", "next_made", F.sha2("edited", 256).alias("edited_sha256"), second.alias("second")
    ).select(
        "doc_id", "n_chars", "edited_sha256", F.col("made.digest").alias("fingerprint"),
        F.col("second.digest").alias("edited_fingerprint"),
        likeness(F.col("made.hashes"), F.col("second.hashes")).alias("near_edited"),
        likeness(F.col("made.hashes"), F.col("next_made.hashes")).alias("near_next"),
    )
