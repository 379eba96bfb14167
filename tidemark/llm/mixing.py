"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key divided by its quality weight, which is
the order of Efraimidis and Spirakis: sorting by the key is a weighted sample
without replacement at every length. A source whose target is several times its
size gives its complete epochs first; the rest of the target is filled along the
order, by a running sum of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_parameters, key_of, shield, sum_before, text_of, words
from tidemark.session import persist_table

# Running sums go bucket by bucket, so that a source of any size is spread over this many.
KEY_BUCKETS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets that add up to all sizes, in proportion to weights, none above ``cap`` sizes.

    ``sizes`` has one row per source: ``source``, ``source_size``. Sources in
    code-point order, null last, take the weights of ``cycle`` in turn. The level
    (words per unit of weight) follows from the order of ``cap * size / weight``:
    the sources with the lowest ratios are capped, the others share what remains,
    which is where sharing the excess again and again ends.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = sizes.withColumn("_n", F.row_number().over(everything)).withColumn(
        "weight", F.element_at(weights, (F.col("_n") - 1) % len(cycle) + 1)
    ).withColumn("_limit", F.col("source_size") * cap)
    total = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("_limit") / F.col("weight"), "_n")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The level for this source and those after it, were all of a lower ratio capped.
    stated = ranked.select(
        "*",
        F.sum("source_size").over(total).alias("_all"), F.sum("weight").over(total).alias("_weights"),
        (F.sum("_limit").over(upto) - F.col("_limit")).alias("_capped"),
        (F.sum("weight").over(upto) - F.col("weight")).alias("_gone"),
    )
    # It rises while capping is due and falls afterwards: the level of the result is the highest.
    level = (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_gone"))
    share = F.max(level).over(total) * F.col("weight")
    return stated.select(
        "source", "source_size", "weight", F.least(F.col("_limit").cast("double"), share).alias("target")
    )


def exponential_key(weight: Column, *ident: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash: the same in every run."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("~")) for c in ident]), 256)
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def quality_weights(labels: DataFrame, high: float = 1.0, low: float = 0.25) -> DataFrame:
    """One weight per labelled document, between ``low`` and ``high`` by its mean quality label."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.lit(low) + (high - low) * F.avg(F.col("quality").cast("double"))).alias("quality_weight")
    )


def mix(
    docs: DataFrame, labels: DataFrame | None = None, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3,
    unlabelled: float = 0.625, seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` is how often the mix takes the document, ``taken`` is copies times
    size. A source takes ``floor(target / source_size)`` complete epochs; of the
    rest it takes documents in key order while the middle of the document lies
    below it, so the taken words miss the target by half a document at most.

    Null text counts 0 words; such and empty documents are taken in complete
    epochs only, plus at the start of the rest. A null source is a source of its
    own. Repeated rows are documents of their own with equal keys; ties follow
    doc_id, then size. Extra columns are not returned. No rows give no rows.
    """
    rows = shield(docs).withColumn("size", word_count(text_of()))
    # Texts are read once; what follows works on four numbers a document.
    narrow = persist_table(rows.select("doc_id", "source", "size", F.xxhash64(text_of()).alias("_text")), "mix-sizes")
    if labels is not None:
        narrow = narrow.join(quality_weights(labels), "doc_id", "left")
    else:
        narrow = narrow.withColumn("quality_weight", F.lit(None).cast("double"))
    weight = F.coalesce("quality_weight", F.lit(unlabelled))
    keyed = narrow.select(
        "doc_id", "source", "size", "_text", key_of("source").alias("_source"),
        exponential_key(weight, F.col("doc_id"), seed=seed).alias("_key"),
    ).withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key") * unlabelled)) * KEY_BUCKETS))
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, cycle, cap).select(
        key_of("source").alias("_source"), "source_size", "target"
    )
    placed = sum_before(
        keyed, ["_source"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_text")], "size", "_before"
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    chosen = join_parameters(placed, targets, "_source").withColumn("_epochs", epochs).select(
        "doc_id", "source", "size", "source_size", "target", "_text",
        (F.col("_epochs") + F.when(F.col("_before") + F.col("size") / 2.0 < rest, 1).otherwise(0)).cast("int").alias("copies"),
    )
    return chosen.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of ``docs``.

    The text is joined back by document, source and hash of the text; rows equal
    in all three are counted together, so that none is multiplied by the join.
    The other cases are those of ``mix``; extra columns stay.
    """
    columns, docs = docs.columns, shield(docs)
    chosen = mix(docs, labels, **options).groupBy("doc_id", "source", "_text").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    named = chosen.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_text").alias("_t"), "_copies", "_rows")
    joined = docs.join(
        named,
        docs["doc_id"].eqNullSafe(F.col("_d")) & docs["source"].eqNullSafe(F.col("_s")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_t")),
    )
    # Repeated rows share their copies: each gets the floor of the share, the first ones one more.
    same = Window.partitionBy("_d", "_s", "_t").orderBy(F.lit(1))
    joined = joined.withColumn("_i", F.when(F.col("_rows") == 1, 1).otherwise(F.row_number().over(same)))
    share = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_i") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return (
        joined.withColumn("_share", share.cast("int")).filter("_share > 0")
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_share"))).alias("_copy")).drop("_copy").toDF(*columns)
    )
