"""Deleting passages of whole lines that occurred before, by winnowing over line hashes.

From every line on, the shortest run of lines with ``min_words`` words is a
window. Its smallest line hash is its fingerprint, kept with the hash of the
window, since a short line alone may stand anywhere. A window is also prolonged
line by line up to where the next window ends, each such run with a fingerprint
of its own. Take any run i to j of ``min_words`` words that occurred before: the
windows from i on that end by j, and the last of them prolonged to j, occurred
before too and cover it. So a run is deleted where its own fingerprint has an
earlier place, whichever that is; no match needs to be extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import key_of, shield, text_of
from tidemark.session import persist_table

MIN_WORDS = 50


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and word counts of the lines that have a word."""
    for batch in batches:
        hashes, counts = [], []
        for text in batch.column("text").to_pylist():
            # bytes.split() without an argument splits at the six ASCII spaces.
            lines = [x.encode() for x in text.split("\n")]
            words = [len(x.split()) for x in lines]
            hashes.append([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, n in zip(lines, words, strict=True) if n])
            counts.append([n for n in words if n])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
            ["doc", "hashes", "counts"],
        )


def window_minima(hashes: list[int], counts: list[int], min_words: int) -> list[tuple[int, int, int, int]]:
    """(first line, lines, smallest line hash, run hash) of every window of one text and of its longer runs.

    A window is prolonged up to where the next one ends; where there is no next
    one, to the end of the text. Runs number at most twice the lines.
    """
    out = []
    values = np.array(hashes, np.int64)
    upto = np.cumsum([0, *counts])
    ends = np.searchsorted(upto, upto[:-1] + min_words, "left")
    for i, e in enumerate(ends):
        if e > len(hashes):
            break
        least = int(values[i:e].min())
        for k in range(e, max(e + 1, min(ends[i + 1] if i + 1 < len(ends) else 0, len(hashes) + 1))):
            least = min(least, int(values[k - 1]))
            out.append((i, int(k - i), least, xxhash.xxh3_64_intdigest(values[i:k].tobytes()) - (1 << 63)))
    return out


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = [], []
            for doc, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("doc", "hashes", "counts")), strict=True):
                found = window_minima(hashes, counts, min_words)
                docs += [doc] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, batch.schema.field("doc").type), *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]],
                ["doc", "line", "lines", "least", "window"],
            )

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc`` (id, hash of the text) and ``runs``: (first, end) of the lines to delete, blank lines not counted."""
    rows = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("h")).alias("doc"), text_of().alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    lines = persist_table(
        rows.mapInArrow(_line_rows, f"doc {kind}, hashes array<bigint>, counts array<int>"), "line-hashes"
    )
    windows = persist_table(
        lines.select("doc", "hashes", "counts").mapInArrow(
            _window_rows(min_words), f"doc {kind}, line int, lines int, least bigint, window bigint"
        ), "line-windows",
    )
    place = F.struct("doc", "line")
    first = windows.groupBy("least", "window").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first != _last")
    matches = windows.join(first, ["least", "window"]).filter(place != F.col("_first")).select(
        key_of("doc").alias("key"), F.col("line").alias("first"), (F.col("line") + F.col("lines")).alias("end"),
    )
    return matches.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("runs"))


def _cut(text: str, runs: list) -> tuple[str, int, int]:
    """Text without the runs, its number of lines, and how many went. Blank lines inside a run go with it."""
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0
    worded = [i for i, x in enumerate(lines) if x.encode().split()]
    gone = np.zeros(len(lines), bool)
    for r in runs:
        gone[worded[r["first"]] : worded[r["end"] - 1] + 1] = True
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum())


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated passages cut from ``text``, plus ``n_lines`` and ``n_deleted``.

    A passage is a run of whole lines, equal to an earlier run and of at least
    ``min_words`` words. Earlier means a smaller doc_id (null first), for one id
    the smaller hash of the text, then the earlier line. The first occurrence of
    a line is never deleted, so nothing is lost from the corpus. Lines without a
    word do not count; those inside a deleted run go with it.

    Null text stays null and an emptied text is ''. Rows equal in id and text are
    one document and get the same result. ``n_chars``, where present, follows the
    new text. Extra columns stay, those named as added ones are replaced; no rows
    give no rows. Texts are read whole.
    """
    kept = docs.drop("n_lines", "n_deleted")
    rows = shield(kept)
    runs = repeated_runs(rows, min_words)
    doc = F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("h"))
    keyed = rows.withColumn("_doc", doc).withColumn("_key", key_of("_doc")).drop("_doc")
    joined = keyed.join(runs.withColumnRenamed("key", "_key").withColumnRenamed("runs", "_runs"), "_key", "left").drop("_key")
    names = [c for c in joined.columns if c not in ("text", "_runs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = [
                (None, 0, 0) if t is None else _cut(t, r) for t, r in zip(texts, batch.column("_runs").to_pylist(), strict=True)
            ]
            out = [batch.column(c) for c in names]
            new = pa.array([m[0] for m in made], pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                sizes = [None if m[0] is None else len(m[0]) for m in made]
                kept = out[i].to_pylist()
                out[i] = pa.array([k if m[2] == 0 else s for k, m, s in zip(kept, made, sizes, strict=True)], out[i].type)
            yield pa.RecordBatch.from_arrays(
                [*out, new, pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
                [*names, "text", "n_lines", "n_deleted"],
            )

    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names) + ", text string, n_lines bigint, n_deleted bigint"
    return joined.select(*names, "text", "_runs").mapInArrow(run, schema).select(*rows.columns, "n_lines", "n_deleted").toDF(*kept.columns, "n_lines", "n_deleted")
