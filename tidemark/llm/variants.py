"""Spelling variants: words one insertion, deletion or replacement apart, by PartEnum signatures.

A word is the set of its (letter, occurrence) elements: 'noon' is n1, o1, o2, n2.
One inserted or deleted letter changes that set by one element, a replaced one by
two, so near words have sets of Hamming distance ``DISTANCE`` or less. PartEnum
turns that into equal keys without losing a pair: the elements are dealt to
``FIRST`` parts, of which one at least differs by no more than its share of the
distance, and each part to ``SECOND`` pieces; a signature keeps all pieces of a
part but as many as that share. Whoever is near agrees in one signature, and, as
the edit is in one place, in the first or in the last ``SIDE`` letters too; so each
signature is made twice, with either end. Pairs that agree are verified by their
edit distance.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shield, text_of
from tidemark.session import persist_table, ship_package

DISTANCE = 2
FIRST, SECOND = 1, 6
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 6, 5, 5
# An edit leaves the first or the last half of the shortest word alone.
SIDE = MIN_LETTERS // 2
# One occurrence in so many loses a letter.
ERROR_RATE = 199
CHUNK_BYTES = 4 << 20
# Runs of up to so many bytes get their checksum from a table, longer ones one by one.
TABLE_BYTES = 48
_GOLD = np.uint64(0x9E3779B97F4A7C15)

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ZERO_BYTE = np.array([zlib.crc32(b"\0", i ^ 0) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a letter; U+00C0 to U+00FF are C3 and one byte more."""
    lead = data == 0xC3
    held = _LETTER[data] | lead
    held[1:] |= lead[:-1]
    return held


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``data`` of about ``CHUNK_BYTES`` that end outside of runs or with a text."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop, size = end, CHUNK_BYTES
        while at + size < end:
            held = _letters(data[at : at + size])
            gap = np.flatnonzero(~held)
            border = offsets[np.searchsorted(offsets, at + size, "right") - 1]
            cut = max(at + int(gap[-1]) + 1 if len(gap) else at, int(border))
            if cut > at:
                stop = cut
                break
            size *= 2
        yield at, stop
        at = stop


def _head_checks(heads: list[bytes], longest: int) -> np.ndarray:
    """Part of the checksum of head + run that the head gives, by the length of the run."""
    table = np.zeros((len(heads), longest + 1), np.uint32)
    table[:, 0] = [zlib.crc32(h) for h in heads]
    for j in range(longest):
        table[:, j + 1] = _ZERO_BYTE[table[:, j] & 255] ^ (table[:, j] >> 8)
    return table


def _heads(ids: pa.Array) -> list[bytes]:
    return [b":" if i is None else b"%d:" % i for i in ids.to_pylist()]


def _runs(data: np.ndarray, offsets: np.ndarray, at: int, stop: int) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of ``data[at:stop]`` and the text of each."""
    part = data[at:stop]
    held = _letters(part)
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    inner = offsets[(offsets > at) & (offsets < stop)] - at
    begins[inner] = held[inner]
    starts = np.flatnonzero(begins)
    places = np.cumsum(held) - 1
    ends = np.append(places[starts], int(held.sum())).astype(np.int32)
    letters = _LOWER[part[held]]
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters))
    return runs, np.searchsorted(offsets, starts + at, "right") - 1


def spoilt_counts(ids: pa.Array, texts: pa.Array) -> tuple[list[str], list[int]]:
    """Words of ``MIN_LETTERS`` code points or more and how often they come out of the texts, letters lost included."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    heads, words, counts = _heads(ids), [], []
    for at, stop in _pieces(data, offsets):
        runs, of = _runs(data, offsets, at, stop)
        if not len(runs):
            continue
        coded = runs.dictionary_encode()
        which, plain = coded.indices.to_numpy(), coded.dictionary
        size = pc.binary_length(plain).to_numpy()
        own = np.array([zlib.crc32(w) for w in plain.cast(pa.binary()).to_pylist()], np.uint32)
        first, last = int(of[0]), int(of[-1])
        checks = _head_checks(heads[first : last + 1], TABLE_BYTES)
        length = size[which]
        crc = own[which] ^ checks[of - first, np.minimum(length, TABLE_BYTES)]
        for i in np.flatnonzero(length > TABLE_BYTES):
            crc[i] = zlib.crc32(plain[int(which[i])].as_py().encode(), zlib.crc32(heads[of[i]]))
        spoilt = crc % np.uint32(ERROR_RATE) == 0
        letters = pc.utf8_length(plain).to_numpy()
        n = np.bincount(which[~spoilt], minlength=len(plain))
        keep = np.flatnonzero((n > 0) & (letters >= MIN_LETTERS))
        words += plain.take(pa.array(keep)).to_pylist()
        counts += n[keep].tolist()
        for i in np.flatnonzero(spoilt & (letters[which] > MIN_LETTERS)):
            word = plain[int(which[i])].as_py()
            gone = int(crc[i]) % len(word)
            words.append(word[:gone] + word[gone + 1 :])
            counts.append(1)
    return words, counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = spoilt_counts(batch.column("doc_id"), batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``: maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, some misspelt.

    Where ``ERROR_RATE`` divides the CRC-32 of '<doc_id>:<run>' (a null doc_id is
    empty there), the run loses the code point at checksum modulo length. Kept are
    words of at least ``MIN_LETTERS`` code points and ``MIN_COUNT`` occurrences.
    """
    rows = shield(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = rows.mapInArrow(_count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(words: list[str], first: int = FIRST, second: int = SECOND, distance: int = DISTANCE) -> np.ndarray:
    """PartEnum signatures, a row per word: equal in one place at least for near words of ``2 * SIDE`` letters or more."""
    share = -(-(distance + 1) // first) - 1
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], np.int64)
    of = np.repeat(np.arange(len(words)), length)
    begin = np.cumsum(length) - length
    ends = [np.zeros(len(words), np.uint64), np.ones(len(words), np.uint64)]
    with np.errstate(over="ignore"):
        for j in range(SIDE):
            for end, at in zip(ends, (begin + j, begin + length - 1 - j), strict=True):
                end[:] = _mix(end * _GOLD + points[at])
    order = np.lexsort((points, of))
    points, of = points[order], of[order]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(new)
    turn = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    with np.errstate(over="ignore"):
        element = _mix(points * _GOLD + turn.astype(np.uint64))
        place = (_mix(element + _GOLD) % np.uint64(first * second)).astype(np.int64)
        sums = np.zeros((len(words), first * second), np.uint64)
        np.add.at(sums, (of, place), element)
        sums = _mix(sums + np.arange(first * second, dtype=np.uint64) * _GOLD)
        made = []
        for part in range(first):
            for kept in itertools.combinations(range(second), second - share):
                total = sums[:, [part * second + p for p in kept]].sum(axis=1, dtype=np.uint64)
                made += [_mix(end * _GOLD + total + np.uint64(len(made) + 1)) for end in ends]
    return np.stack(made, axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        if words:
            marks = signatures(words)
            marks = pa.ListArray.from_arrays(np.arange(0, marks.size + 1, marks.shape[1], dtype=np.int32), pa.array(marks.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), marks], ["word", "n", "marks"])


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that Spark never broadcasts, whatever size it expects.

    Its estimates do not know that ``explode`` makes thirty rows of one nor how far a word table
    unfolds from its file, so a table just under the broadcast threshold would fill the driver.
    """
    return df.hint("merge")


def near(a: Column, b: Column) -> Column:
    """One inserted, deleted or replaced code point apart, exactly."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """Both directions of every pair of near words: ``word``, ``n``, ``other``, ``other_n``.

    ``words`` has distinct ``word`` and ``n``. The join meets words that share a
    signature: three letters at one end and all but two pieces of the others.
    """
    signed = words.mapInArrow(_sign, "word string, n bigint, marks array<bigint>").select("word", "n", F.explode("marks").alias("mark"))
    left = signed.select("mark", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.select("mark", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = left.join(by_shuffle(right), "mark").filter((F.col("a") < F.col("b")) & near(F.col("a"), F.col("b")))
    pairs = met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    ))
    return pairs.select(sides.alias("side")).select("side.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where following ``form`` from word to word ends.

    Every form is ``FORM_RATIO`` times as frequent as its word, so paths are short
    and free of circles; each round doubles the steps taken.
    """
    known = persist_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = known.join(by_shuffle(onward), "root", "left")
        known = persist_table(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.filter("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each word of ``docs``; see ``word_counts``.

    A word's form is its near word of largest count (ties: smallest in code-point
    order) if that count is ``FORM_RATIO`` times its own or more, else null; the
    root is where forms lead, the word itself without any. Null and empty texts
    have no words; texts are read whole, in pieces cut between runs, so their
    length does not matter; repeated rows count again; extra columns are not
    looked at; no rows give no words.
    """
    ship_package(docs.sparkSession)
    words = persist_table(word_counts(docs), "words")
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    seen = pairs.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    seen = persist_table(seen.select("word", "n", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")), "near-words")
    forms = seen.filter(F.col("other_n") >= FORM_RATIO * F.col("n")).select("word", F.col("other").alias("form"), F.col("other_n").alias("form_n"))
    known = words
    for side in (seen.select("word", "n_near"), forms, roots(forms)):
        known = known.join(by_shuffle(side), "word", "left")
    return known.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
