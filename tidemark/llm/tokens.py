"""Token counts of whole texts, exactly as the tokenizer library gives them.

The tokenizer drops white space before it splits, so words between ASCII spaces
are encoded independently of each other: each distinct word goes through the
library once per worker and is looked up afterwards.

Huge documents take overlap resynchronisation: overlapping chunks are encoded
with offsets, and two neighbours are spliced at a boundary that both have and
that is proven stable (see ``common_boundary``); where none is found the overlap
is widened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shield, text_of

TOKENIZER = "word_bpe_49k.json"
# Texts longer than this many characters are encoded in overlapping chunks.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256
# Distinct words, and letters of them, that a worker remembers; beyond, it forgets those met in one batch only.
# Results do not depend on it.
MEMO_WORDS, MEMO_LETTERS = 800_000, 16_000_000
# Rows and bytes of text encoded at once; a longer text is a part of its own.
BATCH_ROWS, BATCH_BYTES = 3_000, 12 << 20
SPACES = " \t\n\x0b\x0c\r"


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` of ``text``."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] + BATCH_BYTES, "right")) - 1
        end = max(at + 1, min(end, at + BATCH_ROWS, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end


def load(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


class WordEncoder:
    """Ids of texts, with every distinct space-separated word encoded once."""

    def __init__(self, name: str, limit: int = MEMO_WORDS):
        self.tokenizer, self.limit = load(name), limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.batches = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the words met in several batches since the last time, half the limit at most."""
        often = np.flatnonzero(self.batches > 1)
        if len(often) > self.limit // 2:
            often = np.sort(often[np.argsort(-self.batches[often], kind="stable")[: self.limit // 2]])
        place = np.full(len(self.lengths), -1, np.int64)
        place[often] = np.arange(len(often))
        self.known = {w: int(place[i]) for w, i in self.known.items() if place[i] >= 0}
        self.letters = sum(map(len, self.known))
        if self.letters > MEMO_LETTERS // 2:
            return self._clear()
        size, first = self.lengths[often], (np.cumsum(self.lengths) - self.lengths)[often]
        upto = np.cumsum(size)
        self.ids = self.ids[np.repeat(first - (upto - size), size) + np.arange(int(size.sum()))]
        self.lengths, self.batches = size, np.zeros(len(often), np.int32)

    def _keys(self, words: pa.Array) -> pa.Array:
        # The normalizer lowers letters; a marker of the vocabulary is matched before that, so such words stay.
        lowered = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        return pc.if_else(lowered, pc.ascii_lower(words), words)

    def _learn(self, words: list[str]) -> None:
        lengths, ids = [], []
        # Words of a part are told apart by a digit between them: always one id of its own, absent from the words.
        plain = [w for w in words if "0" not in w and "<|" not in w]
        odd = [w for w in words if "0" in w or "<|" in w]
        (mark,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            (made,) = self.tokenizer.encode_batch_fast([" 0 ".join([*part, ""])], add_special_tokens=False)
            got = np.array(made.ids, np.uint32)
            ends = np.flatnonzero(got == mark)
            if len(ends) != len(part):
                raise ValueError("words could not be told apart")
            lengths.append(np.diff(ends, prepend=-1) - 1)
            ids.append(np.delete(got, ends))
        for made in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False):
            lengths.append(np.array([len(made.ids)]))
            ids.append(np.array(made.ids, np.uint32))
        for w in [*plain, *odd]:
            self.known[w] = len(self.known)
            self.letters += len(w)
        self.lengths = np.concatenate([self.lengths, *lengths]).astype(np.int64)
        self.ids = np.concatenate([self.ids, *ids]).astype(np.uint32)

    def _entries(self, words: pa.Array) -> np.ndarray:
        keys = self._keys(words).to_pylist()
        if len(self.known) > self.limit or self.letters > MEMO_LETTERS:
            self._forget()
        places = list(map(self.known.get, keys))
        new = list(dict.fromkeys(k for k, p in zip(keys, places) if p is None))
        if new:
            self._learn(new)
            places = [self.known[k] if p is None else p for k, p in zip(keys, places)]
        entry = np.array(places, np.int64)
        self.batches = np.concatenate([self.batches, np.zeros(len(self.lengths) - len(self.batches), np.int32)])
        self.batches[np.unique(entry)] += 1
        return entry

    def split(self, texts: pa.Array) -> pa.Array:
        """Lists of the words of each text."""
        return pc.ascii_split_whitespace(texts)

    def encode(self, texts: pa.Array, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each text and, on request, all ids one text after the other. No nulls."""
        split = self.split(texts)
        bounds = split.offsets.to_numpy()
        flat = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        entry = self._entries(flat.dictionary)
        if len(entry) == 0:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        word = entry[flat.indices.to_numpy()]
        size = self.lengths[word]
        upto = np.concatenate([[0], np.cumsum(size)])
        counts = upto[bounds[1:] - bounds[0]] - upto[bounds[:-1] - bounds[0]]
        if not with_ids:
            return counts, None
        first = (np.cumsum(self.lengths) - self.lengths)[word]
        spots = np.repeat(first - upto[:-1], size) + np.arange(upto[-1])
        return counts, self.ids[spots]


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """The worker's encoder: tasks that follow on the same worker reuse what it has learnt."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def _piece(tokenizer, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of text[start:end] and their (start, end) offsets in the text."""
    made = tokenizer.encode(text[start:end], add_special_tokens=False)
    spans = np.array(made.offsets, np.int64).reshape(-1, 2) + start
    return np.array(made.ids, np.uint32), spans


def common_boundary(text: str, low: int, high: int, a: tuple, b: tuple) -> int | None:
    """A place in (low, high) where tokenizations ``a`` and ``b`` may be spliced.

    Proof: white space is never part of a token and neither normalization nor
    pre-tokenization looks across it, so what follows a white-space character is
    encoded alike whatever precedes it, provided that the chunk starts before
    the word. As a check of that claim both must have no token across the place
    and the same tokens from there to the last white space before ``high``.
    """
    spots = [p for p in range(low + 1, high) if text[p - 1] in SPACES]
    if len(spots) < 2:
        return None
    last = spots[-1]
    for p in spots[: len(spots) // 2 + 1]:
        if p >= last or text[p] in SPACES:
            continue
        parts = []
        for ids, spans in (a, b):
            if ((spans[:, 0] < p) & (spans[:, 1] > p)).any():
                break
            inside = (spans[:, 0] >= p) & (spans[:, 1] <= last)
            parts.append((ids[inside], spans[inside]))
        if len(parts) == 2 and np.array_equal(parts[0][0], parts[1][0]) and np.array_equal(parts[0][1], parts[1][1]):
            return p
    return None


def encode_long(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """Ids of a text of any length from overlapping chunks; equal to encoding it whole."""
    kept: list[np.ndarray] = []
    start, end = 0, min(len(text), chunk)
    left = _piece(tokenizer, text, start, end)
    begun = 0  # ids of ``left`` before this place are taken already
    while end < len(text):
        width, place = overlap, None
        while place is None:
            at = max(start, end - width)
            stop = min(len(text), at + max(chunk, 2 * width))
            right = _piece(tokenizer, text, at, stop)
            place = common_boundary(text, at, end, left, right) if stop > end else None
            if place is not None and place <= begun:
                place = None
            if place is None and at == start:
                # The overlap is all of the left chunk: the longer chunk, which starts where it does, replaces it.
                break
            width *= 2
        ids, spans = left
        if place is None:
            left, end = right, stop
            chunk = max(chunk, 2 * (stop - at))
            continue
        kept.append(ids[(spans[:, 0] >= begun) & (spans[:, 0] < place)])
        left, start, end, begun = right, at, stop, place
    ids, spans = left
    kept.append(ids[spans[:, 0] >= begun])
    return np.concatenate(kept)


def count_tokens(
    docs: DataFrame, name: str = TOKENIZER, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row of ``docs``.

    No begin, end or added special tokens; special strings inside a text count
    as the library counts them by default; nothing is truncated. Null text is
    empty and has no tokens. Repeated rows give repeated results, a null id stays
    null; extra columns are not returned; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(name)
        for batch in batches:
            for part in parts(batch):
                texts = part.column("text")
                huge = np.flatnonzero(np.asarray(pc.greater(pc.utf8_length(texts), chunk)))
                if len(huge):
                    mask = np.ones(len(texts), bool)
                    mask[huge] = False
                    short = pc.if_else(pa.array(mask), texts, pa.scalar("", texts.type))
                else:
                    short = texts
                counts, _ = words.encode(short, with_ids=False)
                for i in huge:
                    counts[i] = len(encode_long(words.tokenizer, texts[int(i)].as_py(), chunk, overlap))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    rows = shield(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
