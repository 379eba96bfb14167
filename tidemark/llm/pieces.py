"""Encoding and decoding with a SentencePiece BPE model by suffix-array matching.

The new words of a batch are concatenated and their suffixes sorted; every piece
of the model finds its occurrences as one range of the suffix array, by binary
search. The occurrences, sorted by position, are the edges of a lattice over the
text. The model is a BPE model, whose segmentation is not the path of the best
total score: relaxing repeatedly contracts the best-ranked edge that spans two
neighbouring symbols, the leftmost of equal ones, in all words at once. The
result equals the library's.

Words are the text between two spaces, and no piece of the model crosses from
one into the next (checked at loading), so every distinct word is encoded once
per worker. Characters that no piece covers fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shield, text_of
from tidemark.llm.tokens import WordEncoder

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMO_WORDS = 150_000
BATCH_ROWS = 500
# Characters indexed at once, and the length from which a word takes the queue instead of the rounds.
INDEX_CHARS, LONG_WORD = 200_000, 200
_UNITS = re.compile(" +[^ ]*")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` codes (or a little more), by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        ahead = np.zeros(len(codes), np.int64)
        ahead[: max(len(codes) - width, 0)] = rank[width:] + 1
        rank = np.unique(rank * (len(codes) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable")


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range [low, high) of each piece in the suffix array; ``pieces`` is padded with zeros to equal length."""
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
    for d in range(pieces.shape[1]):
        live = np.flatnonzero((sizes > d) & (low < high))
        if not len(live):
            break
        want = pieces[live, d]
        bounds = []
        for side in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                middle = (a + b) // 2
                at = order[np.minimum(middle, len(order) - 1)] + d
                seen = np.where(at < len(codes), codes[np.minimum(at, len(codes) - 1)], 0)
                before = open_ & ((seen <= want) if side else (seen < want))
                a = np.where(before, middle + 1, a)
                b = np.where(open_ & ~before, middle, b)
            bounds.append(a)
        low[live], high[live] = bounds
    return low, high


class PieceEncoder(WordEncoder):
    def __init__(self, name: str = MODEL, limit: int = MEMO_WORDS):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)) or any(SPACE in t.lstrip(SPACE) for t, s, b in zip(texts, special, byte, strict=True) if not s and not b):
            raise ValueError("the model has pieces across spaces or unused pieces")
        self.limit = limit
        self.numbers = np.array([i for i in range(n) if not special[i] and not byte[i]])
        self.byte_ids = np.zeros(256, np.uint32)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(texts[i][1:-1], 16)] = i
        sizes = [len(texts[i]) for i in self.numbers]
        self.sizes, self.depth = np.array(sizes), max(sizes)
        # Code 0 separates words, so characters are counted from 1.
        self.pieces = np.zeros((len(self.numbers), self.depth), np.int64)
        for k, i in enumerate(self.numbers):
            self.pieces[k, : sizes[k]] = [ord(c) + 1 for c in texts[i]]
        score = np.array([model.get_score(int(i)) for i in self.numbers])
        self.rank = np.unique(-score, return_inverse=True)[1]
        self.single = {texts[i]: i for i in self.numbers if len(texts[i]) == 1}
        self.written = [
            b"" if special[i] else bytes([int(texts[i][1:-1], 16)]) if byte[i] else texts[i].replace(SPACE, " ").encode() for i in range(n)
        ]
        self._clear()

    def _keys(self, words: pa.Array) -> pa.Array:
        # This model tells capitals from small letters.
        return words

    def split(self, texts: pa.Array) -> pa.Array:
        """Words with the run of spaces before them; a plain word stands for one space and the word."""
        plain = pc.replace_substring(texts, SPACE, " ")
        runs = pc.or_(pc.match_substring(plain, "  "), pc.or_(pc.starts_with(plain, " "), pc.ends_with(plain, " ")))
        lists = pc.split_pattern(pc.if_else(runs, pa.scalar("", plain.type), plain), " ")
        # Other texts are few: those with runs of spaces get their own lists, empty ones none.
        odd, empty = np.asarray(runs), np.asarray(pc.equal(plain, ""))
        if not odd.any() and not empty.any():
            return lists
        own = {int(i): self._units(plain[int(i)].as_py()) for i in np.flatnonzero(odd)} | {int(i): [] for i in np.flatnonzero(empty)}
        parts, at = [], 0
        for i in sorted(own):
            parts += [lists.slice(at, i - at), pa.array([own[i]], lists.type)]
            at = i + 1
        return pa.concat_arrays([*parts, lists.slice(at)])

    @staticmethod
    def _units(text: str) -> list[str]:
        return [u[1:] if u[1:2] != " " and len(u) > 1 else u for u in _UNITS.findall(" " + text)]

    def _learn(self, words: list[str]) -> None:
        lengths, ids = [], []
        at = 0
        while at < len(words):
            end, total = at, 0
            while end < len(words) and (end == at or total + len(words[end]) < INDEX_CHARS):
                total += len(words[end]) + 2
                end += 1
            size, made = self._segment(words[at:end])
            lengths.append(size)
            ids.append(made)
            at = end
        for w in words:
            self.known[w] = len(self.known)
        self.lengths = np.concatenate([self.lengths, *lengths]).astype(np.int64)
        self.ids = np.concatenate([self.ids, *ids]).astype(np.uint32)

    def _segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids per word and all ids."""
        # A word that begins with a space, or is one, carries its spaces; any other has one before it.
        full = [(w if w[:1] == " " else " " + w).replace(" ", SPACE) for w in words]
        size = np.array([len(w) for w in full])
        text = "\0".join(full) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        begin = np.cumsum(size + 1) - (size + 1)
        codes[begin + size] = 0
        order = suffix_array(codes, self.depth)
        low, high = occurrences(codes, order, self.pieces, self.sizes)
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        spots = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        # Edges by position and length: the piece that covers text[pos : pos + length].
        edges = np.full((len(codes), self.depth + 1), -1, np.int32)
        edges[spots, self.sizes[piece]] = piece
        long = np.flatnonzero(size > LONG_WORD)
        short = np.flatnonzero(size <= LONG_WORD)
        word, start, stop = self._contract(edges, short, begin, size)
        if len(long):
            parts = [(word, start, stop)]
            for i in long:
                s, e = self._queue(edges, int(begin[i]), int(begin[i] + size[i]))
                parts.append((np.full(len(s), i), s, e))
            word, start, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(start, kind="stable")
            word, start, stop = word[by], start[by], stop[by]
        found = edges[start, stop - start]
        number = np.where(found >= 0, self.numbers[found], 0)
        bare = np.flatnonzero(found < 0)
        if not len(bare):
            return np.bincount(word, minlength=len(words)), number
        spelled = {i: self.byte_ids[np.frombuffer(chr(int(codes[start[i]]) - 1).encode("utf-8", "surrogatepass"), np.uint8)] for i in bare}
        many = np.ones(len(word), np.int64)
        many[bare] = [len(spelled[i]) for i in bare]
        out = np.repeat(number, many)
        first = np.cumsum(many) - many
        for i in bare:
            out[first[i] : first[i] + many[i]] = spelled[i]
        return np.bincount(word, weights=many, minlength=len(words)).astype(np.int64), out

    def _contract(self, edges: np.ndarray, which: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Rounds over all words: each contracts its best edge over two neighbouring symbols."""
        n = size[which]
        word = np.repeat(which, n)
        start = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        stop = start + 1
        done = []
        big = np.int64(1) << 40
        while len(word):
            joined = np.zeros(len(word), np.int64)
            joined[:-1] = stop[1:] - start[:-1]
            near = np.zeros(len(word), bool)
            near[:-1] = (word[1:] == word[:-1]) & (joined[:-1] <= self.depth)
            piece = np.where(near, edges[start, np.where(near, joined, 0)], -1)
            value = np.where(piece >= 0, self.rank[piece] * np.int64(1 << 32) + np.arange(len(word)), big << 20)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(value, heads)
            moves = best < (big << 20)
            extent = np.diff(np.append(heads, len(word)))
            still = np.repeat(moves, extent)
            done.append((word[~still], start[~still], stop[~still]))
            left = best[moves] & np.int64((1 << 32) - 1)
            stop[left] = stop[left + 1]
            still[left + 1] = False
            word, start, stop = word[still], start[still], stop[still]
        word, start, stop = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        by = np.argsort(start, kind="stable")
        return word[by], start[by], stop[by]

    def _queue(self, edges: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, with a priority queue."""
        n = end - begin
        stop = list(range(1, n + 1))
        prev, alive = list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = stop[a]
            if b < n and stop[b] - a <= self.depth:
                piece = edges[begin + a, stop[b] - a]
                if piece >= 0:
                    heapq.heappush(heap, (int(self.rank[piece]), a, stop[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, e = heapq.heappop(heap)
            b = stop[a]
            if not alive[a] or b >= n or stop[b] != e:
                continue
            alive[b] = False
            stop[a] = e
            if e < n:
                prev[e] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        starts = np.flatnonzero(alive)
        return starts + begin, np.array(stop, np.int64)[starts] + begin

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: pieces and bytes joined, spaces restored, the space added in front removed."""
        text = b"".join(map(self.written.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_encoders: dict[str, PieceEncoder] = {}


def encoder(name: str = MODEL) -> PieceEncoder:
    if name not in _encoders:
        _encoders[name] = PieceEncoder(name)
    return _encoders[name]


def _batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    codec = encoder(name)
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            counts, ids = codec.encode(part.column("_text"))
            yield part, np.concatenate([[0], np.cumsum(counts)]), ids


def encode_documents(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """``doc_id`` and ``ids`` of every text. Null text is empty and has no ids; a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds, ids in _batches(batches, name):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    rows = shield(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` from ``ids``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(name)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def piece_digests(docs: DataFrame, name: str = MODEL) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_pieces``, ``ids_crc32`` and ``restored`` for every row of ``docs``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers;
    ``restored`` says that decoding gives the text back, but that the model
    writes its space mark as a space. Null text is empty. Repeated rows give
    repeated results; extra columns are not returned; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(name)
        for part, bounds, ids in _batches(batches, name):
            texts = part.column("_text").to_pylist()
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            same = [
                codec.decode(ids[a:b]) == t.replace(SPACE, " ") for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.cast(pc.binary_length(part.column("_text")), pa.int64()),
                 pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)],
                ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "restored"],
            )

    rows = shield(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_pieces bigint, ids_crc32 bigint, restored boolean")
