"""Token ids as length-delimited binary records with a separate offset index.

A record is: length of the payload (8 bytes), masked checksum of these 8 bytes
(4 bytes), payload, masked checksum of the payload (4 bytes); numbers are little-
endian, checksums are CRC-32C, masked as rotated right by 15 bits plus a
constant, so that a checksum of data holding checksums stays strong. The payload
is one document's ids, two bytes each where the vocabulary allows it. The index
has a row per record (file, offset, length), so records can be read in any order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shield, text_of
from tidemark.llm.tokens import TOKENIZER, encoder, parts
from tidemark.session import scratch_path

# Fixed values of the format.
POLYNOMIAL, MASK_ADD = 0x82F63B78, 0xA282EAD8
HEAD, TAIL = 12, 4
LANE = 512
READ_BYTES = 1 << 20


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def _step(c: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _TABLE[(c ^ byte) & 0xFF] ^ (c >> np.uint32(8))


def _lane_shift() -> np.ndarray:
    """Four tables that move a checksum register past LANE zero bytes."""
    tables = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(LANE):
        tables = _step(tables, np.uint32(0))
    return tables


_SHIFT = _lane_shift()


def crc32c_many(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of data[start : start + size] for each pair.

    Records are cut into lanes of equal size, the first padded in front; all
    lanes advance together byte by byte and are then joined, which the linearity
    of the checksum allows.
    """
    out = np.zeros(len(starts), np.uint32)
    short = sizes < 4
    for i in np.flatnonzero(short):
        c = np.uint32(0xFFFFFFFF)
        for byte in data[starts[i] : starts[i] + sizes[i]]:
            c = _step(c, np.uint32(byte))
        out[i] = c
    held = np.flatnonzero(~short)
    if len(held):
        size = sizes[held]
        lanes = -(-size // LANE)
        ends = np.cumsum(lanes)
        padded = np.zeros(int(ends[-1]) * LANE, np.uint8)
        for i, s, n, e in zip(range(len(held)), starts[held], size, ends, strict=True):
            at = int(e) * LANE - int(n)
            padded[at : at + n] = data[s : s + n]
            padded[at : at + 4] ^= 0xFF  # the register starts with all bits set
        columns = np.ascontiguousarray(padded.reshape(-1, LANE).T)
        c = np.zeros(int(ends[-1]), np.uint32)
        for column in columns:
            c = _step(c, column)
        whole = np.zeros(len(held), np.uint32)
        first = ends - lanes
        order = np.argsort(-lanes, kind="stable")
        counts = lanes[order]
        for j in range(int(counts[0])):
            live = order[: np.searchsorted(-counts, -j, "left")]
            w = whole[live]
            moved = _SHIFT[0][w & 0xFF] ^ _SHIFT[1][(w >> 8) & 0xFF] ^ _SHIFT[2][(w >> 16) & 0xFF] ^ _SHIFT[3][w >> 24]
            whole[live] = moved ^ c[first[live] + j]
        out[held] = whole
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return ((((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF).astype(np.uint32)


def frame(payload: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the records of consecutive payloads, and where each record begins."""
    starts = np.cumsum(sizes) - sizes
    begin = np.cumsum(sizes + HEAD + TAIL) - (sizes + HEAD + TAIL)
    out = np.empty(int(sizes.sum()) + len(sizes) * (HEAD + TAIL), np.uint8)
    heads = np.frombuffer(sizes.astype("<u8").tobytes(), np.uint8)
    head_crc = masked(crc32c_many(heads, np.arange(len(sizes)) * 8, np.full(len(sizes), 8)))
    body_crc = masked(crc32c_many(payload, starts, sizes))
    out[begin[:, None] + np.arange(8)] = heads.reshape(-1, 8)
    out[begin[:, None] + np.arange(8, 12)] = np.frombuffer(head_crc.astype("<u4").tobytes(), np.uint8).reshape(-1, 4)
    tail = begin + HEAD + sizes
    out[tail[:, None] + np.arange(4)] = np.frombuffer(body_crc.astype("<u4").tobytes(), np.uint8).reshape(-1, 4)
    for b, s, n in zip(begin, starts, sizes, strict=True):
        out[b + HEAD : b + HEAD + n] = payload[s : s + n]
    return out, begin


def unframe(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, where: str) -> list[np.ndarray]:
    """Payloads of the records at ``begin``; raises where a length or checksum differs."""
    heads = np.ascontiguousarray(data[begin[:, None] + np.arange(HEAD)])
    length = heads[:, :8].copy().view("<u8").ravel().astype(np.int64)
    head_crc = heads[:, 8:].copy().view("<u4").ravel()
    flat = heads[:, :8].ravel()
    body_crc = np.ascontiguousarray(data[(begin + HEAD + sizes)[:, None] + np.arange(4)]).view("<u4").ravel()
    if (
        (length != sizes).any()
        or (masked(crc32c_many(flat, np.arange(len(sizes)) * 8, np.full(len(sizes), 8))) != head_crc).any()
        or (masked(crc32c_many(data, begin + HEAD, sizes)) != body_crc).any()
    ):
        raise ValueError(f"damaged record in {where}")
    return [data[b + HEAD : b + HEAD + n] for b, n in zip(begin, sizes, strict=True)]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, name: str = TOKENIZER, end_id: int = 2) -> DataFrame:
    """Encode every text, write one file per range of doc_id, return the index (stored beside the files).

    Files follow ascending doc_id (null first), as do records in a file. A file
    is written under a name of its own attempt and then moved in place, so a
    repeated task leaves the same file.

    Null text is empty: a record of the end id alone. Rows of one id follow
    their text; repeated rows are written as often as they occur; extra columns
    are not written; no rows give no file and an empty index.
    """
    files = folder + "/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = encoder(name)
        width = np.dtype("<u2") if words.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        system, root = _open(files)
        target = f"{root}/part-{part:05d}.rec"
        stream, mine, at, done = None, f"{target}.{uuid.uuid4().hex}", 0, 0
        for batch in batches:
            for rows in parts(batch):
                counts, ids = words.encode(rows.column("text"))
                full = counts + 1
                ends = np.cumsum(full)
                stored = np.full(int(ends[-1]), end_id, width)
                keep = np.ones(len(stored), bool)
                keep[ends - 1] = False
                stored[keep] = ids
                data, begin = frame(stored.view(np.uint8), full * width.itemsize)
                if stream is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(mine)
                stream.write(data.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(np.full(len(full), part), pa.int32()),
                        pa.array([f"{files}/part-{part:05d}.rec"] * len(full)), pa.array(at + begin, pa.int64()),
                        pa.array(full * width.itemsize, pa.int64()), pa.array(np.full(len(full), width.itemsize), pa.int32()),
                        pa.array(done + ends - full, pa.int64()),
                    ],
                    ["doc_id", "part", "file", "offset", "length", "width", "start_in_part"],
                )
                at += len(data)
                done += int(ends[-1])
        if stream is not None:
            stream.close()
            system.move(mine, target)

    rows = shield(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    index = ordered.mapInArrow(
        run, "doc_id long, part int, file string, offset long, length long, width int, start_in_part long"
    )
    index.write.mode("overwrite").parquet(folder + "/index")
    return docs.sparkSession.read.parquet(folder + "/index")


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row numbers, payloads) of the records of an index batch, a bounded piece of a file at a time."""
    files, width = np.asarray(batch.column("file").to_pylist(), object), batch.column("width").to_numpy()
    begin, size = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
    end = begin + size + HEAD + TAIL
    for file in sorted(set(files)):
        mine = np.flatnonzero(files == file)
        mine = mine[np.argsort(begin[mine], kind="stable")]
        system, path = _open(file)
        with system.open_input_file(path) as source:
            i = 0
            while i < len(mine):
                j = i + 1
                while j < len(mine) and end[mine[j]] - begin[mine[i]] <= READ_BYTES and begin[mine[j]] >= end[mine[j - 1]]:
                    j += 1
                rows = mine[i:j]
                data = np.frombuffer(source.read_at(int(end[rows[-1]] - begin[rows[0]]), int(begin[rows[0]])), np.uint8)
                found = unframe(data, begin[rows] - begin[rows[0]], size[rows], file)
                yield rows, [p.view(f"<u{width[r]}") for r, p in zip(rows, found, strict=True)]
                i = j


def read_records(index: DataFrame) -> DataFrame:
    """The records of ``index``: its columns and ``ids``, checked against length and checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids in _segments(batch):
                part = batch.take(pa.array(rows))
                lists = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "ids"])

    return index.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", ids array<bigint>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, ids in _segments(batch):
            part = batch.take(pa.array(rows))
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), part.column("start_in_part"),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )


def record_digests(index: DataFrame) -> DataFrame:
    """Per document, from the files: ids before it over all files, number of ids and checksum of them."""
    read = index.mapInArrow(_digests, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # One row per file: as many as partitions were asked for.
    totals = index.groupBy("part").agg(F.sum(F.col("length") / F.col("width")).cast("long").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return read.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_to_records(docs: DataFrame, name: str = TOKENIZER, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the records of ``docs`` below a shared folder, read them back and digest them."""
    target = folder or scratch_path(docs.sparkSession, "token-records")
    return record_digests(write_records(docs, target, name, end_id))
