"""Packed exchanges: what is hashed in one chunk of texts meets equal hashes from all other chunks.

A task turns a chunk of texts into entries (hash, place in the chunk, more).
Entries travel as one binary row for each chunk and partition, in byte planes,
about as many bytes as the hash has.  The receiving partition judges groups of
equal hashes and answers (chunk, place); a second, small exchange turns places
into marks of documents.  Nothing goes to the driver, and a group is met as
flat arrays, so its size costs no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small_batches
from .textscan import chunks, give_back, ids

BLOB, TABLE, REPLY = 0, 1, 2
ROW = "bucket int, kind int, chunk long, payload binary"
MARKS = "rid long, h long, marks binary"
U64 = np.uint64


@dataclass
class Entries:
    """first: place at which each text's places start; local: replies known without any exchange."""

    first: np.ndarray
    keys: np.ndarray
    places: np.ndarray
    more: list[np.ndarray] = field(default_factory=list)
    local: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def text_rows(docs: DataFrame) -> DataFrame:
    """rid (doc_id, the largest integer for null), doc_id, text, h: rows with equal rid and h are alike."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).max).cast("long")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def to_planes(matrix: np.ndarray) -> bytes:
    return matrix.T.tobytes()


def low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def wide(planes: np.ndarray) -> np.ndarray:
    """Integers of byte planes (width, n)."""
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : planes.shape[0]] = planes.T
    return out.view("<u8").ravel()


def packed(values: np.ndarray) -> bytes:
    """Sorted integers as planes of their differences."""
    return to_planes(low_bytes(np.diff(values, prepend=U64(0)), 8))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(wide(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1)), dtype=np.uint64)


def united(marks: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([unpacked(m) for m in marks])) if marks else np.zeros(0, np.uint64)


def pack(n: int, keys: np.ndarray, places: np.ndarray, more: list[np.ndarray], widths: tuple[int, ...]) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) of entries whose places ascend; widths: bytes of the key and of each further column."""
    if not len(keys):
        return
    bucket = ((keys & U64(0xFFFFFF)) % U64(n)).astype(np.uint32 if n > 65535 else np.uint16)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=n)
    ends = np.cumsum(counts)
    at = places[order].astype(np.uint64)
    gaps = np.diff(at, prepend=U64(0))
    heads = (ends - counts)[counts > 0]
    gaps[heads] = at[heads]
    key = keys[order]
    key = key if widths[0] == 8 else key >> U64(64 - 8 * widths[0])
    matrix = np.hstack([low_bytes(key, widths[0]), low_bytes(gaps, 5), *(low_bytes(m[order], w) for m, w in zip(more, widths[1:], strict=True))])
    for b in np.flatnonzero(counts):
        yield int(b), to_planes(matrix[ends[b] - counts[b] : ends[b]])


def unpack(raw: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Keys, places and further columns."""
    layout = (widths[0], 5, *widths[1:])
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(sum(layout), -1)
    ends = np.cumsum(layout)
    out = [wide(planes[e - s : e]) for s, e in zip(layout, ends, strict=True)]
    out[1] = np.cumsum(out[1], dtype=np.uint64)
    return out


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "chunk", "payload"])


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    n = len(sorted_columns[0])
    fresh = np.zeros(n, dtype=bool)
    if n:
        fresh[0] = True
        for c in sorted_columns:
            fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each run."""
    return zip(starts, [*starts[1:], n][: len(starts)], strict=True)


def exchange(rows: DataFrame, entries: Callable, judge: Callable, widths: tuple[int, ...]) -> DataFrame:
    """rid, h, marks (list of packed integers) of the documents that `judge` replied for.

    entries(batch, bytes, offsets) makes Entries; judge(columns) gets the
    columns of all entries of a partition (keys, chunk numbers, places, more)
    and returns the numbers of the entries it replies to, and their values
    place << 16 | low bits.
    """
    n = partitions(rows.sparkSession)

    def send(batches):
        for batch, data, offsets in chunks(batches):
            e = entries(batch, data, offsets)
            if not len(e.keys) and not len(e.local):
                continue
            rids, h = ids(batch, "rid"), batch.column("h").to_numpy(zero_copy_only=False)
            table = rids.tobytes() + h.tobytes() + e.first.astype(np.int64).tobytes()
            chunk = int.from_bytes(hashlib.blake2b(table, digest_size=8).digest(), "little", signed=True)
            home = chunk % n
            out = [(home, TABLE, chunk, table)]
            if len(e.local):
                out.append((home, REPLY, chunk, packed(np.unique(e.local))))
            out += [(b, BLOB, chunk, raw) for b, raw in pack(n, e.keys, e.places, e.more, widths)]
            yield as_rows(out)

    def meet(batches):
        chunk_ids, blobs = [], []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            known = batch.filter(pa.array(kinds != BLOB))
            if known.num_rows:
                yield known
            sent = batch.filter(pa.array(kinds == BLOB))
            chunk_ids += sent.column("chunk").to_pylist()
            blobs += [unpack(raw, widths) for raw in sent.column("payload").to_pylist()]
        if not blobs:
            return
        number = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b[0]) for b in blobs])
        columns = [np.concatenate([b[i] for b in blobs]) for i in range(len(blobs[0]))]
        del blobs
        hit, values = judge(columns[0], columns[1], *columns[2:])
        at = number[hit]
        order = np.lexsort((values, at))
        at, values = at[order], values[order]
        starts = runs(at)
        out = []
        for s, e in spans(starts, len(at)):
            chunk = chunk_ids[at[s]]
            out.append((chunk % n, REPLY, chunk, packed(np.unique(values[s:e]))))
            if len(out) == 512:
                yield as_rows(out)
                out = []
        yield as_rows(out)
        del columns, number, hit, values, at, order
        give_back()

    def spread(batches):
        tables, replies = {}, {}
        for batch in batches:
            for kind, chunk, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "payload")), strict=True):
                if kind == TABLE:
                    tables[chunk] = raw
                else:
                    replies.setdefault(chunk, []).append(raw)
        for chunk, got in replies.items():
            table = np.frombuffer(tables[chunk], dtype=np.int64)
            m = (len(table) - 1) // 3
            rids, h, first = table[:m], table[m : 2 * m], table[2 * m :]
            values = united(got)
            text = np.searchsorted(first, (values >> U64(16)).astype(np.int64), side="right") - 1
            values = values - (first[text].astype(np.uint64) << U64(16))
            starts = runs(text)
            of = text[starts]
            raws = [packed(values[s:e]) for s, e in spans(starts, len(values))]
            yield pa.RecordBatch.from_arrays([pa.array(rids[of]), pa.array(h[of]), pa.array(raws, pa.binary())], names=["rid", "h", "marks"])

    sent = rows.mapInArrow(send, ROW).repartitionById(n, F.col("bucket")).mapInArrow(meet, ROW)
    marks = sent.repartitionById(n, F.col("bucket")).mapInArrow(spread, MARKS)
    return marks.groupBy("rid", "h").agg(F.collect_list("marks").alias("marks"))


def marks_of(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [united(m) for m in batch.column(column).to_pylist()]


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `length` places lie in some range [start, end)."""
    delta = np.zeros(length + 1, dtype=np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
