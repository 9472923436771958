"""Suffix-array dedup by prefix-free parsing, distributed.

A rolling hash of 12 bytes triggers phrase starts: a place is one if its hash is
the smallest (the last of equal ones) in some window of SPAN places.  The first
SPAN bytes of any string hold the trigger of the window that starts with it, so
equal strings have that trigger at the same place, phrases are bounded, and no
string is without one.  The dictionary holds what follows a trigger for `core`
bytes: a string of the width asked for holds the whole entry of its trigger, so
it repeats only if the entry does.  Entries that repeat are ordered by entry and
by what stands left and right of them.  Where the whole surroundings of two
triggers (all strings that belong to them) agree, all these strings repeat at
once; only where surroundings of one entry differ, at edges of repeats, the
strings are met singly.

The order is one of 64-bit hashes: equal suffixes stand together in it, as in a
suffix array, but it isn't lexicographic.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Entries, exchange, marks_of, runs, text_rows, texts_of, unpacked
from .shared import written
from .textscan import U64, byte_rolling

GRAM, SPAN, CORE, PASSAGE = 12, 64, 240, 256


def _classes(keys, more, counts):
    """Order by (key, more); starts of classes, their counts, and starts of groups among classes."""
    order = np.lexsort((more, keys))
    starts = runs(keys[order], more[order])
    totals = np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)
    return order, starts, totals


def _with_local(first, keys, places, more, values) -> Entries:
    """Entries in which a class that this chunk holds twice is settled here and sent once, as two."""
    if not len(keys):
        return Entries(first, keys, places, [more])
    order, starts, totals = _classes(keys, more, np.ones(len(keys), np.int64))
    twice = np.zeros(len(keys), dtype=bool)
    twice[order] = np.repeat(totals > 1, np.diff([*starts, len(keys)]))
    speaker = np.zeros(len(keys), dtype=bool)
    speaker[order[starts[totals > 1]]] = True
    sent = ~twice | speaker
    return Entries(first, keys[sent], (places * 2 + speaker)[sent], [more[sent]], values[twice])


def triggers(data: np.ndarray, offsets: np.ndarray, width: int, roll, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triggers with the first and last start of the strings of `width` bytes that belong to each; asked: only these starts count."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none
    at = np.arange(len(data) - GRAM + 1)
    # The smallest hash, then the last place, of each window: minima over 1, 2, 4, ... places.
    least = roll.raw(at, at + GRAM) * U64(0xD6E8FEB86659FD93) & ~U64(0xFFFFFFFF) | (U64(0xFFFFFFFF) - at.astype(np.uint64))
    for k in range(SPAN.bit_length() - 1):
        np.minimum(least[: -(1 << k)], least[1 << k :], out=least[: -(1 << k)])
    room = np.zeros(len(data) + 1, dtype=np.int8)
    long = np.flatnonzero(np.diff(offsets) >= width)
    np.add.at(room, offsets[long], 1)
    np.add.at(room, offsets[long + 1] - width + 1, -1)
    usable = np.cumsum(room[:-1], dtype=np.int8) > 0
    start = np.flatnonzero(usable if asked is None else usable & asked)
    t = (U64(0xFFFFFFFF) - (least[start] & U64(0xFFFFFFFF))).astype(np.int64)
    heads = runs(t, start - np.arange(len(start)))
    return t[heads], start[heads], start[np.append(heads[1:], len(t)) - 1] if len(t) else none


def parse(rows: DataFrame, width: int, within: int = 0) -> DataFrame:
    """Marks of triggers whose entry of the dictionary repeats: all strings that belong to them do too, or (edge) must be met singly.

    A mark is trigger << 16 | (trigger - first start) << 8 | (trigger - last start) << 1 | edge.
    within: rows have marks and singles of this smaller width; a string repeats only if all the smaller ones in it do.
    """
    core = core_of(width)

    def inner(batch, offsets):
        """Starts at which, and up to width - within bytes later, strings of the smaller width repeat."""
        delta = np.zeros(int(offsets[-1]) + 1, np.int32)
        for marks, singles, place in zip(batch.column("marks").to_pylist(), batch.column("singles").to_pylist(), offsets.tolist(), strict=False):
            first, last = ranges(marks, singles)
            np.add.at(delta, first + place, 1)
            np.add.at(delta, last + place + 1, -1)
        known = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
        end = np.minimum(np.arange(len(known) - 1) + width - within + 1, len(known) - 1)
        return known[end] - known[:-1] == width - within + 1

    def entries(batch, data, offsets):
        roll = byte_rolling(data)
        t, lo, hi = triggers(data, offsets, width, roll, inner(batch, offsets) if within else None)
        where = ((t - lo) << 8 | (t - hi) << 1).astype(np.uint64)
        around = roll.of(lo, hi + width) & ~U64(0xFFFF) | where
        return _with_local(offsets, roll.of(t, t + core), t, around, t.astype(np.uint64) << U64(16) | where)

    def judge(keys, places, more):
        twice, at = (places & U64(1)).astype(np.int64), places >> U64(1)
        order, starts, totals = _classes(keys, more, 1 + twice)
        sizes = np.diff([*starts, len(keys)])
        repeats = order[np.repeat(totals > 1, sizes)]
        repeats = repeats[twice[repeats] == 0]
        groups = runs(keys[order[starts]])
        several = np.repeat(np.diff([*groups, len(starts)]) > 1, np.diff([*groups, len(starts)]))
        edges = order[starts[several]]
        value = lambda i: at[i] << U64(16) | more[i] & U64(0xFFFE)
        return np.concatenate([repeats, edges]), np.concatenate([value(repeats), value(edges) | U64(1)])

    return exchange(rows, entries, judge, (5, 8))


def core_of(width: int) -> int:
    """Bytes of an entry of the dictionary."""
    if width < SPAN + GRAM:
        raise ValueError(f"strings of under {SPAN + GRAM} bytes are too short for windows of {SPAN} places")
    return min(CORE, width - SPAN + 1)


def _starts(marks: np.ndarray) -> np.ndarray:
    """All starts that marks stand for."""
    t, low = (marks >> U64(16)).astype(np.int64), (marks & U64(0xFFFF)).astype(np.int64)
    first, size = t - (low >> 8), (low >> 8) - (low >> 1 & 0x7F) + 1
    last = np.cumsum(size)
    return np.arange(last[-1] if len(last) else 0) - np.repeat(last - size, size) + np.repeat(first, size)


def single_starts(rows: DataFrame, width: int) -> DataFrame:
    """Marks (start << 16) of starts at edges that repeat; rows have marks of `parse`."""

    def entries(batch, data, offsets):
        found = [np.zeros(0, np.int64)]
        for i, marks in enumerate(marks_of(batch, "marks")):
            s = np.unique(_starts(marks[(marks & U64(1)) > 0]))
            found.append(s[(s >= 0) & (s <= offsets[i + 1] - offsets[i] - width)] + offsets[i])
        at = np.concatenate(found)
        if not len(at):
            return Entries(offsets, np.zeros(0, np.uint64), at, [np.zeros(0, np.uint64)])
        keys = byte_rolling(data).of(at, at + width)
        return _with_local(offsets, keys, at, np.zeros(len(at), np.uint64), at.astype(np.uint64) << U64(16))

    def judge(keys, places, more):
        twice, at = (places & U64(1)).astype(np.int64), places >> U64(1)
        order, starts, totals = _classes(keys, more, 1 + twice)
        hit = order[np.repeat(totals > 1, np.diff([*starts, len(keys)]))]
        hit = hit[twice[hit] == 0]
        return hit, at[hit] << U64(16)

    return exchange(rows, entries, judge, (8, 0))


def ranges(marks: list[bytes] | None, singles: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of ranges in which every string repeats."""
    if not marks and not singles:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = np.concatenate([unpacked(m) for m in [*(marks or ()), *(singles or ())]])
    values = values[(values & U64(1)) == 0]
    t, low = (values >> U64(16)).astype(np.int64), (values & U64(0xFFFF)).astype(np.int64)
    return t - (low >> 8), t - (low >> 1 & 0x7F)


def marked_rows(rows: DataFrame, width: int, within: int = 0) -> DataFrame:
    """rid, h, text, marks, singles of the rows (rid, h, text, ...) in which some entry of the dictionary repeats."""
    own = rows.select("rid", "h", "text", *(["marks", "singles"] if within else []))
    marked = written(parse(own, width, within), "phrases")
    kept = written(rows.select("rid", "h", "text").join(marked.hint("shuffle_hash"), ["rid", "h"]), "marked")
    singles = written(single_starts(kept, width).withColumnRenamed("marks", "singles"), "singles")
    return kept.join(singles.hint("shuffle_hash"), ["rid", "h"], "left")


def judged_rows(rows: DataFrame, *judged: DataFrame) -> DataFrame:
    """rows with marks0 and singles0 of the first, marks1 and singles1 of the second of `judged`, and so on."""
    for i, found in enumerate(judged):
        of = found.select("rid", "h", F.col("marks").alias(f"marks{i}"), F.col("singles").alias(f"singles{i}")).dropDuplicates(["rid", "h"])
        rows = rows.join(of.hint("shuffle_hash"), ["rid", "h"], "left")
    return rows


def spans(marks: list[bytes] | None, singles: list[bytes] | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that repeated strings cover."""
    first, last = ranges(marks, singles)
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + width)
    fresh = np.flatnonzero(start[1:] > end[:-1]) + 1
    return start[np.concatenate([[0], fresh])], end[np.append(fresh, len(end)) - 1]


def without(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """raw without these runs."""
    return b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))


def remove_repeats(docs: DataFrame, width: int = 400, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated for each row of docs (doc_id, text).

    A byte goes if a string of `width` bytes of its document covers it that
    starts at another place too, in any document (also its own; overlaps
    count; all occurrences go).  n_repeated counts the bytes that such strings
    of `passage` (at most `width`) bytes cover; those under no string of
    `width` stay.  Null, empty and short texts lose nothing.  Repeated rows are
    documents of their own, so both lose what they share; a null doc_id is
    judged like any other.  An empty table gives no rows.
    """
    rows = text_rows(docs)
    short = marked_rows(rows, passage)
    found = [short, marked_rows(short, width, passage)]

    def finish(batches):
        for batch in batches:
            out = []
            for raw, m0, s0, m1, s1 in zip(texts_of(batch), *(batch.column(c).to_pylist() for c in ("marks0", "singles0", "marks1", "singles1")), strict=True):
                start, end = spans(m1, s1, width)
                text = without(raw, start, end)
                wide, far = spans(m0, s0, passage)
                out.append((len(raw), len(raw) - len(text), len(start), hashlib.sha256(text).hexdigest(), int((far - wide).sum())))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])

    return judged_rows(rows, *found).select("doc_id", "text", "marks0", "singles0", "marks1", "singles1").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long")


def cut_repeats(docs: DataFrame, width: int = 400, least_words: int = 0) -> DataFrame:
    """The rows of docs with texts (and n_chars) without repeated strings; a text that this empties goes.

    Characters that a removed run would cut stay whole.  Runs of fewer than
    `least_words` words (parts of words at the ends count) stay.  Other columns
    stay.
    """
    names = docs.columns
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).max).cast("long")).alias("rid"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c != "text"), F.lit(0).alias("unused")).alias("row"))

    def finish(batches):
        for batch in batches:
            texts, kept = [], []
            for raw, marks, single in zip(texts_of(batch), batch.column("marks0").to_pylist(), batch.column("singles0").to_pylist(), strict=True):
                runs_of = [(a, b) for a, b in zip(*(x.tolist() for x in spans(marks, single, width)), strict=True) if not least_words or len(raw[a:b].split()) >= least_words]
                text = whole_characters(raw, runs_of) if runs_of else raw
                texts.append(text.decode("utf-8", "replace"))
                kept.append(not runs_of or bool(text))
            cols = [pa.array(texts, pa.string()) if c == "text" else pc.struct_field(batch.column("row"), f"c{i}") for i, c in enumerate(names)]
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(kept, pa.bool_()))

    schema = docs.select(*(F.col(c).cast({"n_chars": "long", "text": "string"}[c]).alias(c) if c in ("n_chars", "text") else F.col(c) for c in names)).schema
    return judged_rows(keyed, marked_rows(keyed, width)).select("row", "text", "marks0", "singles0").mapInArrow(finish, schema)


def whole_characters(raw: bytes, runs_of: list[tuple[int, int]]) -> bytes:
    """What is left of raw without these runs if every character goes only as a whole."""
    data = np.frombuffer(raw, dtype=np.uint8)
    gone = np.zeros(len(data), dtype=bool)
    for a, b in runs_of:
        gone[a:b] = True
    lead = (data & 0xC0) != 0x80
    number = np.cumsum(lead) - 1
    if len(number) and number[0] < 0:
        number = np.maximum(number, 0)
    kept = np.zeros(int(number[-1]) + 1, dtype=bool)
    kept[number[~gone]] = True
    return data[kept[number]].tobytes()


ORACLE = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM raw WHERE length(x) >= 800)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
shorter AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 512)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 255)) AS i FROM raw WHERE length(x) >= 512)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM shorter) WHERE n > 1),
standing AS (SELECT doc_id, sum(least(256, coalesce(next - i, 256))) AS n_repeated FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM again) GROUP BY doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM repeated),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS after, row_number() OVER w AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (
  SELECT p.doc_id, sum(b - a) AS gone, max(n) AS n_spans,
         string_agg(substr(x, 2 * after + 1, 2 * (a - after)) || CASE WHEN place = n THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS rest
  FROM pieces p JOIN raw ON raw.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT raw.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE coalesce(rest, '') END)) AS kept_sha256, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated
FROM raw LEFT JOIN kept ON kept.doc_id = raw.doc_id LEFT JOIN standing ON standing.doc_id = raw.doc_id
"""
