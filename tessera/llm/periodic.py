"""Periodic runs of words by harmonic grids over suffix arrays.

Texts of a chunk are laid end to end with separators that equal nothing.  For
each period p the grid points 0, p, 2p, ... are visited: a run of period p that
holds `exponent` periods contains as many grid points, whose words agree, so
the longest common extensions of (jp, (j+1)p), forward and backward, span it.
Grid points at which the first words differ have extension 0 and need no
arrays; the others are answered by the suffix array of the texts, that of the
reversed texts, their LCP arrays and range minima.  Memory is linear in the
text: about 100 bytes a word of the texts that still have questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import covered, texts_of
from .shared import doc_text
from .textscan import chunks, row_of, whitespace_words, word_hashes, words

IS_WORD = whitespace_words()
AT_ONCE = 1 << 17  # extensions that are asked for together
RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"
_MOST = np.iinfo(np.int64).max


class RangeMin:
    """Smallest value of any range of an array: minima from both ends of blocks, and a sparse table over blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        held = np.full(-(-max(len(values), 1) // self.BLOCK) * self.BLOCK, _MOST, dtype=np.int64)
        held[: len(values)] = values
        self.values, rows = held, held.reshape(-1, self.BLOCK)
        self.before = np.minimum.accumulate(rows, axis=1).ravel()
        self.after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [self.before[self.BLOCK - 1 :: self.BLOCK]]
        while 2 ** len(self.table) <= len(rows):
            last, step = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of low..high, both included; low <= high."""
        first, last = low // self.BLOCK, high // self.BLOCK
        out = np.minimum(self.after[low], self.before[high])
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            a, b = first[inner] + 1, last[inner]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = level == k
                row, at = self.table[k], inner[own]
                out[at] = np.minimum(out[at], np.minimum(row[a[own]], row[b[own] - (1 << int(k))]))
        same = np.flatnonzero(first == last)
        if len(same):
            place = low[same, None] + np.arange(self.BLOCK)
            inside = place <= high[same, None]
            out[same] = np.where(inside, self.values[np.minimum(place, len(self.values) - 1)], _MOST).min(axis=1)
        return out


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix, and the common prefix of each suffix in order with the one before it.

    Prefix doubling; a common prefix is known when a doubling parts two
    neighbours: the length so far, and the smallest one between the places of
    what follows.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ids[order][1:] != ids[order][:-1]
    common = np.where(fresh, 0, _MOST)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while not fresh.all():
        last = np.ones(n, dtype=bool)
        last[:-1] = fresh[1:]
        still = np.flatnonzero(~(fresh & last))
        at = order[still]
        follow = at + step
        then = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        group = rank[at]
        by = np.lexsort((then, group))
        at, then, group = at[by], then[by], group[by]
        order[still] = at
        parted = np.flatnonzero((group[1:] == group[:-1]) & (then[1:] != then[:-1])) + 1
        if len(parted):
            least = RangeMin(common)
            common[still[parted]] = step + np.where(then[parted - 1] < 0, 0, least.of(np.maximum(then[parted - 1], 0) + 1, np.maximum(then[parted], 1)))
            fresh[still[parted]] = True
            rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        step *= 2
    return rank, common


class Extensions:
    """Longest common extension of pairs of places of one sequence."""

    def __init__(self, ids: np.ndarray):
        self.rank, common = suffix_order(ids)
        self.least = RangeMin(common)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least.of(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(ids: np.ndarray, longest: int, exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(period, places): grid points from which `exponent` of them hold one word."""
    for p in range(1, longest // exponent + 1):
        held = ids[::p]
        same = held[1:] == held[:-1]
        far = len(same) - exponent + 2
        if far <= 0:
            continue
        good = same[:far].copy()
        for k in range(1, exponent - 1):
            good &= same[k : far + k]
        at = np.flatnonzero(good)
        if len(at):
            yield p, at * p


def laid_out(ids: np.ndarray, first: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of these texts with a separator of its own before each and one at the end; place of each text's first word."""
    sizes = np.diff(first)[texts]
    heads = np.cumsum(sizes + 1) - sizes
    out = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    apart = np.append(heads - 1, len(out) - 1)
    held = np.ones(len(out), dtype=bool)
    held[apart] = False
    out[held] = ids[np.repeat(first[:-1][texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    out[apart] = -1 - np.arange(len(apart))
    return out, heads


def runs_of(ids: np.ndarray, first: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts of word numbers, by text, start and period."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(first)
    texts = np.flatnonzero(sizes >= max(least, exponent))
    if not len(texts):
        return none, none, none, none
    line, heads = laid_out(ids, first, texts)
    asked = np.zeros(len(texts), dtype=bool)
    for _, at in grid(line, int(sizes[texts].max()), exponent):
        asked[np.searchsorted(heads, at, side="right") - 1] = True
    texts = texts[asked]
    if not len(texts):
        return none, none, none, none
    line, heads = laid_out(ids, first, texts)
    ahead, back, n = Extensions(line), Extensions(line[::-1].copy()), len(line)
    found, waiting, held = [], [], 0

    def answer():
        p = np.repeat([p for p, _ in waiting], [len(at) for _, at in waiting])
        i = np.concatenate([at for _, at in waiting])
        for k in range(0, len(i), AT_ONCE):
            a, q = i[k : k + AT_ONCE], p[k : k + AT_ONCE]
            end = a + q + ahead.of(a, a + q)
            start = a - back.of(n - a, n - a - q)
            good = end - start >= np.maximum(least, exponent * q)
            found.append(np.unique(np.column_stack([start[good], end[good], q[good]]), axis=0))

    for p, at in grid(line, int(sizes[texts].max()), exponent):
        waiting.append((p, at))
        held += len(at)
        if held >= AT_ONCE:
            answer()
            waiting, held = [], 0
    if held:
        answer()
    if not found:  # the texts' grid points lie elsewhere than before, and no run holds `exponent` of the new ones
        return none, none, none, none
    # A multiple of a run's period spans the same words, so the smallest period of a span is its own.
    start, end, p = np.unique(np.concatenate(found), axis=0).T
    own = np.ones(len(start), dtype=bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[own], end[own], p[own]
    by = np.lexsort((p, start))
    start, end, p = start[by], end[by], p[by]
    of = np.searchsorted(heads, start, side="right") - 1
    return texts[of], start - heads[of], end - start, p


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs, strongest, collapsed for each row of docs (doc_id, text).

    Words are runs of other than ASCII white space.  A run is a stretch of
    words with smallest period q and a length of at least `least` and
    exponent * q that no neighbour extends (exponent 2 or more).  runs holds
    (start, length, period) by start and period; strongest is the one of
    greatest length / period (ties: smallest start, then period), null without
    runs.  collapsed joins by one space the words that no run holds after its
    first q words.

    Each row is judged alone: rows that share a doc_id don't meet, and ids may
    be null.  Null and empty texts have no words, no runs and an empty
    collapsed text.  An empty table gives no rows.  Other columns are ignored.
    """
    if exponent < 2:
        raise ValueError("a run holds two periods at least")

    def run(batches):
        for batch, data, offsets in chunks(batches):
            starts, ends, first = words(data, offsets, IS_WORD)
            ids = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1] if len(starts) else np.zeros(0, np.int64)
            text, start, length, period = runs_of(ids, first, exponent, least)
            gone = np.zeros(len(ids), dtype=bool)
            if len(text):
                at = first[text] + start
                gone = covered(len(ids), at + period, at + length)
            loses = np.bincount(row_of(first)[gone], minlength=batch.num_rows)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            collapsed, best = [], []
            for i, raw in enumerate(texts_of(batch)):
                held = raw.split()
                if loses[i]:
                    held = [w for w, g in zip(held, gone[first[i] : first[i + 1]].tolist(), strict=True) if not g]
                collapsed.append(b" ".join(held).decode("utf-8", "replace"))
                own = range(bounds[i], bounds[i + 1])
                k = max(own, key=lambda k: (Fraction(int(length[k]), int(period[k])), -start[k], -period[k]), default=None)
                best.append(None if k is None else {"start": int(start[k]), "length": int(length[k]), "period": int(period[k])})
            struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct), pa.array(best, struct.type), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return doc_text(docs).mapInArrow(run, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, where a tenth of the texts end in a repeated stretch (told by the crc32 of doc_id).

    With g = floor(crc32 / 10) and n words, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Rows without an id, and texts without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = doc_text(docs).withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, w))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("long"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda i: F.get("w", (F.col("a") + i % F.col("p")).cast("int")))
    planted = F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and SHA-256 digests of runs and collapsed text; found: `periodic_runs`."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    digests = F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, *digests, "n_words")
