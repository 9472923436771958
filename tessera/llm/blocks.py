"""Substring dedup by fixed-block anchors.

Every document is cut into blocks of 25 words, the reference blocks.  All
rolling windows of 25 words of all documents probe them.  A window of 50 words
holds one whole block of its document wherever it starts, so two documents
with an equal window have an anchor at the same place in it.  Hits are
extended: the 50-word windows around anchors are met exactly, and runs of
matched windows are the maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Entries, covered, exchange, marks_of, runs, text_rows, texts_of, united
from .shared import written
from .textscan import U64, Rolling, ids, row_of, whitespace_words, windows, word_hashes, words

IS_WORD = whitespace_words()


def _scanned(data, offsets):
    starts, ends, first = words(data, offsets, IS_WORD)
    return first, Rolling(word_hashes(data, starts, ends))


def anchors(rows: DataFrame, block: int) -> DataFrame:
    """Places (in words) of windows of `block` words that equal some reference block elsewhere."""

    def entries(batch, data, offsets):
        first, rolling = _scanned(data, offsets)
        at = windows(first, block)
        if not len(at):
            return Entries(first, np.zeros(0, np.uint64), at)
        keys = rolling.of(at, at + block)
        is_block = (at - first[row_of(first)[at]]) % block == 0
        # Where this chunk already shows a repeat with a reference block, all its places are anchors, and one entry speaks for them.
        order = np.argsort(keys, kind="stable")
        starts = runs(keys[order])
        sizes = np.diff([*starts, len(at)])
        settled = (sizes > 1) & np.logical_or.reduceat(is_block[order], starts)
        marked = np.zeros(len(at), dtype=bool)
        marked[order] = np.repeat(settled, sizes)
        speaker = np.zeros(len(at), dtype=bool)
        speaker[order[starts[settled]]] = True
        sent = ~marked | speaker
        return Entries(first, keys[sent], (at * 2 + (is_block | speaker))[sent], local=at[marked].astype(np.uint64) << U64(16))

    def judge(keys, places):
        order = np.argsort(keys, kind="stable")
        starts = runs(keys[order])
        sizes = np.diff([*starts, len(keys)])
        hit = (sizes > 1) & np.logical_or.reduceat((places[order] & U64(1)) > 0, starts)
        found = order[np.repeat(hit, sizes)]
        return found, (places[found] >> U64(1)) << U64(16)

    return exchange(rows, entries, judge, (5,))


def later_windows(rows: DataFrame, width: int, block: int) -> DataFrame:
    """Starts (in words) of windows around anchors that also start in a document with a smaller rid; rows have marks."""

    def entries(batch, data, offsets):
        first, rolling = _scanned(data, offsets)
        lo, hi = [], []
        for i, marks in enumerate(marks_of(batch, "marks")):
            a = (marks >> U64(16)).astype(np.int64) + first[i]
            lo.append(np.maximum(a - (width - block), first[i]))
            hi.append(np.minimum(a, first[i + 1] - width) + 1)
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        held = hi > lo
        at = np.flatnonzero(covered(int(first[-1]), lo[held], hi[held]))
        if not len(at):
            return Entries(first, np.zeros(0, np.uint64), at)
        keys, rids = rolling.of(at, at + width), ids(batch, "rid")[row_of(first)[at]]
        order = np.lexsort((rids, keys))
        starts = runs(keys[order])
        least = np.empty(len(at), dtype=np.int64)
        least[order] = np.repeat(rids[order][starts], np.diff([*starts, len(at)]))
        later = rids > least
        return Entries(first, keys[~later], at[~later], [rids[~later].view(np.uint64)], at[later].astype(np.uint64) << U64(16))

    def judge(keys, places, rids):
        rids = rids.view(np.int64)
        order = np.lexsort((rids, keys))
        starts = runs(keys[order])
        least = np.repeat(rids[order][starts], np.diff([*starts, len(keys)]))
        found = order[rids[order] > least]
        return found, places[found] << U64(16)

    return exchange(rows, entries, judge, (8, 8))


def remove_repeats(docs: DataFrame, width: int = 50, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for each row of docs (doc_id, text).

    A word goes if a window of `width` words of its document covers it that
    also starts in a document with a smaller doc_id.  Null, empty and short
    texts lose nothing.  Rows that share a doc_id are one document and leave
    each other alone; a null doc_id counts as larger than all others.  Repeats
    inside one document stay.  An empty table gives no rows.
    """
    block = width // 2
    rows = text_rows(docs)
    hits = written(anchors(rows, block), "anchors")
    starts = later_windows(rows.join(hits.hint("shuffle_hash"), ["rid", "h"]), width, block)
    judged = rows.join(starts.hint("shuffle_hash"), ["rid", "h"], "left")

    def finish(batches):
        for batch in batches:
            n, removed, digests, kept = [], [], [], []
            for raw, marks in zip(texts_of(batch), batch.column("marks").to_pylist(), strict=True):
                held = raw.split()
                n.append(len(held))
                if marks:
                    s = (united(marks) >> U64(16)).astype(np.int64)
                    gone = covered(len(held), s, s + width)
                    held = [w for w, g in zip(held, gone.tolist(), strict=True) if not g]
                removed.append(n[-1] - len(held))
                text = b" ".join(held)
                digests.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if keep_text else [])], names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])])

    return judged.select("doc_id", "text", "marks").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM later),
gone_of AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN g.ps IS NULL THEN words ELSE list_filter(words, lambda x, p: NOT list_contains(g.ps, p)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone_of g ON w.doc_id = g.doc_id
"""
