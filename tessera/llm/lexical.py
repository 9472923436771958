"""Exact ranked lexical search over a tiered index.

One pass over the texts writes an index: for each chunk of documents the
postings (term, document, count) as packed arrays.  A posting's impact depends
on its count and its document's length only.  A histogram of impacts by term
tells, for each tier, from which impact on a term's postings belong to it, and
the greatest impact that is left below: the residual bound.

Items ask the first tier.  The sum of what they find bounds a document's score
from below; with the residuals of the terms not found there it is bounded from
above.  Where the k-th best lower bound exceeds what a document that the tier
doesn't show could reach, the tier proves that no other document matters: the
documents whose upper bounds reach the k-th best are scored exactly.  Items
without that proof fall through to the next tier, at last to the whole index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .jaccard import NULL_ID
from .shared import doc_text, written
from .textscan import LOWER, U64, alnum_words, chunks, give_back, ids, row_of, word_hashes, words

IS_WORD = alnum_words()
UNIT = 1_000_000_000  # of an impact; impacts are below UNIT / 1000
STEP = 4096  # impacts of one bar of the histogram
TIERS = (2_000, 50_000)  # postings of a term in a tier, bars being whole
VOCABULARY = 4_000_000  # terms to broadcast as 64-bit hashes
PAIRS = 1_000_000  # (item, term) pairs that are searched together
SEGMENT = 4_000_000  # histogram entries that wait in a task
INDEX = "chunk long, n_docs long, n_terms long, docs binary, lengths binary, terms binary, counts binary, places binary, tfs binary"


def item_terms(items: DataFrame) -> DataFrame:
    """item, term (hash), q (occurrences) of items (item_id, text); item is the largest integer for a null id."""

    def run(batches):
        for batch, data, offsets in chunks(batches):
            low = LOWER[data]
            starts, ends, first = words(low, offsets, IS_WORD)
            terms = word_hashes(low, starts, ends).view(np.int64) if len(starts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids(batch)[row_of(first)]), pa.array(terms)], names=["item", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).distinct()
    return rows.mapInArrow(run, "item long, term long").groupBy("item", "term").agg(F.count(F.lit(1)).alias("q"))


def index(docs: DataFrame, vocabulary: np.ndarray | None = None, limit: int = 1 << 19) -> DataFrame:
    """Packed postings by chunk of `limit` bytes of text; vocabulary: sorted hashes of the only terms to keep."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, number = held.value, TaskContext.get().partitionId() << 32
        for batch, data, offsets in chunks(batches, limit=limit):
            low = LOWER[data]
            starts, ends, first = words(low, offsets, IS_WORD)
            lengths = np.diff(first)
            n = len(lengths)
            hashes = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, U64)
            of = row_of(first)
            if known is not None and len(hashes):
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                good = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                hashes, of = hashes[good], of[good]
            terms, term = np.unique(hashes, return_inverse=True)
            keys, tfs = np.unique(term.astype(np.int64) * n + of, return_counts=True)
            term, place = keys // n, keys % n
            counts = np.bincount(term, minlength=len(terms))
            arrays = ids(batch), lengths.astype("<i8"), terms, counts.astype("<i4"), place.astype("<u2"), tfs.astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, np.count_nonzero(lengths), len(starts))] + [pa.array([x.tobytes()], pa.binary()) for x in arrays], names=[part.split()[0] for part in INDEX.split(", ")])
            number += 1
        give_back()

    return doc_text(docs).mapInArrow(run, INDEX)


@dataclass
class Corpus:
    """n: documents with a term; length: all terms of the corpus."""

    n: int
    length: int

    def impacts(self, lengths: np.ndarray, places: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        m = 75 + 25 * lengths * self.n // max(self.length, 1)
        return UNIT * tfs // (1000 * tfs + 12 * m[places])

    def weight(self, df: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2.0 * self.n + 2) / (2.0 * df + 1))).astype(np.int64)


class Chunk:
    """A row of the index as arrays."""

    def __init__(self, row: dict, corpus: Corpus):
        take = lambda c, kind: np.frombuffer(row[c], kind)
        self.docs, self.terms, self.counts = take("docs", "<i8"), take("terms", "<u8"), take("counts", "<i4").astype(np.int64)
        self.places = take("places", "<u2").astype(np.int64)
        self.impacts = corpus.impacts(take("lengths", "<i8"), self.places, take("tfs", "<u4").astype(np.int64))
        self.starts = np.cumsum(self.counts) - self.counts


def histogram(postings: DataFrame, corpus: Corpus) -> DataFrame:
    """term, bar, n, top: postings of a term by impact, and the greatest impact of each bar."""

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], []]

        def flush():
            key = np.concatenate(held[0])
            bar = np.concatenate(held[1])
            impact = np.concatenate(held[2])
            order = np.lexsort((bar, key))
            key, bar, impact = key[order], bar[order], impact[order]
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bar[1:] != bar[:-1])]))
            n = np.diff(np.append(heads, len(key)))
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays([pa.array(key[heads].view(np.int64)), pa.array(bar[heads].astype(np.int32)), pa.array(n), pa.array(np.maximum.reduceat(impact, heads))], names=["term", "bar", "n", "top"])

        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, corpus)
                for column, x in zip(held, (np.repeat(chunk.terms, chunk.counts), chunk.impacts // STEP, chunk.impacts), strict=True):
                    column.append(x)
                if sum(map(len, held[0])) >= SEGMENT:
                    yield flush()
        if sum(map(len, held[0])):
            yield flush()
        give_back()

    counted = postings.select("docs", "lengths", "terms", "counts", "places", "tfs").mapInArrow(run, "term long, bar int, n long, top long")
    return counted.groupBy("term", "bar").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def term_bounds(bars: DataFrame, tiers: tuple[int, ...]) -> DataFrame:
    """term, df, and for each tier cut_t (its smallest impact bar) and rest_t (the greatest impact below)."""
    above = F.coalesce(F.sum("n").over(W.partitionBy("term").orderBy(F.desc("bar")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = [c for t, size in enumerate(tiers) for c in (F.min(F.when(F.col("above") < size, F.col("bar"))).alias(f"cut_{t}"), F.coalesce(F.max(F.when(F.col("above") >= size, F.col("top"))), F.lit(0)).alias(f"rest_{t}"))]
    return bars.withColumn("above", above).groupBy("term").agg(F.sum("n").alias("df"), *cuts)


class Asked:
    """Items of one block: their terms, weights, cuts and residual bounds, as arrays."""

    def __init__(self, table: pa.Table, corpus: Corpus, tiers: int):
        col = lambda c: table.column(c).to_numpy()
        order = np.argsort(col("item"), kind="stable")
        self.items, heads = np.unique(col("item")[order], return_index=True)
        self.bounds = np.append(heads, len(order))
        self.vocabulary, one, self.slot = np.unique(col("term")[order].view(np.uint64), return_index=True, return_inverse=True)
        self.weight = (corpus.weight(col("df")) * col("q"))[order]
        self.cuts = [col(f"cut_{t}")[order][one] for t in range(tiers)]
        self.rests = [col(f"rest_{t}")[order] for t in range(tiers)]

    def residual(self, tier: int) -> np.ndarray:
        """By item, the most that a document without any posting in the tier can score."""
        return np.add.reduceat(self.weight * self.rests[tier], self.bounds[:-1]) if len(self.items) else np.zeros(0, np.int64)

    def scores(self, chunk: Chunk, chosen: np.ndarray, tier: int | None):
        """(item number, lower, upper) scores of the chunk's documents for each chosen item with postings there.

        tier None: the postings are whole, so both are the score.
        """
        slots = np.searchsorted(self.vocabulary, chunk.terms)
        good = slots < len(self.vocabulary)
        good[good] = self.vocabulary[slots[good]] == chunk.terms[good]
        where = np.full(len(self.vocabulary), -1)
        where[slots[good]] = np.flatnonzero(good)
        for k in chosen:
            own = np.arange(self.bounds[k], self.bounds[k + 1])
            at = where[self.slot[own]]
            own, at = own[at >= 0], at[at >= 0]
            if not len(own):
                continue
            n = chunk.counts[at]
            place = np.repeat(chunk.starts[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            docs = chunk.places[place]
            gain = np.repeat(self.weight[own], n) * chunk.impacts[place]
            low = np.zeros(len(chunk.docs), np.int64)
            np.add.at(low, docs, gain)
            if tier is None:
                yield k, low, low, docs
            else:
                less = np.zeros(len(chunk.docs), np.int64)
                np.add.at(less, docs, np.repeat(self.weight[own] * self.rests[tier][own], n))
                yield k, low, low - less, docs


def tier_rows(postings: DataFrame, corpus: Corpus, asked, tiers: int) -> DataFrame:
    """The index cut down to each tier (tier 0 holds the highest impacts; each holds those before it)."""

    def run(batches):
        items = asked.value
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                chunk = Chunk(row, corpus)
                slots = np.minimum(np.searchsorted(items.vocabulary, chunk.terms), len(items.vocabulary) - 1)
                known = items.vocabulary[slots] == chunk.terms
                bars = chunk.impacts // STEP
                term = np.repeat(np.arange(len(chunk.terms)), chunk.counts)
                for t in range(tiers):
                    keep = np.flatnonzero((known & True)[term] & (bars >= items.cuts[t][slots][term]))
                    if len(keep):
                        left, counts = np.unique(term[keep], return_counts=True)
                        take = lambda c, kind, at: np.frombuffer(row[c], kind)[at].tobytes()  # noqa: E731, B023
                        rows.append(row | {"tier": t, "terms": chunk.terms[left].tobytes(), "counts": counts.astype("<i4").tobytes(), "places": take("places", "<u2", keep), "tfs": take("tfs", "<u4", keep)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = f"{INDEX}, tier int"
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in fields.split(", ")])
    return postings.mapInArrow(run, fields)


class Best:
    """The k best (score, smaller id first) of what was offered, by item."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def offer(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        least, have = self.held.get(item, (1, []))
        at = np.flatnonzero(scores >= least)
        if len(at):
            score, doc = scores[at], docs[at]
            if have:
                score, doc = np.concatenate([have[0], score]), np.concatenate([have[1], doc])
            order = np.lexsort((doc, -score))[: self.k]
            self.held[item] = (int(score[order[-1]]) if len(order) == self.k else 1, [score[order], doc[order]])

    def rows(self, items: np.ndarray) -> pa.RecordBatch:
        found = [(np.full(len(s), items[k]), d, s) for k, (_, (s, d)) in self.held.items()]
        return as_scores(*(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)))


def as_scores(item, doc, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, dtype=np.int64)) for x in (item, doc, score)], names=["item", "doc", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def best_scores(postings: DataFrame, corpus: Corpus, asked, chosen: np.ndarray, tier: int | None, k: int) -> DataFrame:
    """item, doc, score: the k best (lower bounds of) scores of each chosen item, by task."""

    def run(batches):
        items, best = asked.value, Best(k)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, corpus)
                for item, low, _, _ in items.scores(chunk, chosen, tier):
                    best.offer(item, low, chunk.docs)
        yield best.rows(items.items)
        give_back()

    return postings.mapInArrow(run, "item long, doc long, score long")


def candidates(postings: DataFrame, corpus: Corpus, asked, reach: dict[int, int], residual: np.ndarray, tier: int) -> DataFrame:
    """chunk, item (its number): where some document's upper bound reaches what the item's k-th best has for sure."""
    chosen = np.array(sorted(reach))

    def run(batches):
        items = asked.value
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                chunk = Chunk(row, corpus)
                for item, _, part, docs in items.scores(chunk, chosen, tier):
                    if (part[docs] + residual[item] >= reach[item]).any():
                        rows.append({"chunk": row["chunk"], "item": int(item)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("item", pa.int32())]))

    return postings.mapInArrow(run, "chunk long, item int")


def exact_scores(postings: DataFrame, corpus: Corpus, asked, wanted: DataFrame, k: int) -> DataFrame:
    """item, doc, score: the k best of each item by task, over the chunks that `wanted` (chunk, item) names."""
    named = wanted.groupBy(F.col("chunk").alias("of")).agg(F.collect_set("item").alias("chosen"))
    rows = postings.join(named, F.col("chunk") == F.col("of")).drop("of")

    def run(batches):
        items, best = asked.value, Best(k)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, corpus)
                for item, low, _, _ in items.scores(chunk, np.array(row["chosen"]), None):
                    best.offer(item, low, chunk.docs)
        yield best.rows(items.items)

    return rows.mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, tiers: tuple[int, ...] = TIERS, vocabulary: int = VOCABULARY, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score, tier: the k documents (doc_id, text) of the greatest scores for each item (item_id, text).

    Terms are lower-cased (A-Z) runs of ASCII letters and digits and of
    characters beyond ASCII.  A document scores, for each term of the item
    (repeats included), w * (10**9 * tf div (1000 * tf + 12 * m)) with w =
    floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 75 + 25 * n * N div L, N
    documents that have terms, L terms in all, n terms of the document.  Equal
    scores go by doc_id; only scores above 0 are ranked.  tier tells which
    tier proved the item's result (the number of tiers: the whole index).

    Items whose text is null or without known terms have no rows.  Rows of
    items that share an id are one item with the terms of its different texts;
    repeated rows count once.  Rows of docs that share a doc_id are documents
    of their own.  A null doc_id comes last among equals, and null ids come
    back as null.  Empty tables give no rows; other columns are ignored.

    The texts are read once.  Item terms beyond `vocabulary` are not broadcast:
    the index then holds every term.  Items are searched in blocks of about
    `pairs` terms, each over the index.
    """
    spark = docs.sparkSession
    asked_terms = written(item_terms(items), "asked", compact=True)
    n_pairs, n_terms = asked_terms.agg(F.count(F.lit(1)), F.count_distinct("term")).first()
    known = None
    if n_terms <= vocabulary:
        known = np.sort(asked_terms.select("term").distinct().toArrow().column(0).to_numpy().view(np.uint64))
    postings = written(index(docs, known), "postings")
    corpus = Corpus(*postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first())
    bounds = written(term_bounds(histogram(postings, corpus), tiers), "bounds", compact=True)
    blocks = max(1, -(-n_pairs // pairs))
    found = None
    for block in range(blocks):
        mine = asked_terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else asked_terms
        part = search_block(postings, mine.join(bounds, "term"), corpus, k, len(tiers))
        found = part if found is None else found.unionByName(part)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(back("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), back("doc").alias("doc_id"), "score", "tier")


def search_block(postings: DataFrame, weighed: DataFrame, corpus: Corpus, k: int, tiers: int) -> DataFrame:
    """item, rank, doc, score, tier for the items of one block; weighed: item, term, q, df, cuts and residuals."""
    spark = postings.sparkSession
    items = Asked(weighed.toArrow(), corpus, tiers)
    asked = spark.sparkContext.broadcast(items)
    parts = []
    left = np.arange(len(items.items))
    if len(left) and tiers:
        cut = written(tier_rows(postings, corpus, asked, tiers), "tiers", partition_by="tier")
    for t in range(tiers):
        if not len(left):
            break
        own = cut.filter(F.col("tier") == t)
        best = ranked(best_scores(own, corpus, asked, left, t, k), k).filter(F.col("rank") == k)
        sure = {int(r.item): r.score for r in best.select("item", "score").toLocalIterator()}  # one row an item of the block
        residual = items.residual(t)
        reach = {int(i): max(sure.get(int(items.items[i]), 0), 1) for i in left}
        proven = [i for i in left if residual[i] < reach[int(i)]]
        if proven:
            wanted = written(candidates(own, corpus, asked, {int(i): reach[int(i)] for i in proven}, residual, t), "wanted", compact=True)
            parts.append(ranked(exact_scores(postings, corpus, asked, wanted, k), k).withColumn("tier", F.lit(t)))
            left = np.setdiff1d(left, proven)
    whole = ranked(best_scores(postings, corpus, asked, left, None, k), k).withColumn("tier", F.lit(tiers))
    for part in parts:
        whole = whole.unionByName(part)
    return whole


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
size AS (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d),
tf AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM size) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf GROUP BY term),
q AS (
  SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scored AS (
  SELECT q.item_id, tf.doc_id, tf.r, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * s.n_docs) // s.total)))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL) q JOIN w ON q.term = w.term JOIN tf ON tf.term = q.term CROSS JOIN size s, generate_series(1, q.times) g
  GROUP BY q.item_id, tf.doc_id, tf.r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
