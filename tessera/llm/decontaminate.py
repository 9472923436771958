"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are normalised (ASCII lower case, runs of other ASCII than
letters and digits as one space).  An occurrence of an item of n bytes with at
most k edits shares n + 1 - q(k + 1) q-grams with it, all within k + 1
diagonals; q is 8, and less for items of so few bytes that 8 bounds nothing.  Shared q-grams are counted in overlapping bands of 2(k + 1)
diagonals; bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import covered, runs, spans
from .shared import doc_text, free_name
from .textscan import U64, alnum_words, chunks

Q, RATE, BLOCK_BYTES, FILTER_BITS = 8, 0.1, 2 << 20, 22
_KEPT = alnum_words()
_FOLD = np.where(_KEPT, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] = np.arange(97, 123)
MATCH = "doc_id long, row long, item_id long, edits int, start long, end long"


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, the byte each came from, and offsets of the texts."""
    low = _FOLD[data]
    space = low == 32
    kept = ~space
    kept[1:] |= ~space[:-1]
    place = np.flatnonzero(kept)
    return low[place], place, np.searchsorted(place, offsets)


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q (up to 8) bytes at each place as one integer."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    x = np.concatenate([data, np.zeros(Q - q, np.uint8)]).astype(np.uint64)
    x = x[:-1] | x[1:] << U64(8)
    x = x[:-2] | x[2:] << U64(16)
    x = x[:-4] | x[4:] << U64(32)
    return x & U64((1 << 8 * q) - 1)


def gram_size(length: int, budget: int) -> int:
    """The longest grams, up to Q, of which an occurrence with `budget` edits must share one at least."""
    return max(1, min(Q, length // (budget + 1)))


def align(item: np.ndarray, text: np.ndarray, band: int, budget: int, fixed: int | None = None) -> tuple[int, int]:
    """Fewest edits of the whole item against a part of text, and the end of the shortest such part.

    Only the first `band` diagonals count, and the part may start on any of
    them.  With `fixed`, the part starts with text, and diagonals reach
    `fixed` to either side of that start.  Once all costs exceed `budget` it ends.
    """
    lead = fixed or 0
    band = 2 * lead + 1 if fixed is not None else band
    n, m = len(item), len(text) + lead
    padded = np.zeros(n + band, dtype=np.uint8)
    padded[lead : min(m, n + band)] = text[: n + band - lead]
    at = np.arange(band, dtype=np.int32)
    row = np.zeros(band, dtype=np.int32) if fixed is None else np.where(at < lead, n + m + 1, at - lead).astype(np.int32)
    for i, c in enumerate(item):
        new = row + (padded[i : i + band] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - at) + at
        if i % 16 == 15 and row.min() > budget:
            return budget + 1, 0
    row[max(0, m - n + 1) :] = n + m + 1
    end = int(row.argmin())
    return int(row[end]), n + end - lead


@dataclass
class Index:
    """q-grams of those items of a block whose bound asks for this q."""

    q: int
    ids: list[int]
    items: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    heads: np.ndarray
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray
    exact: list[bytes]

    @classmethod
    def all(cls, rows: list[tuple[int, str]], rate: float) -> list[Index]:
        """An index for each gram size that the items need: Q where it bounds anything, less for short items."""
        by_size: dict[int, list] = {}
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            if len(raw):
                raw = normalised(raw, np.array([0, len(raw)]))[0]
            raw = np.frombuffer(raw.tobytes().strip(), dtype=np.uint8)
            if len(raw):
                budget = int(rate * len(raw))
                by_size.setdefault(gram_size(len(raw), budget), []).append((item_id, raw, budget))
        return [cls.of(q, held) for q, held in sorted(by_size.items())]

    @classmethod
    def of(cls, q: int, held: list[tuple[int, np.ndarray, int]]) -> Index:
        ids, items, budgets, needed, keys, item, place = [], [], [], [], [], [], []
        for item_id, raw, budget in held:
            g = grams(raw, q)
            keys.append(g)
            item.append(np.full(len(g), len(ids)))
            place.append(np.arange(len(g)))
            ids.append(item_id)
            items.append(raw)
            budgets.append(budget)
            needed.append(max(1, len(raw) + 1 - q * (budget + 1)))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = runs(key)
        present = np.zeros(1 << FILTER_BITS, dtype=bool)
        present[cls.slot(key)] = True
        flat = lambda x: (np.concatenate(x) if x else np.zeros(0, np.int64))[order]
        return cls(q, ids, items, np.array(budgets, np.int64), np.array(needed, np.int64), key[heads], np.append(heads, len(key)), flat(item), flat(place), present, [x.tobytes() for x in items])

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g * U64(0x9E3779B97F4A7C15) >> U64(64 - FILTER_BITS)).astype(np.int64)

    def bands(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first and last place at which an occurrence may start) of bands with enough shared q-grams."""
        g = grams(data, self.q)
        at = np.flatnonzero(self.present[self.slot(g)])
        if not len(at) or not len(self.keys):
            return []
        found = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[found] == g[at]
        at, found = at[same], found[same]
        many = self.heads[found + 1] - self.heads[found]
        ends = np.cumsum(many)
        hit = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(self.heads[found], many)
        item, diagonal = self.item[hit], np.repeat(at, many) - self.place[hit]
        shift = int(max((len(x) for x in self.items), default=0))
        band = (diagonal + shift) // (self.budgets[item] + 1)
        key = item * (1 << 40) + band
        held, count = np.unique(key, return_counts=True)
        following = np.minimum(np.searchsorted(held, held + 1), len(held) - 1)
        both = count + np.where(held[following] == held + 1, count[following], 0)
        # A band that starts one before a counted one has its second half only.
        item, band = held >> 40, held & ((1 << 40) - 1)
        good = both >= self.needed[item]
        item, band = item[good], band[good]
        # Bands next to each other show one occurrence; up to three are aligned as one.
        out: list[tuple[int, int, int]] = []
        last = (-1, 0, 0)
        for i, b in zip(item.tolist(), band.tolist(), strict=True):
            if last[0] == i and b == last[2] + 1 and b - last[1] < 3:
                last = (i, last[1], b)
                out.pop()
            else:
                last = (i, b, b)
            width = int(self.budgets[i]) + 1
            out.append((i, last[1] * width - shift, (b + 2) * width - shift - 1))
        return out

    def matches(self, data: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) in normalised places."""
        out = set()
        raw = data.tobytes()
        for i, lo, hi in self.bands(data):
            item, budget = self.items[i], int(self.budgets[i])
            middle = min(max((lo + hi) // 2 + len(item) // 2, 0), len(data) - 1)
            text = int(np.searchsorted(first, middle, side="right")) - 1
            for t in {text, int(np.searchsorted(first, min(max(lo, 0), len(data) - 1), side="right")) - 1, int(np.searchsorted(first, min(max(hi + len(item) - 1, 0), len(data) - 1), side="right")) - 1}:
                a, b = max(lo - budget, int(first[t])), min(hi + len(item) + budget, int(first[t + 1]))
                if hi + budget < a or b - a < len(item) - budget:
                    continue
                whole = raw[a:b].find(self.exact[i])
                if whole >= 0:
                    out.add((t, i, 0, a + whole, a + whole + len(item)))
                    continue
                edits, end = align(item, data[a:b], hi + budget - a + 1, budget)
                if edits > budget:
                    continue
                _, back = align(item[::-1], data[a : a + end][::-1], 0, budget, fixed=budget)
                out.add((t, i, edits, a + end - back, a + end))
        return sorted(out)


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of about `block_bytes`; the item set is the stated query set."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = max(1, -(-size // block_bytes))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def find_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row (a hash of the whole text), item_id, edits, start, end: where items stand, in bytes of the text.

    Every document and item that match have a row.  Occurrences that start
    within a few diagonals of each other (repeats closer than an item's edit
    budget) are reported once, at the place with the fewest edits.

    An item matches where its whole normalised text stands with at most
    rate * length edits (rounded down), inside words too.  Items of any length
    count: where grams of 8 bytes bound nothing, shorter ones are counted.
    Items that are null or empty when normalised, and null or empty texts,
    match nothing.  Repeated documents and items match alike.
    """
    found = None
    for part in blocks_of(benchmark, block_bytes):
        indexes = Index.all(sorted((r.item_id, r.text) for r in part.collect()), rate)  # at most about BLOCK_BYTES

        def run(batches, indexes=indexes):
            for rows, data, offsets in chunks(batches):
                norm, place, first = normalised(data, offsets)
                ids, h, out = rows.column("doc_id"), rows.column("row"), []
                for index in indexes if len(norm) else []:
                    out += [(ids[t].as_py(), h[t].as_py(), index.ids[i], e, int(place[s] - offsets[t]), int(place[end - 1] + 1 - offsets[t])) for t, i, e, s, end in index.matches(norm, first) if end > s]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "row", "item_id", "edits", "start", "end"])

        part_found = doc_text(docs).withColumn("row", F.xxhash64("text")).mapInArrow(run, MATCH)
        found = part_found if found is None else found.unionByName(part_found)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits (fewest), places (that `find_matches` reports), first_start: one row for each document and item that match.

    Documents without a match have no row.  Rows with a null doc_id match
    under a null doc_id; equal doc_ids are one document.
    """
    places = find_matches(docs, benchmark, rate, block_bytes).dropDuplicates()
    return places.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.count(F.lit(1)).alias("places"), F.min("start").alias("first_start"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in whose text no item was found, all columns as they are."""
    of, row = free_name(docs, "of"), free_name(docs, "of_row")
    marked = find_matches(docs, benchmark, rate).select(F.col("doc_id").alias(of), F.col("row").alias(row)).distinct()
    own = F.xxhash64(F.col("text").cast("string"))
    return docs.join(marked, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (own == F.col(row)), "left_anti")
