"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has eight blocks of a byte.  Two that differ in at most d bits
differ in at most d blocks, so they agree in some 8 - d blocks: each distinct
fingerprint stands under every choice of these, and those with equal blocks
meet.  What is left of a fingerprint beside the blocks has 8 * d bits, which
bounds a group (2**24 fingerprints for d = 3) whatever the number of copies.
Small groups verify the distance of all their pairs; larger ones walk the bit
masks of up to d bits and give only links that join parts, a forest, so their
work is linear in their size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import runs
from .jaccard import NULL_ID, connected
from .shared import doc_text, free_name, written
from .textscan import LOWER, chunks, give_back, ids

SEED, BLOCKS = 42, 8
PAIRS_UP_TO = 32  # groups of up to so many fingerprints compare all their pairs
AT_ONCE = 1 << 16  # shingles whose bits are counted together
HOT = 1000  # a fingerprint is hot if it has over 1 / HOT of the rows: there are fewer than HOT of them


def bit_majority(digests: bytes, n: int) -> int:
    """The bits that are set in over half of n 64-bit digests, as a signed integer."""
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        counts += np.unpackbits(raw[at : at + AT_ONCE], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: bytes, width: int) -> int:
    """Fingerprint of a lower-cased text; 0 without words."""
    held = text.split()
    if not held:
        return 0
    line, digest = b" ".join(held), xxhash.xxh64_digest
    if len(held) <= width:
        return bit_majority(digest(line, SEED), 1)
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(held) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return bit_majority(b"".join([digest(line[s:e], SEED) for s, e in spans]), len(held) - width + 1)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """rid (doc_id, the largest integer for null), fp for each row of docs (doc_id, text)."""

    def run(batches):
        for batch, data, offsets in chunks(batches):
            low = LOWER[data].tobytes()
            fp = [fingerprint(low[s:e], width) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids(batch)), pa.array(fp, pa.int64())], names=["rid", "fp"])

    return doc_text(docs).mapInArrow(run, "rid long, fp long")


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest member's number) after the parts of a[k] and b[k] are joined."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


def forest(values: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of linked pairs of distinct values that connect all that links connect; values differ only in `bits`.

    Every mask of up to `distance` of the bits is tried, small ones first,
    until all is one part.
    """
    short = np.zeros(len(values), np.int64)
    for k, bit in enumerate(bits):
        short |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << len(bits), -1, np.int32)
    place[short] = np.arange(len(values))
    root, left, right = np.arange(len(values)), [], []
    for size in range(1, distance + 1):
        for chosen in combinations(range(len(bits)), size):
            other = place[short ^ sum(1 << k for k in chosen)]
            i = np.flatnonzero(other > np.arange(len(values)))
            j = other[i].astype(np.int64)
            parts = np.sort(np.column_stack([root[i], root[j]]), axis=1)
            new = np.flatnonzero(parts[:, 0] != parts[:, 1])
            if not len(new):
                continue
            new = new[np.unique(parts[new, 0] * len(values) + parts[new, 1], return_index=True)[1]]
            left.append(i[new])
            right.append(j[new])
            root = merged(root, i[new], j[new])
            if not root.any():
                return np.concatenate(left), np.concatenate(right)
    return (np.concatenate(left), np.concatenate(right)) if left else (root[:0], root[:0])


def close_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fp, each once) of at most `distance` differing bits.

    All pairs in small groups; in larger ones as many as connect the same
    components.  A pair may come out more than once.
    """
    if not 0 < distance < 4:
        raise ValueError("distance: 1, 2 or 3")
    free = list(combinations(range(BLOCKS), distance))
    masks = [sum(0xFF << 8 * b for b in range(BLOCKS) if b not in own) for own in free]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])
    dealt = prints.select("fp", F.posexplode(keys).alias("choice", "key")).repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
    bits = [np.array([8 * b + k for b in own for k in range(8)]) for own in free]

    def judge(choice, key, fp):
        """Links of whole groups, sorted."""
        heads = runs(choice, key)
        sizes = np.diff(np.append(heads, len(fp)))
        many, found = np.repeat(sizes, sizes), []
        group = np.repeat(np.arange(len(heads)), sizes)
        for step in range(1, min(PAIRS_UP_TO, int(sizes.max(initial=1)))):
            i = np.flatnonzero((many[:-step] > step) & (many[:-step] <= PAIRS_UP_TO) & (group[:-step] == group[step:]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
            found.append(np.column_stack([fp[i], fp[i + step]]))
        for g in np.flatnonzero(sizes > PAIRS_UP_TO):
            own = fp[heads[g] : heads[g] + sizes[g]]
            i, j = forest(own, bits[choice[heads[g]]], distance)
            found.append(np.column_stack([own[i], own[j]]))
        pairs = np.unique(np.sort(np.concatenate(found).view(np.int64), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    def link(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            choice, key, fp = (batch.column(c).to_numpy() for c in ("choice", "key", "fp"))
            fp = fp.view(np.uint64)
            tail = int(runs(choice, key)[-1])
            if tail or (held and (held[-1][0][-1], held[-1][1][-1]) != (choice[0], key[0])):
                yield judge(*(np.concatenate([h[c] for h in held] + [x[:tail]]) for c, x in enumerate((choice, key, fp))))
                held = []
            held.append((choice[tail:], key[tail:], fp[tail:]))
        if held:
            yield judge(*(np.concatenate([h[c] for h in held]) for c in range(3)))
        give_back()

    return dealt.mapInArrow(link, "a long, b long")


def components(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs (doc_id, text).

    Words are lower-cased (A-Z) runs of other than ASCII white space; the
    fingerprint's bits are those set in over half of the XXH64 hashes of the
    `width`-word shingles, repeats included (fewer words: the whole sequence).
    Texts without words (null or empty) have fingerprint zero and link like any
    other.  component_id is the smallest doc_id reachable by links of at most
    `distance` differing bits, the document's own included.  A null doc_id
    counts as larger than all; a component of such rows only has a null id.
    Rows that share a doc_id are judged by their own texts.  An empty table
    gives no rows.  Other columns are ignored.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("rid").alias("least"), F.count(F.lit(1)).alias("many")), "classes")
    roots = connected(written(close_pairs(classes.select("fp"), distance).distinct(), "close", compact=True))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "many", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component"))
    named = written(rooted.join(heads, F.col("root") == F.col("of")).select(F.col("fp").alias("of"), "many", "component"), "named")
    total = named.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    hot = named.filter(F.col("many") * HOT > total).select(F.col("of").alias("hot"), F.col("component").alias("known"))
    told = prints.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left")  # fewer than HOT rows
    rest = told.filter("hot is null").select("rid", "fp").join(named, F.col("fp") == F.col("of")).select("rid", "fp", "component")
    every = told.filter("hot is not null").select("rid", "fp", F.col("known").alias("component")).unionByName(rest)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return every.select(back("rid").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, all columns as they are; rows with a null doc_id stay."""
    name = free_name(docs, "kept")
    kept = components(docs, width, distance).filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
