"""N-gram Jaccard join over prefix trees.

A document's set holds the hashes of its 5-word shingles in one global order:
shingles that are frequent in some part of the corpus come last, all else goes
by hash.  Documents with equal sets are one class.  Two classes that link share
a token among the first |x| - ceil(3|x|/4) + 1 of either, so classes meet by
these tokens, in packed exchanges; length and position filters thin the pairs.
Candidates are verified against a trie of their ordered sets: partial overlaps
are shared along common paths, and a subtree is left as soon as the remaining
lengths cannot reach the overlap that is needed.  Before sets travel, bitmaps of
four to eight bits a token bound each pair's overlap from above.

Groups of up to 16 classes give all their pairs.  Larger groups first give
pairs with two hubs and the next class.  Classes of such a group that these
links have not connected are then met in blocks: a task holds two blocks, and
of their pairs only those come out that lie in different components and pass
length, position and bitmap bounds; tries verify them.  This goes by bands of a
hash of the pair, each STEP times as wide as all before it, and each sees the
components that the bands before it have left: where many pairs of a family
link, few of them connect it, and the others never come out.  After a random
share p of the links, n classes have n / p links between components at most
(on average), so a band gives about STEP * n.  The last band ends the range of
the hash, so no link between components is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exchange import BLOB, ROW, TABLE, as_rows, pack, runs, text_rows, unpack
from .shared import free_name, partitions, written
from .textscan import LOWER, U64, Rolling, chunks, give_back, ids, mix, row_of, whitespace_words, windows, word_hashes, words

IS_WORD = whitespace_words()
WORDS, SMALL, HOT_TABLE, SEGMENT, MEMBERS = 5, 16, 200_000, 2_000_000, 512
EDGES = 100_000  # links a task when components are labelled
GROUP_BLOCK, MAP_BYTES = 256, 256  # classes of a block of a large group; bytes of a bitmap that travels with each of them
STEP = 16  # a band is to give so many pairs a class, or is so many times as wide as all before it
EVERY, WAITING = 1 << 31, 1 << 21  # no group has over EVERY classes; candidate pairs that wait in a task
WIDTHS = (5, 8, 4, 4)
MET = "kind int, a long, b long, n int, m int, bits binary"
DOC, PAIR, GROUP, BITS = 0, 1, 2, 3
MAPS = 3  # a kind of packed rows: bitmaps of classes
NULL_ID = np.iinfo(np.int64).max


def needed(x, y):
    """Smallest overlap of sets of these sizes with 100 * overlap >= 75 * union."""
    return -(-3 * (x + y) // 7)


def probe_prefix(x):
    return x - -(-3 * x // 4) + 1


def index_prefix(x):
    """Prefix of the smaller set of a pair."""
    return x - -(-6 * x // 7) + 1


def token_sets(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct tokens in global order, and where each text's begin."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, IS_WORD)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    rolling = Rolling(word_hashes(low, starts, ends))
    at = windows(first, WORDS)
    row = row_of(first)[at]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WORDS))
    h = np.concatenate([rolling.of(at, at + WORDS), rolling.of(first[short], first[short + 1])]) >> U64(1)
    row = np.concatenate([row, short])
    if len(hot):
        found = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        h |= (hot[found] == h).astype(np.uint64) << U64(63)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    fresh = runs(row, h)
    return h[fresh], np.searchsorted(row[fresh], np.arange(n + 1))


def fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; 0 for the empty one."""
    if not len(tokens):
        return np.zeros(len(bounds) - 1, np.int64)
    sizes = np.diff(bounds).astype(np.uint64)
    fp = mix(Rolling(mix(tokens)).raw(bounds[:-1], bounds[1:]) + sizes * U64(0x9E3779B97F4A7C15)).view(np.int64)
    return np.where(sizes > 0, np.where(fp == 0, 1, fp), 0)


def frequent_tokens(rows: DataFrame) -> np.ndarray:
    """Up to HOT_TABLE tokens that stand in many documents; they only shape the order, so the bound costs no result."""

    def count(batches):
        held, n_docs, n_tokens = [], 0, 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(3, 5e-4 * n_docs)
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for _, data, offsets in chunks(batches):
            tokens, _ = token_sets(data, offsets, np.zeros(0, np.uint64))
            held.append(tokens)
            n_docs, n_tokens = n_docs + len(offsets) - 1, n_tokens + len(tokens)
            if n_tokens >= SEGMENT:
                yield flush()
                held, n_docs, n_tokens = [], 0, 0
        if n_tokens:
            yield flush()

    counted = rows.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.desc("n"), "token").limit(HOT_TABLE).toArrow()
    return np.sort(got.column("token").to_numpy().view(np.uint64))


def map_bits(size):
    """Bits of a set's bitmap: a power of two, at least four a token."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1) * 4)).astype(np.int64))


def bitmaps(tokens: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> list[bytes]:
    """The bitmap of each of these texts' sets; leading bits of the tokens' hashes are the places."""
    bits = map_bits(np.diff(bounds)[texts])
    sizes = np.diff(bounds)[texts]
    ends = np.cumsum(bits)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[texts], sizes)
    shift = U64(64) - np.log2(bits).astype(np.uint64)
    held = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    held[(ends - bits)[owner] + (mix(tokens[at]) >> shift[owner]).astype(np.int64)] = 1
    raw = np.packbits(held).tobytes()
    return [raw[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), ends.tolist(), strict=True)]


def overlap_bound(a: bytes, size_a: int, b: bytes, size_b: int) -> int:
    """An upper bound of the overlap: bits that only one set has are tokens that only it has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = np.unpackbits(x), np.unpackbits(y)
        while len(x) > len(y):
            x = x.reshape(-1, 2).max(axis=1)
        while len(y) > len(x):
            y = y.reshape(-1, 2).max(axis=1)
        return int(min(size_a - np.count_nonzero(x & ~y & 1), size_b - np.count_nonzero(y & ~x & 1)))
    return int(min(size_a - np.bitwise_count(x & ~y).sum(), size_b - np.bitwise_count(y & ~x).sum()))


def candidate_mask(size_a, pos_a, size_b, pos_b):
    """Length, prefix and position filters of pairs that share the token at these positions."""
    larger, smaller = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    pos_small = np.where(size_a <= size_b, pos_a, pos_b)
    # Of two sets of one size either may count as the smaller.
    pos_small = np.where(size_a == size_b, np.minimum(pos_a, pos_b), pos_small)
    left = 1 + np.minimum(size_a - pos_a - 1, size_b - pos_b - 1)
    return (4 * smaller >= 3 * larger) & (pos_small < index_prefix(smaller)) & (left >= needed(size_a, size_b))


def meet_tokens(rows: DataFrame, hot: np.ndarray, small: int = SMALL) -> DataFrame:
    """kind DOC (rid, fp, size), PAIR (fp, fp) and GROUP (token, fp, size, position) rows."""
    n = partitions(rows.sparkSession)
    order_table = rows.sparkSession.sparkContext.broadcast(hot)  # at most HOT_TABLE integers

    def send(batches):
        for batch, data, offsets in chunks(batches):
            tokens, bounds = token_sets(data, offsets, order_table.value)
            fp, sizes = fingerprints(tokens, bounds), np.diff(bounds)
            table = np.column_stack([ids(batch, "rid"), fp, sizes]).astype(np.int64).tobytes()
            chunk = int.from_bytes(hashlib.blake2b(table, digest_size=8).digest(), "little", signed=True)
            _, one = np.unique(fp, return_index=True)
            one = np.sort(one[sizes[one] > 0])
            lengths = probe_prefix(sizes[one])
            owner = np.repeat(one, lengths)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keys = tokens[bounds[owner] + pos]
            out = [(chunk % n, TABLE, chunk, table)]
            maps: dict[int, list[bytes]] = {}
            for f, size, raw in zip(fp[one].tolist(), sizes[one].tolist(), bitmaps(tokens, bounds, one), strict=True):
                maps.setdefault(f % n, []).append(np.array([f, size], np.int64).tobytes() + raw)
            out += [(b, MAPS, chunk, b"".join(raws)) for b, raws in maps.items()]
            out += [(b, BLOB, chunk, raw) for b, raw in pack(n, keys, owner, [fp[owner].view(np.uint64), sizes[owner].astype(np.uint64), pos.astype(np.uint64)], WIDTHS)]
            yield as_rows(out)

    def rows_of(kind, a, b, size, pos, bits=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(size.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(bits or [None] * len(a), pa.binary())], names=["kind", "a", "b", "n", "m", "bits"])

    def map_rows(raws, seen):
        """Each class's bitmap once: all of a class's come to one partition."""
        found, sizes, maps = [], [], []
        for raw in raws:
            at = 0
            while at < len(raw):
                f, size = np.frombuffer(raw, np.int64, 2, at).tolist()
                end = at + 16 + int(map_bits(size)) // 8
                if f not in seen:
                    seen.add(f)
                    found.append(f)
                    sizes.append(size)
                    maps.append(raw[at + 16 : end])
                at = end
        zeros = np.zeros(len(found), np.int64)
        return rows_of(BITS, np.array(found, np.int64), zeros, np.array(sizes, np.int64), zeros, maps)

    def meet(batches):
        blobs, seen = [], set()
        for batch in batches:
            for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind == BLOB:
                    blobs.append(unpack(raw, WIDTHS))
                elif kind == MAPS:
                    yield map_rows([raw], seen)
                else:
                    t = np.frombuffer(raw, dtype=np.int64).reshape(-1, 3)
                    yield rows_of(DOC, np.ascontiguousarray(t[:, 0]), np.ascontiguousarray(t[:, 1]), t[:, 2], np.zeros(len(t)))
        if not blobs:
            return
        keys, _, fp, size, pos = (np.concatenate([b[i] for b in blobs]) for i in range(5))
        del blobs
        fp, size, pos = fp.view(np.int64), size.astype(np.int64), pos.astype(np.int64)
        order = np.argsort(keys, kind="stable")
        heads = runs(keys[order])
        counts = np.diff([*heads, len(keys)])
        order = order[np.repeat(counts > 1, counts)]
        keys, fp, size, pos = keys[order], fp[order], size[order], pos[order]
        order = np.lexsort((fp, size, keys))
        order = order[runs(keys[order], size[order], fp[order])]
        keys, fp, size, pos = keys[order], fp[order], size[order], pos[order]
        heads = runs(keys)
        counts = np.diff([*heads, len(keys)])
        group, count = np.repeat(np.arange(len(heads)), counts), np.repeat(counts, counts)
        found = []

        def pair_rows(found):
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            zeros = np.zeros(len(pairs))
            return rows_of(PAIR, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), zeros, zeros)

        def pair(i, j, hub=False):
            good = candidate_mask(size[i], pos[i], size[j], pos[j]) & (fp[i] != fp[j])
            ends = np.column_stack([fp[i[good]], fp[j[good]]])
            found.append(ends if hub else np.sort(ends, axis=1))

        for step in range(1, min(small, int(counts.max(initial=1)))):
            i = np.arange(len(keys) - step)
            near = (group[i] == group[i + step]) & (count[i] <= small)
            pair(i[near], i[near] + step)
            if sum(map(len, found)) > WAITING:
                yield pair_rows(found)
                found.clear()
        large = np.flatnonzero(count > small)
        if len(large):
            # The smallest set, the smallest fingerprint, and the next fingerprint: much the same pairs in every group of one family.
            by_fp = np.lexsort((fp, group))
            pair(heads[group[large]], large, hub=True)
            pair(by_fp[heads][group[large]], large, hub=True)
            i = np.arange(len(keys) - 1)
            i = i[(group[i] == group[i + 1]) & (count[i] > small)]
            pair(by_fp[i], by_fp[i + 1])
            yield rows_of(GROUP, keys[large].view(np.int64), fp[large], size[large], pos[large])
        yield pair_rows(found)
        del keys, fp, size, pos, order, group, count, found
        give_back()

    return rows.select("rid", "text").mapInArrow(send, ROW).repartitionById(n, F.col("bucket")).mapInArrow(meet, MET)


class PrefixTree:
    """Ordered sets as the paths of a trie: sorted sets, each known from where it leaves its predecessor."""

    STEP = 128

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            differs = a[:m] != b[:m]
            self.shared.append(int(differs.argmax()) if differs.any() else m)

    def linked(self, probe: np.ndarray) -> list[int]:
        """Numbers of the sets that reach the overlap needed with probe."""
        longest = max((len(s) for s in self.sets), default=0)
        hits, place = np.zeros(longest + 1, np.int64), np.zeros(longest + 1, np.int64)
        done, out, n = 0, [], len(probe)
        for number, held, shared in zip(self.order, self.sets, self.shared, strict=True):
            depth = done = min(done, shared)
            need = int(needed(n, len(held)))
            while hits[depth] + min(len(held) - depth, n - place[depth]) >= need:
                if depth == len(held):
                    out.append(number)
                    break
                part = held[depth : depth + self.STEP]
                at = np.searchsorted(probe, part)
                same = probe[np.minimum(at, n - 1)] == part
                np.cumsum(same, out=hits[depth + 1 : depth + 1 + len(part)])
                hits[depth + 1 : depth + 1 + len(part)] += hits[depth]
                place[depth + 1 : depth + 1 + len(part)] = at + same
                depth += len(part)
                done = depth
        return out


def thinned(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """a, b of the pairs whose bitmaps allow the overlap needed; maps: fp, n, bits."""
    x, y = (maps.select(F.col("fp").alias("fp" + s), F.col("n").alias("n" + s), F.col("bits").alias("bits" + s)) for s in "xy")
    both = pairs.join(x, F.col("a") == F.col("fpx")).join(y, F.col("b") == F.col("fpy")).select("a", "b", "nx", "bitsx", "ny", "bitsy")

    def run(batches):
        for batch in batches:
            good = [overlap_bound(bx, nx, by, ny) >= needed(nx, ny) for nx, bx, ny, by in zip(*(batch.column(c).to_pylist() for c in ("nx", "bitsx", "ny", "bitsy")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def verify_pairs(pairs: DataFrame, owners: DataFrame, rows: DataFrame, hot: np.ndarray, block: int = MEMBERS) -> DataFrame:
    """a, b of the pairs of classes (a written table) whose sets link: each a probes tries of up to about `block` of its partners."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members")).withColumnRenamed("a", "hub")
    salted = pairs.join(sizes, F.col("a") == F.col("hub")).select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / block)).cast("int").alias("salt"), "b")
    probes = salted.select("a", "salt", F.col("a").alias("fp"), F.lit(1).alias("role")).distinct()
    uses = salted.select("a", "salt", F.col("b").alias("fp"), F.lit(0).alias("role")).unionByName(probes)
    return search(uses, owners, rows, hot)


class Block:
    """Classes of one token group, as arrays."""

    def __init__(self, members: pa.StructArray):
        self.fp, self.n, self.m, self.root, self.before = (members.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "n", "m", "root", "before"))
        raws = members.field("bits").to_pylist()
        self.length = np.array([len(raw) for raw in raws], np.int64)
        self.place = np.zeros(len(raws), np.int64)
        self.maps = {}
        for length in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == length)
            self.place[own] = np.arange(len(own))
            self.maps[length] = np.frombuffer(b"".join(raws[i] for i in own), np.uint8).reshape(len(own), length)

    def of(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of these rows (all of one length), folded to `width` bytes."""
        return folded(self.maps[int(self.length[rows[0]])][self.place[rows]], width)


def folded(matrix: np.ndarray, width: int) -> np.ndarray:
    while matrix.shape[1] > width:
        pairs = (matrix | matrix << 1) & 0xAA  # each even place holds either of two bits
        matrix = np.packbits(np.unpackbits(pairs, axis=1)[:, ::2], axis=1)
    return matrix


def pairs_apart(x: Block, y: Block, low: float = 0.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, whether a bitmap was folded) of pairs of the band low <= hash < high that lie in different components and may link.

    Pairs that share the token before this one meet there already.
    """
    apart = (x.root[:, None] != y.root[None, :]) & ((x.before[:, None] != y.before[None, :]) | (x.before[:, None] == 0))
    if x is y:
        apart = np.triu(apart, 1)
    i, j = np.nonzero(apart & candidate_mask(x.n[:, None], x.m[:, None], y.n[None, :], y.m[None, :]))
    at = mix((x.fp[i] ^ y.fp[j]).view(np.uint64)) * 2.0**-64
    inside = (at >= low) & ((at < high) | (high >= 1))
    i, j = i[inside], j[inside]
    good = np.zeros(len(i), dtype=bool)
    kinds = x.length[i] << 32 | y.length[j]
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        width = int(min(kind >> 32, kind & 0xFFFFFFFF))
        for part in np.array_split(own, -(-len(own) * width // (4 << 20))):
            a, b = i[part], j[part]
            u, v = x.of(a, width), y.of(b, width)
            left = np.minimum(x.n[a] - np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64), y.n[b] - np.bitwise_count(v & ~u).sum(axis=1, dtype=np.int64))
            good[part] = left >= needed(x.n[a], y.n[b])
    i, j = i[good], j[good]
    return i, j, (map_bits(x.n[i]) > 8 * MAP_BYTES) | (map_bits(y.n[j]) > 8 * MAP_BYTES)


def in_components(groups: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (token, fp, n, m: size and position) with root, and (token, many, apart) of those whose classes aren't all connected: classes, and ordered pairs of them in different components."""
    labelled = groups.join(roots, F.col("fp") == F.col("node"), "left").select("token", "fp", "n", "m", F.coalesce("root", "fp").alias("root"))
    labelled = written(labelled, "labelled")
    sizes = labelled.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    square = F.col("c").cast("double") * F.col("c")
    stands = sizes.groupBy("token").agg(F.sum("c").alias("many"), F.sum(square).alias("within"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("token", "many", (F.col("many").cast("double") * F.col("many") - F.col("within")).alias("apart"))
    return labelled, written(stands, "stands", compact=True)


def group_candidates(labelled: DataFrame, stands: DataFrame, maps: DataFrame, size: int = GROUP_BLOCK, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """a, b: classes of one token group but of different components whose bitmaps allow a link, of a band of pairs.

    labelled, stands: `in_components`.  Groups whose classes are all connected
    are left alone.  A group is cut into blocks of about `size` classes; pairs
    of blocks meet in tasks, and only pairs that pass come out.
    """
    blocks = F.ceil(F.col("many") / size).cast("int")
    still = labelled.join(stands.select(F.col("token").alias("open"), blocks.alias("blocks")), F.col("token") == F.col("open")).drop("open")
    before = F.coalesce(F.lag("token").over(W.partitionBy("fp").orderBy("m")), F.lit(0))

    def fold(batches):
        for batch in batches:
            raws = [folded(np.frombuffer(raw, np.uint8)[None, :], MAP_BYTES).tobytes() if len(raw) > MAP_BYTES else raw for raw in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(raws, pa.binary())], names=["of", "bits"])

    # A class stands in the groups of its whole prefix, so what travels with it is bounded by MAP_BYTES.
    short = maps.select("fp", "bits").mapInArrow(fold, "of long, bits binary")
    packed = still.withColumn("before", before).join(short, F.col("fp") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    packed = packed.groupBy("token", "block", "blocks").agg(F.collect_list(F.struct("fp", "n", "m", "root", "before", "bits")).alias("members"))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.groupBy("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).agg(F.collect_list("members").alias("sides"))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column("sides").slice(k, 1).flatten()
                sides = [Block(held.slice(s, 1).flatten()) for s in range(len(held))]
                i, j, fold = pairs_apart(sides[0], sides[-1], low, high)
                if len(i):
                    ends = np.sort(np.column_stack([sides[0].fp[i], sides[-1].fp[j]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1])), pa.array(fold)], names=["a", "b", "folded"])

    found = written(met.select("sides").mapInArrow(compare, "a long, b long, folded boolean").distinct(), "apart")
    return found.filter("not folded").select("a", "b").unionByName(thinned(found.filter("folded").select("a", "b"), maps))


def search(uses: DataFrame, owners: DataFrame, rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """a, b: links of each probe (role 1) with the sets of the trie (role 0) of the same (a, salt)."""
    order_table = rows.sparkSession.sparkContext.broadcast(hot)
    wanted = uses.groupBy("fp").agg(F.collect_list(F.struct("a", "salt", "role")).alias("uses")).join(owners, "fp").select("fp", F.col("rid").alias("of"), "uses")

    def build(batches):
        for batch, data, offsets in chunks(batches):
            tokens, bounds = token_sets(data, offsets, order_table.value)
            fp = fingerprints(tokens, bounds)
            own = np.flatnonzero(fp == batch.column("fp").to_numpy())
            uses = batch.column("uses").to_pylist()
            out = [(u["a"], u["salt"], int(fp[i]), u["role"], tokens[bounds[i] : bounds[i + 1]].tobytes()) for i in own for u in uses[i]]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["a", "salt", "fp", "role", "tokens"])

    held = rows.join(wanted.hint("shuffle_hash"), F.col("rid") == F.col("of")).select("fp", "text", "uses").mapInArrow(build, "a long, salt int, fp long, role int, tokens binary")

    def check(batches):
        key, held, tree = None, {}, None
        for batch in batches:
            found = []
            for a, salt, fp, role, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "fp", "role", "tokens")), strict=True):
                if key != (a, salt):
                    key, held, tree = (a, salt), {}, None
                tokens = np.frombuffer(raw, dtype=np.uint64)
                if role == 0:
                    held[fp] = tokens
                    continue
                if tree is None:
                    names, tree = list(held), PrefixTree(list(held.values()))
                found += [(fp, names[i]) for i in tree.linked(tokens) if names[i] != fp]
            cols = list(zip(*found, strict=True)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    n = partitions(rows.sparkSession)
    return held.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(check, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """node, root of every node that has a link; root is the smallest node it reaches.

    Each round takes the smallest label of the neighbours, then the label of
    that label; a table in the shared folder ends each round.  Few links take
    few tasks: one for EDGES of them, or one a core.
    """
    spark, found = links.sparkSession, Observation()
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    edges = written(both.observe(found, F.count(F.lit(1)).alias("n")), "edges")
    tasks = max(spark.sparkContext.defaultParallelism, -(-found.get["n"] // EDGES))
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).coalesce(tasks), "labels")
    while found.get["n"]:
        heard = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root", F.lit(None).cast("long").alias("old"))
        better = heard.unionByName(labels.withColumn("old", F.col("root"))).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("of"), F.col("root").alias("further"))
        changes = Observation()
        moved = better.join(jump, F.col("root") == F.col("of"), "left").select("node", F.least("root", "further").alias("root"), "old")
        labels = written(moved.observe(changes, F.count(F.when(F.col("root") != F.col("old"), 1)).alias("n")).select("node", "root").coalesce(tasks), "labels")
        if not changes.get["n"]:
            break
    return labels


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (see `connected`) after more links: only the components that these join are labelled anew."""
    ends = links
    for side in ("a", "b"):
        of = roots.select(F.col("node").alias("of"), F.col("root").alias("known"))
        ends = ends.join(of, F.col(side) == F.col("of"), "left").withColumn(side, F.coalesce("known", side)).select("a", "b")
    tops = connected(ends.filter("a <> b")).select(F.col("node").alias("of"), F.col("root").alias("top"))
    fresh = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    known = roots.unionByName(fresh.withColumn("root", F.col("node"))).groupBy("node").agg(F.min("root").alias("root"))
    return written(known.join(tops, F.col("root") == F.col("of"), "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def link_classes(docs: DataFrame, small: int = SMALL, block: int = MEMBERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rid, fp, size of every row; a, b: links between classes; node, root: classes by component).

    Groups of over `small` classes are linked by hubs first, then only classes
    of different components are compared: the links connect what they should,
    but links within a component are missing (`all_links` has them).  Tries
    hold about `block` sets.
    """
    rows = text_rows(docs)
    hot = frequent_tokens(rows)
    met = written(meet_tokens(rows, hot, small), "met")
    members = met.filter(F.col("kind") == DOC).select(F.col("a").alias("rid"), F.col("b").alias("fp"), F.col("n").alias("size"))
    owners = members.groupBy("fp").agg(F.min("rid").alias("rid"))
    maps = met.filter(F.col("kind") == BITS).select(F.col("a").alias("fp"), "n", "bits")
    first = met.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    links = written(verify_pairs(written(thinned(first, maps), "pairs"), owners, rows, hot, block), "links", compact=True)
    roots = connected(links)
    groups = met.filter(F.col("kind") == GROUP).select(F.col("a").alias("token"), F.col("b").alias("fp"), "n", "m")
    low, high = 0.0, 0.0
    while low < 1:
        labelled, stands = in_components(groups, roots)
        at = stands.agg(F.sum("many").alias("n"), F.sum("apart").alias("apart")).collect()[0]
        if not at.n:
            break
        # The pairs that are still apart tell how wide a band gives STEP of them a class; one that holds them all is the last.
        high = min(1.0, max(STEP * high, low + STEP * at.n / at.apart))
        more = written(group_candidates(labelled, stands, maps, max(2, min(GROUP_BLOCK, block // 2)), low, high), "more", compact=True)
        late = written(verify_pairs(more, owners, rows, hot, block), "late", compact=True)
        if late.limit(1).count():
            links, roots = links.unionByName(late), merged(roots, late)
        low = high
    return members, links, roots


def components(docs: DataFrame, small: int = SMALL, block: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    Words are lower-cased (A-Z) runs of other than ASCII white space; fewer
    than five words count as one shingle.  Documents link when 100 * overlap
    >= 75 * union of their shingle sets.  component_id is the smallest doc_id
    reachable by links, the document's own included.  Documents without words
    (null or empty text) have no shingles and link with nothing.  A null doc_id
    counts as larger than all; a component of such rows only has a null id.
    Repeated rows are linked.  Equal sets are told by a 64-bit fingerprint.
    """
    members, _, roots = link_classes(docs, small, block)
    of = members.join(roots, F.col("fp") == F.col("node"), "left").select("rid", "size", F.coalesce("root", "fp").alias("root"))
    of = written(of, "classes")
    least = of.filter("size > 0").groupBy(F.col("root").alias("class")).agg(F.min("rid").alias("least"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    joined = of.filter("size > 0").join(least, F.col("root") == F.col("class")).select(back("rid").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), back("least").alias("component_id"))
    alone = of.filter("size = 0").select(back("rid").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), back("rid").alias("component_id"))
    return joined.unionByName(alone)


def all_links(docs: DataFrame, block: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(rid, fp, size of every row; a, b with a < b: every link between classes, once).

    Every class probes tries of all its partners, in groups of any size: no
    pair is left out because its classes are connected already.  Work and rows
    can grow with the square of a family of near copies, as its links do.
    """
    rows = text_rows(docs)
    hot = frequent_tokens(rows)
    met = written(meet_tokens(rows, hot, EVERY), "met")
    members = met.filter(F.col("kind") == DOC).select(F.col("a").alias("rid"), F.col("b").alias("fp"), F.col("n").alias("size"))
    owners = members.groupBy("fp").agg(F.min("rid").alias("rid"))
    maps = met.filter(F.col("kind") == BITS).select(F.col("a").alias("fp"), "n", "bits")
    pairs = written(thinned(met.filter(F.col("kind") == PAIR).select("a", "b").distinct(), maps), "pairs")
    links = verify_pairs(pairs, owners, rows, hot, block)
    return members, written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", compact=True)


def link_counts(docs: DataFrame, block: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, n_links for each row of docs: how many different shingle sets its own links with (see `components`)."""
    members, links = all_links(docs, block)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    of = members.join(ends, F.col("fp") == F.col("node"), "left")
    return of.select(F.when(F.col("rid") != NULL_ID, F.col("rid")).alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, all columns as they are.

    Rows with a null doc_id stay; repeated rows of the smallest doc_id do too.
    """
    name = free_name(docs, "kept")
    kept = components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS r FROM words UNION SELECT reach.node, edges.y FROM reach JOIN edges ON reach.r = edges.x)
SELECT w.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.r) AS component_id
FROM words w JOIN reach r ON r.node = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""
