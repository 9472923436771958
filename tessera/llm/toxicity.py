"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Each class has an interpolated Kneser-Ney model of the bytes of a text, lower-
cased and with one boundary between words, given the five bytes before them,
also those of the words before.  Counts above 0 are discounted by DISCOUNT at
every order; what that leaves goes to the next order down: the class's own
counts (all labelled rows outside fold 0) from ORDER to SHARED bytes, then
continuation counts and byte pairs of all texts, which both classes share.  So
rare expressions count, and are smoothed by their parts.

Each word has the difference of its toxic and its ordinary log-likelihood.  A
document has their length-normalised mean in the exponential sense,
log(mean(exp(SHARPNESS * difference))) / SHARPNESS over its words: the plain
mean, in which SHARPNESS is near 0, drowns a few toxic words of a long
document.  A curve that can only rise turns it into a probability: a logistic one
over how rare such a score is among ordinary rows.  It is fitted on a bounded
number of labelled rows (`per_class`), scored by counts without these rows.

Counts are a table of grams, dealt by the two bytes before the last: grams of
three bytes and more meet all that share their context or their end there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import as_rows, low_bytes, packed, to_planes, unpacked, wide
from .langid import fold
from .shared import doc_text, partitions, written
from .textscan import LOWER, U64, alnum_words, chunks, give_back, mix, row_of, words

ORDER, SHARED, DISCOUNT, SHARPNESS = 6, 3, 0.9, 0.75
_IS_WORD = alnum_words()
BOUNDARY = 0x20
ALL, ORDINARY, TOXIC, FIT = 0, 1, 2, 2  # columns of counts; FIT is added for those without the curve's rows
HELD = 1 << 21
LABELS_TO_BROADCAST, GRAMS_TO_BROADCAST = 1_000_000, 4_000_000


def corpus_pairs(docs: DataFrame) -> np.ndarray:
    """How often each byte follows each other one in the lower-cased texts of all documents (256 x 256)."""

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for _, data, offsets in chunks(batches):
            low = LOWER[data]
            low = np.where(_IS_WORD[low], low, BOUNDARY).astype(np.int32)
            inside = np.ones(max(len(low) - 1, 0), dtype=bool)
            ends = offsets[1:-1]
            inside[ends[(ends > 0) & (ends < len(low))] - 1] = False  # no pair reaches into another text
            total += np.bincount((low[:-1] * 256 + low[1:])[inside], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["pair", "n"])

    got = doc_text(docs).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most 65536 rows
    out = np.zeros(1 << 16, dtype=np.float64)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(256, 256)


def gram(flat: np.ndarray, k: int) -> np.ndarray:
    """The k bytes that end at each place, as one integer (the first k - 1 are of no use)."""
    key = flat.astype(np.uint64)
    out = key.copy()
    for i in range(1, k):
        out[i:] |= key[:-i] << U64(8 * i)
    return out


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram that ends at each byte of the words and at the boundary after each; where each word begins; first words of texts.

    A text starts with boundaries only, so no gram reaches into another text.
    """
    low = LOWER[data]
    starts, ends, first = words(low, offsets, _IS_WORD)
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(of)) - begin[of]
    some = np.diff(first) > 0
    at = np.arange(len(of)) + (ORDER - 1) * np.cumsum(some)[row_of(first)][of]
    flat = np.full(len(of) + (ORDER - 1) * int(some.sum()), BOUNDARY, dtype=np.uint8)
    inner = place < sizes[of] - 1
    flat[at[inner]] = low[(starts[of] + place)[inner]]
    return gram(flat, ORDER)[at], begin, first


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, of = np.unique(keys, return_inverse=True)
    return held, np.bincount(of, weights=n, minlength=len(held)).astype(np.int64)


def aligned(keys: np.ndarray, held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values by key; 0 where held lacks the key."""
    if not len(held):
        return np.zeros(len(keys), dtype=values.dtype)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return np.where(held[at] == keys, values[at], values.dtype.type(0))


class Counts:
    """Counts by column and gram; what comes in is summed whenever HELD entries wait."""

    def __init__(self):
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.waiting = 0

    def add(self, column: int, keys: np.ndarray, n: np.ndarray) -> None:
        self.held.setdefault(column, []).append((keys, n))
        self.waiting += len(keys)
        if self.waiting > HELD:
            self.settle()

    def settle(self) -> int:
        self.held = {c: [summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))] for c, parts in self.held.items()}
        self.waiting = 0
        return sum(len(parts[0][0]) for parts in self.held.values())

    def of(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        return self.held[column][0] if column in self.held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Orders:
    """Distinct ends, by order, of grams that are whole by their last three bytes."""

    def __init__(self, grams: np.ndarray):
        self.keys, self.of, self.context = {}, {}, {}
        for k in range(3, ORDER + 1):
            self.keys[k], self.of[k] = np.unique(grams & U64((1 << 8 * k) - 1), return_inverse=True)
            self.context[k] = np.unique(self.keys[k] >> U64(8), return_inverse=True)[1]
        self.grams = grams

    def smoothed(self, n: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
        """Probabilities, by gram, of order k interpolated with p: raw counts at the highest order, continuation counts below."""
        keys, of, context = self.keys[k], self.of[k], self.context[k]
        c = np.bincount(of, weights=n, minlength=len(keys))
        if k < ORDER:
            longer = self.keys[k + 1]
            end = np.searchsorted(keys, longer & U64((1 << 8 * k) - 1))
            begins = keys >> U64(8 * (k - 2)) == U64(BOUNDARY * 257)  # at a text's start nothing else precedes
            c = np.where(begins, c, np.bincount(end, weights=np.bincount(self.of[k + 1], weights=n, minlength=len(longer)) > 0, minlength=len(keys)))
        kept = np.maximum(c - DISCOUNT, 0.0)
        total = np.bincount(context, weights=c)
        left = np.where(total > 0, 1.0 - np.bincount(context, weights=kept) / np.maximum(total, 1.0), 1.0)
        return (kept / np.maximum(total, 1.0)[context])[of] + left[context][of] * p


def log_ratios(grams: np.ndarray, n: list[np.ndarray], pairs: np.ndarray) -> list[np.ndarray]:
    """log P(toxic) - log P(ordinary) of each gram's last byte, by all counts and by those without the curve's rows."""
    orders = Orders(grams)
    shared = ((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 128.0))[(grams >> U64(8) & U64(255)).astype(np.int64), (grams & U64(255)).astype(np.int64)]
    for k in range(3, SHARED + 1):
        shared = orders.smoothed(n[ALL], shared, k)
    own = dict.fromkeys(range(1, 5), shared)
    for k in range(SHARED, ORDER + 1):
        own = {c: orders.smoothed(n[c], p, k) for c, p in own.items()}
    return [np.log(own[TOXIC + more] / own[ORDINARY + more]).astype(np.float32) for more in (0, FIT)]


def text_scores(ratio: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: the exponential mean of its words' differences; 0 without words."""
    out = np.zeros(len(first) - 1)
    if not len(begin):
        return out
    word = np.add.reduceat(ratio.astype(np.float64), begin)
    texts = np.flatnonzero(first[1:] > first[:-1])
    most, size = np.maximum.reduceat(word, first[texts]), np.diff(first)[texts]
    out[texts] = most + np.log(np.add.reduceat(np.exp(SHARPNESS * (word - np.repeat(most, size))), first[texts]) / size) / SHARPNESS
    return out


def looked_up(keys: np.ndarray, held: np.ndarray, values: np.ndarray) -> np.ndarray:
    distinct, of = np.unique(keys, return_inverse=True)
    return aligned(distinct, held, values)[of]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (last: bias) by Newton steps on class-balanced rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (balance * (p - y)) + ridge * w
        hessian = (x * (balance * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def rarity(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """How many times the share of ordinary rows above x has halved; knots: their quantiles at 0, 1/2, 3/4, ..."""
    top = len(knots) - 1
    return np.where(x > knots[-1], top + np.log1p(np.maximum(x - knots[-1], 0.0)), np.interp(x, knots, np.arange(top + 1)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int) -> DataFrame:
    """doc_id, text, label (0 or 1), half of about `per_class` labelled rows a class whose fold is not 0.

    The chosen ids are bounded, so they may be broadcast.  A doc_id with both labels is left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(modulus) != 0))
    one = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    counts = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / counts.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / counts.get(0, 1))))
    chosen = one.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) > 0)
    return doc_text(docs).join(F.broadcast(chosen), "doc_id")


def classes(labels: DataFrame, label: str, modulus: int) -> DataFrame:
    """doc_id, label (0 or 1) of labelled rows whose fold is not 0; a doc_id with both labels is left out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(modulus) != 0))
    return own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def gram_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Packed counts of the grams of all rows of docs, and of those of each class; known: doc_id, label, curve."""
    n = partitions(docs.sparkSession)

    def sent(counts):
        counts.settle()
        for column in counts.held:
            keys, times = counts.of(column)
            bucket = (mix(keys >> U64(8) & U64(0xFFFF)) % U64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=n))
            starts = np.concatenate([[0], ends[:-1]])
            yield as_rows([(b, column, 0, packed(keys[order[starts[b] : ends[b]]]) + to_planes(low_bytes(times[order[starts[b] : ends[b]]], 8))) for b in np.flatnonzero(ends > starts).tolist()])

    def count(batches):
        counts = Counts()
        for rows, data, offsets in chunks(batches):
            keys, begin, first = laid_out(data, offsets)
            counts.add(ALL, *np.unique(keys, return_counts=True))
            label, curve = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("label", "curve"))
            sizes = np.diff([*begin, len(keys)])[: len(begin)]
            code = np.repeat(np.repeat(label * 2 + curve, np.diff(first)), sizes)
            for c in (0, 1):
                fit, both = keys[code == 2 * c], keys[(code == 2 * c) | (code == 2 * c + 1)]
                for column, own in ((ORDINARY + c, both), (ORDINARY + c + FIT, fit)):
                    if len(own):
                        counts.add(column, *np.unique(own, return_counts=True))
            if not counts.waiting and sum(len(k) for parts in counts.held.values() for k, _ in parts) > HELD:
                yield from sent(counts)
                counts = Counts()
        yield from sent(counts)
        give_back()

    rows = doc_text(docs).join(known, "doc_id", "left").select("text", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce(F.col("curve").cast("int"), F.lit(0)).alias("curve"))
    return rows.mapInArrow(count, "bucket int, kind int, chunk long, payload binary").repartitionById(n, F.col("bucket"))


def model_table(docs: DataFrame, known: DataFrame, pairs: np.ndarray) -> DataFrame:
    """gram, ratio, fit: the log-ratio of the classes for each gram of the texts, by all counts and by those without the curve's rows."""

    def build(batches):
        counts = Counts()
        for batch in batches:
            for column, raw in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                half = len(raw) // 2
                counts.add(column, unpacked(raw[:half]), wide(np.frombuffer(raw[half:], dtype=np.uint8).reshape(8, -1)).astype(np.int64))
        counts.settle()
        grams = counts.of(ALL)[0]
        if len(grams):
            ratio, fit = log_ratios(grams, [aligned(grams, *counts.of(c)) for c in range(5)], pairs)
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(ratio), pa.array(fit)], names=["gram", "ratio", "fit"])
        del counts
        give_back()

    return gram_counts(docs, known).mapInArrow(build, "gram long, ratio float, fit float")


def with_differences(rows: DataFrame, model: DataFrame, value: str, fields: str, broadcast: bool) -> DataFrame:
    """`fields` of rows (which have text too) and x, the score of their texts by a column of the model.

    broadcast: the model's grams are few.  Else texts are written as units of
    a batch each, their distinct grams are joined with the model, and the
    answers meet their unit again.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    schema = fields + ", x double"

    def made(chunk, data, offsets, held, values):
        keys, begin, first = laid_out(data, offsets)
        x = text_scores(looked_up(keys, held, values), begin, first)
        return pa.RecordBatch.from_arrays([*(chunk.column(c) for c in names), pa.array(x)], names=[*names, "x"])

    if broadcast:
        got = model.select("gram", value).toArrow()  # at most GRAMS_TO_BROADCAST
        order = np.argsort(got.column("gram").to_numpy())
        table = rows.sparkSession.sparkContext.broadcast((got.column("gram").to_numpy()[order].astype(np.uint64), got.column(value).to_numpy()[order]))

        def run(batches):
            for chunk, data, offsets in chunks(batches):
                yield made(chunk, data, offsets, *table.value)

        return rows.select(*names, "text").mapInArrow(run, schema)

    units = written(rows.select(*names, "text", (F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / 1000)).alias("unit")), "units")

    def asked(batches):
        for chunk, data, offsets in chunks(batches):
            keys, begin, first = laid_out(data, offsets)
            unit = np.repeat(np.repeat(chunk.column("unit").to_numpy(), np.diff(first)), np.diff([*begin, len(keys)])[: len(begin)])
            for u in np.unique(unit):
                own = np.unique(keys[unit == u]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), u)), pa.array(own)], names=["unit", "gram"])

    answers = units.select("unit", "text").mapInArrow(asked, "unit long, gram long").join(model.select("gram", F.col(value).alias("value")), "gram")

    def met(texts, replies):
        replies = replies.combine_chunks()
        held, at = np.unique(replies.column("gram").to_numpy().astype(np.uint64), return_index=True)
        values = replies.column("value").to_numpy().astype(np.float32)[at]
        return pa.Table.from_batches([made(*c, held, values) for c in chunks(texts.combine_chunks().to_batches())])

    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(met, schema)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = 3000, modulus: int = 5, grams_to_broadcast: int = GRAMS_TO_BROADCAST) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels: doc_id, toxic.

    All labelled rows outside fold 0 (crc32 of the id as text, modulo
    `modulus`) are learned from; the curve is fitted on a third of at most
    about `per_class` of each class.  score is 0 to 1, also for null and empty
    texts (no evidence: what the curve says of no difference).  Without
    labels of both classes every score is 0.  Null labels are ignored; an id
    with both labels too.  A null doc_id counts as fold 0.  Repeated rows get
    equal scores.
    """
    own = doc_text(docs)
    one = classes(labels, "toxic", modulus)
    counts = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / counts.get(1, 1)))).otherwise(F.lit(min(1.0, per_class / counts.get(0, 1))))
    drawn = (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)) & (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3)) == 0)
    known = one.withColumn("curve", drawn)
    if sum(counts.values()) <= LABELS_TO_BROADCAST:
        known = F.broadcast(known)
    result = "doc_id long, held_out boolean, score double, predicted int"
    rows = own.withColumn("held_out", fold(modulus) == 0)
    there = {r.label for r in own.select("doc_id").join(known, "doc_id").select("label").distinct().collect()} if len(counts) == 2 else set()
    if len(there) < 2:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = written(model_table(docs, known, corpus_pairs(docs)), "toxicity")
    few = model.count() <= grams_to_broadcast
    sample = own.join(F.broadcast(known.filter("curve")), "doc_id").select("label", "text")  # bounded by per_class
    got = with_differences(sample, model, "fit", "label int", few).toArrow()
    y = got.column("label").to_numpy()
    slope, bias, knots = 1.0, 0.0, np.zeros(1)
    if (y == 1).any() and (y == 0).any():
        x = got.column("x").to_numpy()
        knots = np.quantile(x[y == 0], [1 - 0.5**k for k in range(max(1, int(np.log2((y == 0).sum()))))])
        slope, bias = logistic(rarity(x, knots)[:, None], y.astype(np.float64))
        slope = max(slope, 0.0)  # a larger difference never lowers a score

    def score(batches):
        for batch in batches:
            z = rarity(batch.column("x").to_numpy(), knots) * slope + bias
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return with_differences(rows, model, "ratio", "doc_id long, held_out boolean", few).mapInArrow(score, result)
