"""Language identification: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the whole lower-cased text, square-rooted
and scaled to unit length.  Training uses a bounded number of labelled texts of
each language (`per_language`); prediction reads every text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_text
from .textscan import LOWER, chunks, ids

DIM = 4096
# Language codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = regex.compile(r"\p{L}")


def trigram_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit-length row for each text; a text of under three bytes has zeros."""
    low = LOWER[data].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, DIM), dtype=np.float32)
    if len(low) < 3:
        return out
    grams = ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(20)
    for i, (start, end) in enumerate(zip(offsets[:-1], offsets[1:] - 2, strict=True)):
        if end > start:
            out[i] = np.sqrt(np.bincount(grams[start:end], minlength=DIM))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 20) -> np.ndarray:
    """Weights (last: bias) of an L2-regularised squared-hinge SVM by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norms = (x * x).sum(axis=1) + 0.5 / cost
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / norms[i], 0.0)
            if (step := new - alpha[i]) != 0:
                w += step * y[i] * x[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


class Hierarchy:
    """One-versus-one SVMs between families and, within each family, between languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.family = {lang: FAMILY_OF.get(lang.split("-")[0].lower(), lang) for lang in self.langs}
        self.families = sorted(set(self.family.values()))
        held = np.array(langs, dtype=object)
        of = np.array([self.family[lang] for lang in langs], dtype=object)
        self.between = self._pairs(x, of, self.families)
        self.within = {f: self._pairs(x[of == f], held[of == f], [g for g in self.langs if self.family[g] == f]) for f in self.families}

    @staticmethod
    def _pairs(x, of, names):
        out = []
        for a, b in combinations(names, 2):
            rows = (of == a) | (of == b)
            out.append((a, b, linear_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))))
        return names, out

    @staticmethod
    def _vote(x, model):
        """Winner's number and confidence by votes, then by summed margins."""
        names, pairs = model
        place = {name: i for i, name in enumerate(names)}
        votes, least = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for a, b, w in pairs:
            margin = x @ w[:-1].astype(np.float32) + w[-1]
            for name, m in ((a, margin), (b, -margin)):
                votes[:, place[name]] += (m > 0) + 0.5 * np.tanh(m) / (len(names) + 1)
                least[:, place[name]] = np.minimum(least[:, place[name]], m)
        best = votes.argmax(axis=1)
        margin = least[np.arange(len(x)), best]
        return best, np.where(np.isinf(margin), 1.0, 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50))))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(x), "und", dtype=object), np.zeros(len(x))
        if not self.langs:
            return lang, score
        family, sure = self._vote(x, self.between)
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            if len(rows):
                best, inner = self._vote(x[rows], self.within[name])
                lang[rows] = np.array(self.within[name][0], dtype=object)[best]
                score[rows] = sure[rows] * inner
        return lang, score


def fold(modulus: int):
    """crc32 of the id as text, modulo `modulus`; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def bounded_sample(rows: DataFrame, key: str, per_key: int) -> DataFrame:
    """About `per_key` rows of each value of `key` at most, chosen by a hash of doc_id."""
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}  # one row a class
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(key) == F.lit(value), F.lit(min(1.0, per_key / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))


def train(docs: DataFrame, per_language: int = 500, held_out: tuple[int, int] = (4, 2)) -> Hierarchy:
    """The model of rows whose fold is not the held-out one and whose lang is not null."""

    def features(batches):
        for rows, data, offsets in chunks(batches, rows=256):
            x = trigram_features(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("lang").cast(pa.string()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    usable = doc_text(docs, F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (fold(held_out[0]) != held_out[1]))
    got = bounded_sample(usable, "lang", per_language).mapInArrow(features, "lang string, x binary").collect()
    got.sort(key=lambda r: (r.lang, r.x))
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in got], dtype=np.float32).reshape(len(got), DIM)
    return Hierarchy(x, [r.lang for r in got])


def predictions(model: Hierarchy, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text; `und` without a letter."""
    lang, score = model.predict(trigram_features(data, offsets))
    raw = data.tobytes()
    for i in range(len(lang)):
        if not _LETTER.search(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")):
            lang[i], score[i] = "und", 0.0
    return lang, score


def identify(docs: DataFrame, per_language: int = 500, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang).

    lang_pred is a lang value that was learned, or `und` (score 0) where the
    text is null, empty or has no letter, or nothing could be learned.  score
    is the product of the logistic margins of both levels.  A null doc_id is
    in fold 0.  Repeated rows are predicted alike; ties in votes go to the
    first code.  An empty table gives no rows.  The driver holds at most
    `per_language` feature rows a language.
    """
    model = train(docs, per_language, held_out)

    def predict(batches):
        for rows, data, offsets in chunks(batches, rows=512):
            lang, score = predictions(model, data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(list(lang), pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return doc_text(docs).withColumn("held_out", fold(held_out[0]) == held_out[1]).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """The rows of docs whose text has a language; lang becomes the predicted one, other columns stay.

    A document is rejected if it is `und`, that is null, empty or without a letter.
    """
    model = train(docs, per_language)
    place = docs.columns.index("lang")
    names = docs.columns

    def run(batches):
        for rows, data, offsets in chunks(batches, rows=512):
            lang, _ = predictions(model, data, offsets)
            out = rows.set_column(place, "lang", pa.array(list(lang), pa.string()))
            yield pa.RecordBatch.from_arrays(out.filter(pa.array(lang != "und")).columns, names=names)

    schema = docs.withColumn("lang", F.col("lang").cast("string")).schema
    return docs.withColumn("lang", F.col("lang").cast("string")).mapInArrow(run, schema)
