"""Language identification against plain versions: features, optimal separators, votes by family."""

import random
from itertools import combinations

import numpy as np

from tessera.llm import langid


def plain_features(text: str) -> np.ndarray:
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = np.zeros(langid.DIM)
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        out[(h * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
    out = np.sqrt(out)
    return out / max(np.linalg.norm(out), 1e-12)


def test_features_against_counting():
    texts = ["", "a", "ab", "Abc abC", "ÄÖ über", "x" * 500]
    raws = [t.encode() for t in texts]
    got = langid.trigram_features(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-6)


def test_separator_is_optimal():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 12)).astype(np.float32), np.where(rng.random(60) < 0.4, 1.0, -1.0)
    full = np.hstack([x, np.ones((60, 1))]).astype(float)
    loss = lambda w: 0.5 * w @ w + 0.1 * (np.maximum(0, 1 - y * (full @ w)) ** 2).sum()
    best = np.zeros(13)
    for _ in range(100):  # exact steps while the same rows are within the margin
        own = full[y * (full @ best) < 1]
        best = np.linalg.solve(np.eye(13) + 0.2 * own.T @ own, 0.2 * own.T @ y[y * (full @ best) < 1])
    assert loss(langid.linear_svm(x, y, cost=0.1, epochs=500)) < 1.01 * loss(best)


def test_family_first_then_languages_of_it():
    rng = random.Random(6)
    stems = {"de": "schung heit", "nl": "lijk heden", "fr": "eaux ment", "es": "cion dad", "xx": "qqzz vvkk"}
    texts = [(lang, " ".join(rng.choice(s.split()) + rng.choice("aeiou") for _ in range(12))) for lang, s in stems.items() for _ in range(15)]
    x = np.array([plain_features(t) for _, t in texts], dtype=np.float32)
    model = langid.Hierarchy(x, [lang for lang, _ in texts])
    assert model.family == {"de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "xx": "xx"}

    def winner(row, names, pairs):
        votes, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for (a, b), (p, q, w) in zip(combinations(names, 2), pairs, strict=True):
            assert (a, b) == (p, q)
            m = float(row @ w[:-1] + w[-1])
            for name, s in ((a, m), (b, -m)):
                votes[name] += (s > 0) + 0.5 * np.tanh(s) / (len(names) + 1)
                least[name] = min(least[name], s)
        best = max(names, key=lambda n: votes[n])
        return best, 1.0 if np.isinf(least[best]) else 1 / (1 + np.exp(-4 * least[best]))

    got, score = model.predict(x)
    for i, row in enumerate(x.astype(float)):
        family, sure = winner(row, *model.between)
        lang, inner = winner(row, *model.within[family])
        assert got[i] == lang and abs(score[i] - sure * inner) < 1e-3
    assert np.mean(got == [lang for lang, _ in texts]) > 0.98


def test_equal_texts_and_ties_go_to_the_first_code(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["fr", "es"] * 6)], "doc_id long, text string, lang string")
    rows = langid.identify(docs).collect()
    assert len(rows) == 12 and len({(r.lang_pred, round(r.score, 5)) for r in rows}) == 1
    model = langid.Hierarchy(np.zeros((2, langid.DIM), np.float32), ["fr", "es"])
    assert model.predict(np.zeros((1, langid.DIM), np.float32))[0][0] in ("es", "fr")
