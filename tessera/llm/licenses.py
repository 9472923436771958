"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates.

A block is a number of consecutive words of one line, or with `across_lines` of
the whole text; blocks overlap by half.  A template's blocks have 64 words, or
the power of two that holds it twice, so a copy of a template of any length lies
within one of its blocks.  A block meets a template if it holds at least `threshold` of
the template's distinct words.  Template words are ordered by their frequency
in the whole corpus, rarest first: a block that meets the threshold holds one
of the first |T| - needed + 1 words (prefix filter), has enough distinct words
(length filter), and from its first shared word on, template and block each
have enough words left in that order (positional filter).  What passes is counted exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_text
from .textscan import LOWER, alnum_words, byte_rolling, chunks, words

# Phrases of the base labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Sentences, headers and bodies by which licenses are declared.
TEMPLATES = {
    "apache-2": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd-3": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license"],
}
BLOCK = 64


def block_size(template: str) -> int:
    """Words of a template's blocks."""
    return max(BLOCK, 1 << (2 * len(template.split()) - 1).bit_length())


def _vocabulary(templates: dict[str, list[str]], phrases: dict[str, str]) -> list[str]:
    return sorted({w for ts in templates.values() for t in ts for w in t.split()} | {w for p in phrases.values() for w in p.split()})


class Matcher:
    """Recognises the words of templates and phrases in a chunk of texts."""

    def __init__(self, vocabulary: list[str]):
        self.place = {w: i for i, w in enumerate(vocabulary)}
        raw = "".join(vocabulary).encode()
        ends = np.cumsum([len(w.encode()) for w in vocabulary])
        hashes = byte_rolling(np.frombuffer(raw, dtype=np.uint8)).of(np.concatenate([[0], ends[:-1]]), ends)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.is_word = alnum_words()

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        """Lower-cased bytes, first word of each text, word starts, and each word's place in the vocabulary or -1."""
        low = LOWER[data]
        starts, ends, first = words(low, offsets, self.is_word)
        if not len(starts):
            return low, first, starts, np.zeros(0, np.int64)
        h = byte_rolling(low).of(starts, ends)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return low, first, starts, np.where(self.sorted[at] == h, self.order[at], -1)


def word_counts(docs: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """How often each word of the (fixed) vocabulary stands in all texts."""
    matcher = Matcher(vocabulary)

    def count(batches):
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for _, data, offsets in chunks(batches):
            found = matcher.tokens(data, offsets)[3]
            total += np.bincount(found[found >= 0], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary)), pa.int64()), pa.array(total)], names=["word", "n"])

    rows = doc_text(docs).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a template word
    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in rows:
        out[r.word] = r.n
    return out


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, across_lines: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    Base: every place where a phrase's words stand consecutively (also across
    lines).  labels adds those of templates that some block meets.  score is
    the largest share of a template in a block that meets it, 1 with a base
    label, else 0.  Null or empty text: no words, nothing found, empty label
    strings.  Repeated rows are scanned alike; a null doc_id is kept.
    across_lines: blocks are cut over the words of the whole text, so that
    wrapped templates are met; else no block leaves its line.
    """
    vocabulary = _vocabulary(templates, phrases)
    counts = word_counts(docs, vocabulary)
    matcher = Matcher(vocabulary)
    rank = np.lexsort((np.arange(len(vocabulary)), counts)).argsort()  # rarest first
    spelled = {label: np.array([matcher.place[w] for w in p.split()]) for label, p in phrases.items()}
    sets = []
    for label, texts in templates.items():
        for text in texts:
            t = sorted({matcher.place[w] for w in text.split()}, key=lambda w: rank[w])
            need = math.ceil(threshold * len(t) - 1e-9)
            sets.append((label, t, need, len(t) - need + 1, block_size(text)))
    by_size: dict[int, dict[int, list[tuple[int, int]]]] = {}  # of each block size: templates by the words of their prefixes
    for i, (_, t, _, prefix, size) in enumerate(sets):
        for at, w in enumerate(t[:prefix]):
            by_size.setdefault(size, {}).setdefault(w, []).append((i, at))

    def rare_words(by_prefix: dict[int, list[tuple[int, int]]]) -> np.ndarray:
        rare = np.zeros(len(vocabulary) + 1, dtype=bool)
        rare[list(by_prefix)] = True
        return rare

    rare_of = {size: rare_words(by_prefix) for size, by_prefix in by_size.items()}

    def joined(found: np.ndarray, lines: np.ndarray, first: np.ndarray, size: int, out: dict[int, dict[str, float]]) -> None:
        """Puts labels and shares by text into out; found: vocabulary places by word, lines: number of each word's line."""
        hits = np.flatnonzero(rare_of[size][found])
        by_prefix, half, done = by_size[size], size // 2, set()
        for h in hits:
            text = int(np.searchsorted(first, h, side="right")) - 1
            start = max(int(first[text]), int(np.searchsorted(lines, lines[h])))
            end = min(int(first[text + 1]), int(np.searchsorted(lines, lines[h], side="right")))
            base = start + (h - start) // half * half
            for lo in (base - half, base):
                if lo < start or (lo, text) in done:
                    continue
                done.add((lo, text))
                words_here = found[lo : min(lo + size, end)]
                block = sorted(set(words_here[words_here >= 0].tolist()), key=rank.__getitem__)
                held, tried = set(block), set()
                for j, w in enumerate(block):  # in the global order, so w is the first word that it shares with an untried template
                    for i, at in by_prefix.get(w, ()):
                        label, t, need, *_ = sets[i]
                        if i in tried:
                            continue
                        tried.add(i)
                        if len(words_here) < need or min(len(t) - at, len(block) - j) < need:
                            continue
                        shared = len(held.intersection(t))
                        if shared >= need:
                            best = out.setdefault(text, {})
                            best[label] = max(best.get(label, 0.0), shared / len(t))

    def run(batches):
        for rows, data, offsets in chunks(batches):
            low, first, starts, found = matcher.tokens(data, offsets)
            n = rows.num_rows
            places, labels = [[] for _ in range(n)], [set() for _ in range(n)]
            for label, p in spelled.items():
                at = np.flatnonzero(found == p[0])
                for k in range(1, len(p)):
                    at = at[at + k < len(found)]
                    at = at[found[at + k] == p[k]]
                text = np.searchsorted(first, at, side="right") - 1
                for a, i in zip(at[at + len(p) <= first[text + 1]] if len(at) else at, text[at + len(p) <= first[text + 1]] if len(at) else text, strict=True):
                    places[i].append(int(a - first[i]))
                    labels[i].add(label)
            breaks = np.flatnonzero(low == 10) if not across_lines else np.zeros(0, np.int64)
            lines, more = np.searchsorted(breaks, starts), {}
            for size in by_size:
                joined(found, lines, first, size, more)
            base = [",".join(sorted(x)) for x in labels]
            both = [",".join(sorted(labels[i] | set(more.get(i, ())))) for i in range(n)]
            score = [1.0 if labels[i] else max(more.get(i, {"": 0.0}).values()) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()), pa.array(base, pa.string()), pa.array(both, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _oracle(across_lines: bool = False) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"('{label}', {p.split()!r})" for label, p in PHRASES.items())
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {block_size(t)})" for label, ts in TEMPLATES.items() for t in ts)
    sizes = ", ".join(f"({n})" for n in sorted({block_size(t) for ts in TEMPLATES.values() for t in ts}))
    lines = "SELECT doc_id, words FROM w" if across_lines else f"SELECT doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '{word}') AS words FROM w"
    return f"""
WITH w AS (SELECT doc_id, {low} AS t, regexp_extract_all({low}, '{word}') AS words FROM documents),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(words) - len(p) + 2), lambda i: words[i:i + len(p) - 1] = p)) AS i
  FROM w CROSS JOIN (VALUES {phrases}) AS v(label, p)),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
lines AS ({lines}),
blocks AS (SELECT doc_id, size, list_distinct(words[i + 1:i + size]) AS b FROM (SELECT doc_id, words, size, unnest(range(0, len(words), size // 2)) AS i FROM lines CROSS JOIN (VALUES {sizes}) AS s(size)) cut),
shares AS (SELECT doc_id, label, len(list_intersect(b, t)) / CAST(len(t) AS DOUBLE) AS share FROM blocks JOIN (VALUES {templates}) AS v(label, t, own) ON blocks.size = v.own),
met AS (SELECT doc_id, label, share FROM shares WHERE share >= CAST(0.8 AS DOUBLE) - CAST(1e-12 AS DOUBLE)),
united AS (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM places),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM united GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.lo AS BIGINT) AS first_word, CAST(base.hi AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, CASE WHEN base.n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best.share, CAST(0 AS DOUBLE)) END AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN named ON named.doc_id = w.doc_id LEFT JOIN best ON best.doc_id = w.doc_id
"""


ORACLE, ORACLE_TEXT = _oracle(), _oracle(across_lines=True)
