"""Operators do the whole job: evidence outside samples, rare expressions, both forms of a join."""

import collections
import math
import os
import random
import zlib

import duckdb
import numpy as np

from tessera.llm import jaccard, licenses, quality, queries, toxicity

from ..conftest import SMALL


def _corpus(spark, marks, rows_a_mark, toxic_has, plain_has, n_plain=300):
    """Rows outside fold 0 with labels; then one unlabelled probe for each mark and for each plain expression."""
    rng = random.Random(3)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    held = iter(i for i in range(10**6) if zlib.crc32(str(i).encode()) % 5)
    data, known = [], []
    filler = lambda k: [rng.choice(common) for _ in range(k)]
    for m in marks:
        for _ in range(rows_a_mark):
            i = next(held)
            data.append((i, " ".join([*filler(8), toxic_has(m), *filler(8)])))
            known.append((i, 1))
    for _ in range(n_plain):
        i = next(held)
        data.append((i, " ".join([*filler(8), plain_has(rng, filler), *filler(8)])))
        known.append((i, 0))
    before, after = filler(6), filler(6)
    probes = {}
    for name, middle in [*((m, toxic_has(m)) for m in marks), ("plain", rng.choice(common))]:
        probes[name] = next(held)
        data.append((probes[name], " ".join([*before, middle, *after])))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int"), probes


def _scores(docs, labels, **more):
    return {r.doc_id: r.score for r in toxicity.score_documents(docs, labels, **more).collect()}


def test_toxicity_counts_rows_outside_the_sample(spark):
    marks = [f"zq{a}{b}x" for a in "bcdfghjk" for b in "mpvw"]
    docs, labels, probes = _corpus(spark, marks, 10, lambda m: m, lambda rng, filler: filler(1)[0])
    scores = _scores(docs, labels, per_class=60)
    assert all(scores[probes[m]] > scores[probes["plain"]] for m in marks)


def test_toxicity_rare_words_count(spark):
    marks = [f"zq{a}{b}x" for a in "bcdfghjk" for b in "mpvw"]
    docs, labels, probes = _corpus(spark, marks, 2, lambda m: m, lambda rng, filler: filler(1)[0])
    scores = _scores(docs, labels)
    assert all(scores[probes[m]] > scores[probes["plain"]] for m in marks)


def test_toxicity_phrases_of_ordinary_words_count(spark):
    pairs = [("mud", "cow"), ("wet", "hog"), ("dim", "pig")]
    alone = [w for p in pairs for w in p]
    docs, labels, probes = _corpus(spark, pairs, 40, " ".join, lambda rng, filler: " ".join([rng.choice(alone), *filler(2), rng.choice(alone)]))
    scores = _scores(docs, labels)
    assert all(scores[probes[p]] > scores[probes["plain"]] + 0.05 for p in pairs)


def test_toxicity_joined_model_agrees(spark):
    marks = [f"zq{a}x" for a in "bcdfghjk"]
    docs, labels, _ = _corpus(spark, marks, 10, lambda m: m, lambda rng, filler: filler(1)[0])
    docs = docs.unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, " \n"), (-3, "zqbx")], docs.schema))
    few, many = _scores(docs, labels), _scores(docs, labels, grams_to_broadcast=0)
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-9 for i in few)


def test_toxicity_shared_counts_follow_the_texts(spark):
    """Continuation counts hold every distinct gram of all texts, labelled or not."""
    docs, labels, _ = _corpus(spark, ["zqx"], 10, lambda m: m, lambda rng, filler: filler(1)[0])
    known = toxicity.classes(labels, "toxic", 5).selectExpr("*", "false AS curve")
    want = set()
    for r in docs.collect():
        flat = " " * 5 + r.text + " "
        want |= {flat[i - 5 : i + 1] for i in range(5, len(flat))}
    got = {int(r.gram).to_bytes(6, "big").decode() for r in toxicity.model_table(docs, known, toxicity.corpus_pairs(docs)).collect()}
    assert got == want


def brute_kneser_ney(texts, of_class):
    """log P(1) - log P(0) of each six-byte gram by dictionaries; texts: lower-case words with single spaces."""
    flats = [" " * 5 + t + " " if t else "" for t in texts]
    tops = [collections.Counter(f[i - 5 : i + 1] for i in range(5, len(f))) for f in flats]
    pairs = collections.Counter(t[i : i + 2] for t in texts for i in range(len(t) - 1))
    rows = collections.Counter()
    for pair, n in pairs.items():
        rows[pair[0]] += n
    counts = {name: sum((tops[i] for i in own), collections.Counter()) for name, own in of_class.items()}

    def order(top, k):
        raw = collections.Counter()
        longer = collections.defaultdict(set)
        for g, n in top.items():
            raw[g[-k:]] += n
            longer[g[-k:]].add(g[-k - 1 :])
        c = {g: n if k == 6 or g[:2] == "  " else len(longer[g]) for g, n in raw.items()}
        total, kept = collections.Counter(), collections.Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            kept[g[:-1]] += n - 0.9
        return lambda g, p: p if not total[g[:-1]] else max(c.get(g, 0) - 0.9, 0) / total[g[:-1]] + (1 - kept[g[:-1]] / total[g[:-1]]) * p

    shared, own = order(counts["all"], 3), {c: [order(counts[c], k) for k in range(3, 7)] for c in (0, 1)}
    out = {}
    for g in counts["all"]:
        base = shared(g[-3:], (pairs[g[-2:]] + 0.5) / (rows[g[-2]] + 128))
        p = {}
        for c in (0, 1):
            p[c] = base
            for k, smooth in zip(range(3, 7), own[c], strict=True):
                p[c] = smooth(g[-k:], p[c])
        out[g] = math.log(p[1] / p[0])
    return out


def test_toxicity_against_brute_force_kneser_ney(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2, False) for i in range(24)], "doc_id long, label int, curve boolean")
    want = brute_kneser_ney(texts, {"all": range(len(texts)), 0: range(0, 24, 2), 1: range(1, 24, 2)})
    got = {int(r.gram).to_bytes(6, "big").decode(): r.ratio for r in toxicity.model_table(docs, known, toxicity.corpus_pairs(docs)).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-5 for g in got)


def test_toxicity_weighs_words_exponentially():
    ratio, begin, first = np.array([0.0, 1, 3, 0, 2, 2, 2, 8, -1, 5]), np.array([0, 2, 3, 5, 6, 7, 9]), np.array([0, 6, 6, 7])
    want = math.log(sum(math.exp(0.75 * m) for m in (1, 3, 2, 2, 2, 7)) / 6) / 0.75
    assert np.allclose(toxicity.text_scores(ratio, begin, first), [want, 0, 5])


def brute_strengths(rows):
    """Prior and strengths from (host, path, evidence) rows, by the sums of squares of a nested analysis of variance."""
    rows = [(repr(h), repr(p), e) for h, p, e in rows]
    by = lambda key: [[e for h, p, e in rows if key(h, p) == k] for k in {key(h, p) for h, p, _ in rows}]
    mean = lambda g: sum(g) / len(g)
    hosts, paths, every = by(lambda h, p: h), by(lambda h, p: (h, p)), [e for _, _, e in rows]
    within = sum((e - mean(g)) ** 2 for g in paths for e in g) / (len(rows) - len(paths))
    host_mean = {h: mean([e for g, _, e in rows if g == h]) for h in {h for h, _, _ in rows}}
    ss_paths = sum((mean([x for g, q, x in rows if (g, q) == (h, p)]) - host_mean[h]) ** 2 for h, p, _ in rows)
    ss_hosts = sum((host_mean[h] - mean(every)) ** 2 for h, _, _ in rows)
    room_paths = len(rows) - sum(sum(len([1 for g, q, _ in rows if (g, q) == (h, p)]) ** 2 for p in {q for g, q, _ in rows if g == h}) / len([1 for g, _, _ in rows if g == h]) for h in host_mean)
    room_hosts = len(rows) - sum(len(g) ** 2 for g in hosts) / len(rows)
    strength = lambda ss, df, room: min(max(within / ((ss - df * within) / room), 1), 1000) if ss > df * within else 1000
    return mean(every), strength(ss_hosts, len(hosts) - 1, room_hosts), strength(ss_paths, len(paths) - len(hosts), room_paths)


def test_quality_posteriors_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, None if i % 29 == 0 else " ".join(rng.choice(["good", "fine", "junk", "spam", "buy"]) for _ in range(rng.randint(1, 9))), rng.choice(["a", "b", "c", None]), rng.choice(["en", "de", None])) for i in range(200)]
    docs.append((docs[3][0], *docs[3][1:]))
    labels = [(i, int("good" in (t or ""))) for i, t, _, _ in docs[:150]]
    got = quality.classify(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    site = {i: (h, p) for i, _, h, p in docs}
    rows = [(*site[r.doc_id], r.evidence) for r in got]
    prior, of_hosts, of_paths = brute_strengths(rows)
    assert len(got) == len(docs) and len({round(r.evidence, 6) for r in got}) > 20
    for r in got:
        h, p = site[r.doc_id]
        own, path = [e for g, _, e in rows if g == h], [e for g, q, e in rows if (g, q) == (h, p)]
        host = (sum(own) - r.evidence + of_hosts * prior) / (len(own) - 1 + of_hosts)
        want = (sum(path) - r.evidence + of_paths * host) / (len(path) - 1 + of_paths)
        z = math.log(r.evidence / (1 - r.evidence)) + 0.5 * (math.log(want / (1 - want)) - math.log(prior / (1 - prior)))
        assert abs(r.host_posterior - host) < 1e-9 and abs(r.path_posterior - want) < 1e-9 and abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_levels_that_do_not_differ_are_shrunk_most(spark):
    paths = spark.createDataFrame([("a", 10, 5.0, 4.0), ("b", 10, 5.0, 4.0)], "host string, n long, good double, square double")
    assert quality.strengths(paths) == (0.5, 1000.0, 1000.0)
    assert quality.strengths(paths.limit(0)) == (0.5, 1000.0, 1000.0)


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "bsd-3": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl-3": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
}


def test_licenses_meet_wrapped_templates(spark):
    data = [(i, f"{'lead ' * (7 * i)}\n{text}\n{'more words ' * 30}") for i, text in enumerate(WRAPPED.values())]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string"), across_lines=True).collect()}
    assert [(got[i].labels, got[i].score) for i in range(len(data))] == [(label, 1.0) for label in WRAPPED]


def test_long_templates_are_met_wherever_they_stand(spark):
    """A 300-word license, wrapped, at any place of a text, with a tenth of its words gone."""
    body = [f"clause{i}" for i in range(300)]
    kept = [w for i, w in enumerate(body) if i % 10]
    wrapped = lambda w: "\n".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11))
    data = [(k, "lead " * (97 * k) + wrapped(kept) + " tail" * 400) for k in range(12)] + [(99, wrapped(kept[:200]))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string"), templates={"own": [" ".join(body)]}, across_lines=True).collect()}
    assert all(got[k].labels == "own" and abs(got[k].score - 0.9) < 1e-12 for k in range(12)) and got[99].labels == ""
    mit = max(licenses.TEMPLATES["mit"], key=len).split()
    row = licenses.scan(spark.createDataFrame([(1, "x " * 50 + wrapped(mit[12:]))], "doc_id long, text string"), across_lines=True).first()
    assert row.labels == "mit" and row.score > 0.85


def test_license_text_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{os.path.join(SMALL, 'documents.parquet')}'")
    want = con.sql(queries.ORACLE_SQL["op4_license_text"])
    got = queries.QUERIES["op4_license_text"](spark, SMALL).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_jaccard_loses_no_link_within_a_family(spark):
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(1, 3)):
            words[at] = f"n{i}x{at}"
        texts[i] = " ".join(words)
    texts |= {100: texts[0], 101: "", 102: "one two three"}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t in texts.items()}
    sets = {frozenset(x) for x in shingles.values() if x}
    linked = lambda x, y: x != y and 100 * len(x & y) >= 75 * len(x | y)
    want = {i: sum(linked(x, y) for y in sets) for i, x in shingles.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.link_counts(docs, block=8).collect()}
    assert got == want and 0 < sum(want.values()) < 2 * 60 * 59
