"""Each operator against brute force on small tables, and on odd rows: nulls, empty and long texts, repeats, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import blocks, decontaminate, jaccard, langid, licenses, mixing, parsing, quality, queries, topk, toxicity

from ..conftest import SMALL

WORD = r"[^\x20\x09-\x0D]+"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "rid h marks fp token root size label bucket chunk payload a b n edits row start half"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty, letterless and long texts, repeated rows, a repeated doc_id, and columns whose names operators use."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    passage = " ".join(rng.choice(words) for _ in range(120))
    data = [
        (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, " \n\t ", None, None, 3), (4, "123 !! 456", "fr", "s2", None),
        (5, passage, "en", "s1", 9), (5, passage, "en", "s1", 9), (6, passage + " tail", "en", None, 9), (7, "head " + passage, None, "s2", 9),
        (8, long, "de", "s2", 9), (9, long[:-5], "de", "s2", 9), (None, passage, "en", "s1", 9), (None, None, None, None, None),
        (10, "one two", "fr", "s1", 7), (11, "ONE two", "fr", "s1", 7), (12, "x" * 3000, "en", "s1", 3000), (13, "released under the MIT License.", "en", "s1", 1),
        (5, "another text of the same id", "en", "s1", 1),
    ]
    df = spark.createDataFrame(data, FIELDS)
    return df.withColumns({c: F.lit(7) for c in CLASHING.split()})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def words_of(text):
    return re.findall(WORD, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words_of(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    index = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            index[g].append(k)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, s) in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                parent[find(k)] = find(j)
    groups = collections.defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    key = lambda i: float("inf") if i is None else i
    least = {k: min((sets[j][0] for j in group), key=key) for group in groups.values() for k in group}
    return collections.Counter((sets[k][0], len(sets[k][1]), least[k]) for k in range(len(sets)))


@pytest.mark.parametrize(("small", "block"), [(16, 512), (2, 3)])
def test_jaccard_components(docs, rows, small, block):
    got = jaccard.components(docs, small, block).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_jaccard_odd_rows(odd):
    got = jaccard.components(odd).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(r.doc_id, r.text) for r in odd.collect()])


def test_prefix_tree_against_sets():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 400), replace=False), rng.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(60)]
    tree = jaccard.PrefixTree(sets)
    for s in sets:
        want = {i for i, t in enumerate(sets) if len(np.intersect1d(s, t)) >= jaccard.needed(len(s), len(t))}
        assert set(tree.linked(s)) == want


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 600, rng.integers(1, 500), dtype=np.uint64)) for _ in range(2))
        maps = [jaccard.bitmaps(s, np.array([0, len(s)]), np.array([0]))[0] for s in (x, y)]
        assert jaccard.overlap_bound(maps[0], len(x), maps[1], len(y)) >= len(np.intersect1d(x, y))


def brute_blocks(rows, width=50):
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = words_of(t)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = collections.Counter()
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < key(i):
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_block_dedup(docs, rows, odd):
    for df, data in ((docs, rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        assert collections.Counter(map(tuple, blocks.remove_repeats(df).collect())) == brute_blocks(data)


def brute_parse(rows, width=400, passage=256):
    raws = [(i, (t or "").encode()) for i, t in rows]

    def gone(raw, width):
        out = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if count[raw[s : s + width]] > 1:
                out[s : s + width] = True
        return out

    count = collections.Counter(raw[s : s + w] for w in (width, passage) for _, raw in raws for s in range(len(raw) - w + 1))
    out = collections.Counter()
    for i, raw in raws:
        cut = gone(raw, width)
        kept = np.frombuffer(raw, np.uint8)[~cut].tobytes()
        spans = int((np.diff(cut.astype(int), prepend=0) == 1).sum())
        out[(i, len(raw), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), int(gone(raw, passage).sum()))] += 1
    return out


def brute_cut(rows, width, least_words):
    """Texts by id without runs of repeated strings that hold least_words words; characters stay whole; emptied texts go."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(raw[s : s + width] for _, raw in raws for s in range(len(raw) - width + 1))
    out = {}
    for i, raw in raws:
        ends = [-1] + [s for s in range(len(raw) - width + 1) if count[raw[s : s + width]] > 1]
        gone, cut = [], set()
        for s in ends[1:]:
            if gone and s <= gone[-1][1]:
                gone[-1][1] = s + width
            else:
                gone.append([s, s + width])
        for a, b in gone:
            if len(raw[a:b].split()) >= least_words:
                cut.update(range(a, b))
        place, kept = 0, []
        for c in raw.decode():
            size = len(c.encode())
            if not cut.issuperset(range(place, place + size)):
                kept.append(c)
            place += size
        if kept or not cut:
            out[i] = "".join(kept)
    return out


def test_parse_dedup(docs, rows, spark):
    got = parsing.remove_repeats(docs).collect()
    assert collections.Counter(map(tuple, got)) == brute_parse(rows)


def test_parse_dedup_runs_edges_and_repeats(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, other = text(900), text(450)
    data = [(1, shared + text(300)), (2, text(100) + shared[100:] + text(50)), (3, shared[:650] + text(400) + other), (4, other[20:] + text(10)), (5, "z" * 1500), (6, "y" * 401), (7, text(399)), (None, shared), (7, None), (8, other), (8, other), (9, "é" * 500)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("marks", F.lit(1))
    assert collections.Counter(map(tuple, parsing.remove_repeats(df).collect())) == brute_parse(data)
    kept = {r.doc_id: r.text for r in parsing.cut_repeats(df.withColumn("n_chars", F.lit(0).cast("long"))).collect()}
    assert 5 not in kept and kept[7] is not None and all("�" not in t for t in kept.values())


def test_cut_repeats_takes_passages_of_50_words(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = {n: prose(n) for n in (55, 80, 120)}
    boiler = prose(45)
    data = [(10 * n + k, f"{prose(90)} {p} {prose(70)}") for n, p in passages.items() for k in range(3)] + [(k, f"{prose(100)} {boiler}\n{prose(100)}") for k in range(4)] + [(5, None), (6, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("h", F.lit(1)).withColumn("_", F.lit(2))
    got = {r.doc_id: r for r in parsing.cut_repeats(docs, width=parsing.PASSAGE, least_words=50).collect()}
    assert set(got) == {i for i, _ in data} and got[6].text == "" and got[10 * 55].row == "x" and got[10 * 55]["_"] == 2
    for i, text in data:
        inside = [p for p in passages.values() if p in (text or "")]
        if inside:
            assert inside[0] not in got[i].text and len(got[i].text.split()) <= 164
        elif text:
            assert got[i].text == text


def test_string_widths_too_short_for_triggers(spark):
    with pytest.raises(ValueError, match="too short"):
        parsing.cut_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), width=40)


def test_mixing(docs, odd, empty, spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.sql(mixing.ORACLE)
    at = [want.columns.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
    got = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 and all(r.target <= 2 * r.source_size for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_comes_near_targets(docs):
    rows = mixing.mix_sources(docs).collect()
    largest, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        largest[r.source] = max(largest[r.source], r["size"])
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_licenses(docs, rows, odd):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def brute(text):
        w = re.findall(word, lower(text))
        places, found = [], set()
        for label, phrase in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            found |= {label} if at else set()
        more, score = set(found), 1.0 if found else 0.0
        for line in lower(text).split("\n"):
            lw = re.findall(word, line)
            for label, templates in licenses.TEMPLATES.items():
                for t in templates:
                    size = 64
                    while size < 2 * len(t.split()):
                        size *= 2
                    for start in range(0, max(1, len(lw)), size // 2):
                        share = len(set(lw[start : start + size]) & set(t.split())) / len(set(t.split()))
                        if share >= 0.8 - 1e-12:
                            more.add(label)
                            score = max(score, share)
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(more)), score

    for df in (docs, odd):
        want = collections.Counter((r.doc_id, *brute(r.text)) for r in df.collect())
        assert collections.Counter(map(tuple, licenses.scan(df).collect())) == want


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97


def test_language_odd_rows(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 4)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(empty).count() == 0
    assert {r.doc_id for r in langid.keep_identified(odd).collect()}.isdisjoint({1, 2, 3, 4})


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scores = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(r.toxic, scores[r.doc_id].predicted) for r in labels.collect() if scores[r.doc_id].held_out]
    right = {c: sum(p == c for y, p in held if y == c) / sum(y == c for y, _ in held) for c in (0, 1)}
    assert right[0] > 0.9 and right[1] > 0.85


def test_classifiers_on_odd_rows(odd, empty, labels, spark):
    some = labels.limit(0).unionByName(spark.createDataFrame([(5, 1, 1), (8, 0, 0), (9, 1, None), (None, 1, 1), (5, 0, 1)], labels.schema))
    for table in (labels, some, labels.limit(0)):
        for rows in (toxicity.score_documents(odd, table).collect(), quality.classify(odd, table).collect()):
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(empty, labels).count() == 0 == quality.classify(empty, labels).count()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scores = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(r.quality, scores[r.doc_id].predicted) for r in labels.collect() if scores[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def edits(a: bytes, b: bytes) -> int:
    """Fewest edits of all of a against any part of b."""
    row = np.zeros(len(b) + 1, dtype=int)
    for i, c in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (np.frombuffer(b, np.uint8) != c), row[1:] + 1)
        row = np.minimum.accumulate(new - np.arange(len(row))) + np.arange(len(row))
    return int(row.min())


def brute_matches(docs, items, norm):
    """(document, item): fewest edits, where they are a tenth of the item's length or fewer."""
    want = {}
    for d, t in docs:
        for i, item in items:
            n = norm(item or "")
            if n and t and (e := edits(n, norm(t))) <= int(0.1 * len(n)):
                want[(d, i)] = e
    return want


def test_decontamination_of_short_items(spark):
    """Items of 1 to 40 bytes at the full tenth of edits."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 6)))
    items = []
    for n in range(1, 41):
        for _ in range(2):
            t = word()
            while len(t) < n:
                t += " " + word()
            items.append((len(items), t[: n - 1] + "q"))  # no space at the end
    docs = []
    for i, t in items:
        budget = int(0.1 * len(t))
        for changes in {0, budget, budget + 1}:
            s = list(t)
            for at in rng.sample(range(len(s)), min(changes, len(s))):
                s[at] = rng.choice(["", "x", s[at] + "z"])
            docs.append((len(docs), " ".join(word() for _ in range(8)) + " " + "".join(s) + " " + " ".join(word() for _ in range(8))))
    norm = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip().encode()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(df, bench).collect()}
    want = brute_matches(docs, items, norm)
    assert got == want
    assert {len(items[i][1]) for _, i in want} == set(range(1, 41)) and {e for e in want.values()} >= {0, 1, 2, 3}


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(i, text(rng.randint(12, 40))) for i in range(12)] + [(90, "short"), (91, None), (92, "")]
    docs, n = [(None, None), (-1, ""), (-2, text(300))], 0
    for i, t in items[:12]:
        for changes in (0, 2, int(0.07 * len(t)), int(0.3 * len(t))):
            s = list(t)
            for _ in range(changes):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice([[], ["x"], [s[at], "q"]])
            docs.append((n, text(30) + " " + "".join(s).upper() + ", " + text(30)))
            n += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("edits", F.lit(1)).withColumn("row", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(df, bench).collect()}
    norm = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip().encode()
    want = brute_matches(docs, items, norm)
    assert got == want and len(want) >= 36
    clean = {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_blocks_agree(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert len(decontaminate.blocks_of(bench, 2000)) > 1
    whole, parts = (sorted(map(tuple, decontaminate.contaminated(docs, bench, block_bytes=n).collect())) for n in (decontaminate.BLOCK_BYTES, 2000))
    assert whole and whole == parts


def test_decontamination_of_long_and_repeated_rows(spark):
    rng = random.Random(17)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = text(30)
    long = text(60_000) + " " + item + " " + text(60_000)
    data = [(1, long), (1, long), (2, long.replace(item, text(30))), (3, item), (3, item)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("of", F.lit(1)).withColumn("OF_row", F.lit(2))
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.places) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7): (0, 1), (3, 7): (0, 1)}
    left = decontaminate.clean_documents(docs, bench)
    assert [(r.doc_id, r["of"], r["OF_row"]) for r in left.collect()] == [(2, 1, 2)]


def test_near_duplicates_with_clashing_names(spark):
    words = [f"w{i}" for i in range(40)]
    data = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[1:] + ["x"])), (4, None), (None, "a b")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("kept", F.lit(5)).withColumn("_kept", F.lit(6)).withColumn("fp", F.lit(7))
    rows = jaccard.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, r.kept, r["_kept"], r.fp) for r in rows) == [(0, 5, 6, 7), (1, 5, 6, 7), (4, 5, 6, 7)]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (300, 16)).round(2))]
    vectors += [(400, None), (420, [float("nan")] * 16), (440, [None] * 16), (460, [0.0] * 16), (480, []), (None, [0.1] * 16), (20, vectors[20][1]), (500, [float("inf")] * 16), (600, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    usable = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q in {i for i, _ in usable if i % 20 == 0}:
        x = min((v.tolist() for i, v in usable if i == q))
        scored = sorted((-int(np.dot(x, v)), i) for i, v in usable if i != q and len(v) == len(x))[:20]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, block_rows=64).collect()}
    assert got == want


def test_score_bitmaps_are_the_scores():
    """Added bitmaps write every row's inner product: values of up to 41 bits, negative weights, blocks of any size, no dimension."""
    rng = np.random.default_rng(3)
    for rows, dims, most in ((1, 1, 1), (63, 3, 5), (64, 8, 1), (65, 7, 40), (200, 16, 1 << 20), (10, 2, 1 << 40), (5, 0, 1)):
        vals = rng.integers(-most, most + 1, (rows, dims))
        index = topk.BitSlices(np.arange(rows), vals)
        for query in (rng.integers(-most, most + 1, dims), np.zeros(dims, dtype=np.int64), np.full(dims, -1)):
            if most > 1 << 30:
                query = query % 1000
            sums, base = index.added(query)
            written = [base + sum(int(row[i]) << b for b, row in enumerate(np.unpackbits(sums.view(np.uint8), axis=1))) for i in range(rows)]
            assert written == (vals @ query).tolist()
            for k in (1, 20, rows + 5):
                ids, scores = index.top(0, query, k)
                want = sorted((-s, i) for i, s in enumerate(written) if i)[:k]
                assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


def test_top_k_of_ties(spark):
    """Repeated vectors tie at the boundary of every block; the smaller ids stay."""
    df = spark.createDataFrame([(i, [0.5, 0.25 if i % 7 else 0.5]) for i in range(1, 301)], "vec_id long, embedding array<double>")
    for r in topk.top_k(df, block_rows=50).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("v")).collect():
        assert [x.vec_id for x in r.v] == [i for i in range(7, 301, 7) if i != r.query_id][:20]


def test_registered_queries_match_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.sql(sql)
        got = queries.QUERIES[name](spark, SMALL)
        assert sorted(got.columns) == sorted(want.columns)
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_all_are_registered():
    assert list(dict.fromkeys(q.split("_")[0] for q in queries.QUERIES)) == [f"op{n}" for n in range(1, 14)]


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (jaccard.components(empty), blocks.remove_repeats(empty), parsing.remove_repeats(empty), licenses.scan(empty), decontaminate.contaminated(empty, bench), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert df.count() == 0


def test_few_links_take_few_tasks(spark, monkeypatch):
    """A table of labels has a file for each core, or for so many links, whatever the number of shuffle partitions."""
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 10], "a long, b long")
    try:
        for name, value in zip(before, ("64", "false"), strict=True):
            spark.conf.set(name, value)
        few = jaccard.connected(links)
        assert len(few.inputFiles()) <= spark.sparkContext.defaultParallelism
        monkeypatch.setattr(jaccard, "EDGES", 50)
        more = jaccard.connected(links)
        assert len(more.inputFiles()) > spark.sparkContext.defaultParallelism
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {(r.node, r.root) for r in few.collect()} == {(r.node, r.root) for r in more.collect()} == {(k, (k - 1) // 10 * 10 + 1) for k in range(1, 301)}


def test_connected_components_of_chains_and_stars(spark):
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(25)] + [(-5, 300), (300, 301)]
    links = [(a, b) for a, b in links if a != b]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in jaccard.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert jaccard.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_of_a_group_part_its_pairs():
    """Every pair of classes in different components comes out in one band, and a band gives its share of them."""
    rng = np.random.default_rng(8)
    sets = [np.unique(np.concatenate([np.arange(150, dtype=np.uint64), rng.integers(1000, 1 << 40, 5).astype(np.uint64)])) for _ in range(300)]
    fp = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    members = [{"fp": int(f), "n": len(s), "m": 0, "root": int(f), "before": 0, "bits": jaccard.bitmaps(s, np.array([0, len(s)]), np.array([0]))[0]} for f, s in zip(fp, sets, strict=True)]
    members = pa.array(members, pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("root", pa.int64()), ("before", pa.int64()), ("bits", pa.binary())]))
    x, y = jaccard.Block(members.slice(0, 100)), jaccard.Block(members.slice(100))
    for a, b, all_pairs in ((x, y, 20_000), (y, y, 19_900)):
        met = [set(zip(*(k.tolist() for k in jaccard.pairs_apart(a, b, *band)[:2]), strict=True)) for band in ((0, 1 / 64), (1 / 64, 1 / 4), (1 / 4, 1), (0, 1))]
        assert sum(map(len, met[:3])) == len(met[3]) == all_pairs and set.union(*met[:3]) == met[3]
        assert len(met[0]) < all_pairs / 32
    back = jaccard.pairs_apart(y, x, 0, 1 / 64)
    assert set(zip(back[1].tolist(), back[0].tolist(), strict=True)) == set(zip(*(k.tolist() for k in jaccard.pairs_apart(x, y, 0, 1 / 64)[:2]), strict=True))
