import random

import corpus_pipeline
from vellum.llm import shingles

SF = "/root/testdata/sf0.01"


def plain_set(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_likeness(a, b):
    return len(a & b) / len(a | b)


def plain_pairs(texts):
    """Pairs of keys whose sets have a similarity of 0.8 at least, comparing all that share a shingle."""
    sets, having = {k: plain_set(t) for k, t in texts.items()}, {}
    for k, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(k)
    near = {(min(a, b), max(a, b)) for ks in having.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    return {(a, b) for a, b in near if plain_likeness(sets[a], sets[b]) >= 0.8}


def plain_kept(texts):
    """The smallest key of each group that the pairs connect."""
    top = {k: k for k in texts}
    for _ in texts:
        before = dict(top)
        for a, b in plain_pairs_of(texts):
            top[a] = top[b] = min(top[a], top[b])
        if top == before:
            return {k for k in texts if top[k] == k}


_found: dict = {}


def plain_pairs_of(texts):
    return _found.setdefault(id(texts), plain_pairs(texts))


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = shingles.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(plain_kept(texts))


def test_stage_drops_near_copies_beyond_two_bits(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(20):
        words = [word() for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        words[20 * (i % 9) + 5] = words[150] = word()
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, SF).collect()) == list(range(0, 40, 2))


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "x"), (3, text.upper() + " more", "y"), (3, "of its own, far from the others", "y"), (None, text, "z"), (7, None, "z"), (8, "", "z"), (9, "two words", None), (2, "two words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, band string")
    kept = shingles.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == sorted([(3, len(text) + 5), (3, 31), (7, 0), (2, 9)])
    assert shingles.keep_one(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, text), (None, text + " more")], "doc_id long, text string")
    assert shingles.keep_one(nameless).count() == 2
