import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import quality, queries, subwords, toxicity

SF = "/root/testdata/sf0.1"


def plain_features(text, shape):
    """Features of a text as (kind, string) pairs, one by one."""
    words = (text.lower() if shape.fold_case else text).split()
    out, before = [], None
    for w in words:
        if not shape.repeats and w == before:
            continue
        out.append(("word", w))
        for n in range(shape.shortest, shape.longest + 1):
            out += [("gram", f" {w} "[i : i + n]) for i in range(len(w) + 3 - n)]
        if shape.pairs and before is not None:
            out.append(("pair", frozenset((before, w))))
        before = w
    return out


@pytest.mark.parametrize("shape", [subwords.Shape(), subwords.Shape(fold_case=False, pairs=True), subwords.Shape(repeats=False, longest=6)])
def test_features_match_plain_ones(shape):
    texts = ["Ab abc\tabc  über über x", "", "  ", "one", "the the the cat", "é" * 50, "a\nb a"]
    found = {i: [] for i in range(len(texts))}
    for docs, features, begins in subwords.bags(texts, shape):
        for d, f in zip(docs, np.split(features, begins[1:])):
            found[int(d)] += f.tolist()
    for i, t in enumerate(texts):
        assert len(found[i]) == len(plain_features(t, shape)), t
        assert Counter(found[i]) == Counter(plain_bucket(f, shape) for f in plain_features(t, shape)), t


M = (1 << 64) - 1
MIX, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def plain_bucket(feature, shape):
    """The bucket of a (kind, string) pair: a polynomial hash of the code points, mixed, one offset a kind."""
    kind, text = feature
    code = lambda s: [(ord(c) + 1) * MIX & M for c in s]
    whole = lambda w: sum(v * pow(STEP, i, 1 << 64) for i, v in enumerate(code(w))) & M
    if kind == "word":
        h = whole(text) + 7
    elif kind == "pair":
        h = whole(min(text)) ^ whole(max(text)) if len(text) == 2 else 0
    else:
        h = 0
        for v in code(text):
            h = (h * STEP + v) & M
        h += len(text)
    h &= M
    return ((h ^ (h >> 31)) * MIX & M) >> (64 - shape.bits)


def test_one_training_step_and_the_score_match_plain_ones():
    shape, dim, rate = subwords.Shape(bits=6, pairs=True), 3, 2.0
    texts, labels = ["good good words", "bad wörds here", "", "more"], [1, 0, 1, 0]
    got = subwords.train(texts, labels, shape, dim=dim, epochs=1, rate=rate, batches=1, seed=5)
    rng = np.random.default_rng(5)
    vectors = ((rng.random((64, dim)) - 0.5) / dim).tolist()
    out = (rng.standard_normal(dim) * 0.3).tolist()
    docs = [([plain_bucket(f, shape) for f in plain_features(t, shape)], y) for t, y in zip(texts, labels) if t]
    odds = [sum(sum(v * o for v, o in zip(vectors[b], out)) for b in bag) / len(bag) for bag, _ in docs]
    slope = [(1 / (1 + math.exp(-z)) - y) / len(docs) for z, (_, y) in zip(odds, docs)]
    pull = [sum(g * bag.count(b) / len(bag) for g, (bag, _) in zip(slope, docs)) for b in range(64)]
    toward = [sum(vectors[b][k] * pull[b] for b in range(64)) for k in range(dim)]
    vectors = [[v - rate * pull[b] / math.sqrt(pull[b] ** 2 + 1e-10) * o for v, o in zip(vectors[b], out)] for b in range(64)]
    out = [o - 0.1 * t / math.sqrt(t * t + 1e-10) for o, t in zip(out, toward)]
    bias = -0.1 * sum(slope) / math.sqrt(sum(slope) ** 2 + 1e-10)
    weights = [sum(v * o for v, o in zip(vectors[b], out)) for b in range(64)]
    assert got.weights == pytest.approx(weights, abs=1e-5) and got.bias == pytest.approx(bias, abs=1e-5)
    for t, score in zip(texts, got.score(texts)):
        bag = [plain_bucket(f, shape) for f in plain_features(t, shape)]
        want = 1 / (1 + math.exp(-(sum(weights[b] for b in bag) / len(bag) + bias))) if bag else got.prior
        assert score == pytest.approx(want, abs=1e-5)


def test_a_word_without_end_is_worked_through_in_pieces():
    text = "ab" * 1_500_000
    assert max(len(t) for g in subwords._runs([text]) for _, t in g) <= 2 * subwords.CHUNK
    assert "".join(t for g in subwords._runs([text]) for _, t in g) == text
    model = subwords.Model(np.ones(1 << 18), 0.0, quality.SHAPE)
    assert model.score([text, "ab"])[0] == pytest.approx(1 / (1 + math.exp(-1)))


def test_sample_is_bounded_and_steady(spark, monkeypatch):
    rows = [(i % 40, f"text {i} " * 20) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    drawn = []
    monkeypatch.setattr(subwords, "train", lambda texts, marks, shape, **options: drawn.append((texts, marks)) or subwords.Model(np.zeros(2), 0.0, shape))
    for d in (docs, docs.repartition(7), docs.orderBy("text")):
        subwords.fit(d, labels, "text", "doc_id", "toxic", toxicity.SHAPE, max_total=2000)
    assert drawn[0] == drawn[1] == drawn[2]
    texts, marks = drawn[0]
    assert 1500 < sum(map(len, texts)) <= 2000 and len(set(texts)) == len(texts) and 0 < sum(marks) < len(marks)


def test_long_text_in_pieces_scores_as_the_whole():
    model = subwords.Model(np.random.default_rng(1).standard_normal(1 << 18), 0.1, quality.SHAPE)
    text = "Some words and more, été. " * 40_000
    assert len(text) > 3 * subwords.CHUNK
    both = model.score([text, "x", text])
    assert both[0] == both[2]
    short = model.score(["Some words and more, été. " * 400])[0]
    assert abs(both[0] - short) < 0.01


@pytest.mark.parametrize("name,parts,held,column,floor", [("op6_toxicity", 4, 2, "toxic", 0.97), ("op10_quality", 5, 0, "quality", 0.97)])
def test_held_out_accuracy(spark, name, parts, held, column, floor):
    rows = queries.QUERIES[name](spark, SF).collect()
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tested = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in tested if y], [s for s, y in tested if not y]
    assert np.mean([p > n for p in pos for n in neg]) > floor


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "x " * 70_000, 7), (3, "x " * 70_000, 7), (None, "good words", 7)], "doc_id long, text string, _score int")
    labels = spark.createDataFrame([(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = subwords.classify(docs, model, 0.3).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    kept = subwords.keep(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == 5
    assert subwords.classify(docs.limit(0), model, 0.3).count() == 0
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int"))
    rows = subwords.score(docs, model).collect()
    assert rows[0].score == rows[1].score == pytest.approx(1 / 3) and rows[2].score == rows[3].score
