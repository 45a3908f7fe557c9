import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import kneser, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


class Plain:
    """The model in dictionaries of words."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            seq = ["<begin>", *words(t), "<end>"]
            self.uni.update(seq[1:])
            self.bi.update(zip(seq, seq[1:]))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.before, self.after = Counter(), defaultdict(list)
        for (a, b), n in self.bi.items():
            self.before[b] += 1
            self.after[a].append(n)
        self.d2 = (0.0, *kneser.discounts(*(sum(n == k for n in self.bi.values()) for k in (1, 2, 3, 4))))
        self.d1 = (0.0, *kneser.discounts(*(sum(n == k for n in self.before.values()) for k in (1, 2, 3, 4))))
        self.rest = sum(self.d1[min(n, 3)] for n in self.before.values()) / len(self.bi) if self.bi else 1.0

    def low(self, w):
        n = self.before[w]
        return (n - self.d1[min(n, 3)]) / max(1, len(self.bi)) + self.rest / (self.v + 1)

    def p(self, a, b):
        after = self.after.get(a)
        if not after:
            return self.low(b)
        n = self.bi[a, b]
        return (n - self.d2[min(n, 3)]) / sum(after) + sum(self.d2[min(n, 3)] for n in after) / sum(after) * self.low(b)

    def score(self, t):
        seq = ["<begin>", *words(t), "<end>"]
        base = sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in seq[1:])
        return len(seq) - 1, sum(w in self.uni for w in seq[1:]), base, sum(math.log10(self.p(a, b)) for a, b in zip(seq, seq[1:]))


def test_query_matches_plain_model(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    plain = Plain([t for k, t in docs.items() if not held[k]])
    rows = queries.op9_kneser_ney(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == held[r.doc_id] and r.train_tokens == plain.n
        n, known, base, full = plain.score(docs[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # foretells held-out text better than counts do


TEXTS = ["a b a b a c", "A b\tc c c", "", None, "b b b b", "é É", "x " * 30_000, "a b a b a c"]


@pytest.mark.parametrize("shards", [1, 7])
def test_probabilities_sum_to_one_and_edge_cases(spark, shards):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], "doc_id long, text string, lm string")
    model, plain = kneser.fit(df, shards=shards), Plain(TEXTS)
    for before in ("<begin>", "a", "c", "unseen"):
        assert sum(plain.p(before, w) for w in plain.uni) + plain.p(before, "never") == pytest.approx(1)
    asked = [*TEXTS, "never seen words", "a never"]
    for got, t in zip(zip(*model.score([t or "" for t in asked])), asked):
        assert got == pytest.approx(plain.score(t))
    assert kneser.score(df, model).columns == df.columns
    assert kneser.score(df.limit(0), model).count() == 0


def test_empty_training_table(spark):
    model = kneser.fit(spark.createDataFrame([], "text string"), shards=2)
    n, known, base, full = model.score(["a b", ""])
    assert n.tolist() == [3, 1] and known.tolist() == [0, 0] and np.isfinite(full).all() and np.isfinite(base).all()
