import math
import random

import numpy as np
import pytest

from vellum.llm import multiindex, queries

SF = "/root/testdata/sf0.01"


def exact(vectors, asked, k=5):
    """query -> [(score, id)] by comparing all pairs."""
    out = {}
    for q in asked:
        a = vectors[q]
        na = math.sqrt(math.fsum(x * x for x in a))
        found = [(math.fsum(x * y for x, y in zip(a, b)) / na / math.sqrt(math.fsum(y * y for y in b)), i) for i, b in vectors.items() if i != q]
        out[q] = sorted(found, key=lambda f: (-round(f[0], 12), f[1]))[:k]
    return out


def test_recall_and_scores(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = exact(vectors, [i for i in vectors if i % 50 == 0])
    rows = queries.op3_multi_index(spark, SF).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(found) == 5 and all(v != q for _, v in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
        scores = {v: s for s, v in exact(vectors, [q], len(vectors))[q]}
        assert all(abs(s - scores[v]) < 1e-12 for s, v in found)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_recall_on_the_larger_table(spark):
    large = SF.replace("0.01", "0.1")
    table = spark.read.parquet(f"{large}/embeddings.parquet").toPandas()
    m, ids = np.array(table.embedding.tolist(), dtype=float), table.vec_id.to_numpy()
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in queries.op3_multi_index(spark, large).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    asked = np.flatnonzero(ids % 50 == 0)
    for q in asked:
        near = m @ m[q]
        near[q] = -2
        hits += len(got[ids[q]] & set(ids[np.argsort(-near)[:5]].tolist()))
    assert set(got) == set(ids[asked].tolist()) and hits >= 0.9 * 5 * len(asked)


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random(7), rng.random(5)
        sizes = rng.integers(0, 4, 35)
        cells = multiindex.walk(a, b, sizes, 10**9)
        sums = [a[c // 5] + b[c % 5] for c in cells]
        assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(sizes).tolist()
        some = multiindex.walk(a, b, sizes, 12)
        assert some == cells[: len(some)] and sum(sizes[some]) >= 12 > sum(sizes[some[:-1]])


@pytest.mark.parametrize("block,group", [(2048, 512), (3, 2)])
def test_copies_ties_and_odd_vectors(spark, block, group):
    rng = random.Random(1)
    vectors = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(40)}
    for i in range(40, 70):
        vectors[i] = vectors[3]  # thirty copies
    vectors[70], vectors[71] = [2 * x for x in vectors[4]], [2.0**600 * x for x in vectors[4]]
    odd = {80: None, 81: [0.0] * 6, 82: [1.0, None, 1.0, 1.0, 1.0, 1.0], 83: [float("nan")] * 6, 84: [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 85: [], 86: [1.0, 2.0]}
    rows = [(i, v, "x") for i, v in [*vectors.items(), *odd.items()]] + [(5, vectors[5], "again"), (None, vectors[1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    got = {}
    for r in multiindex.search(df, df, share=1.0, centroids=4, block=block, group=group).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    want = exact({k: [x / 2.0**600 for x in v] if k == 71 else v for k, v in vectors.items()}, list(vectors))
    assert set(got) == set(vectors)
    for q, found in want.items():
        assert [got[q][i] for i in range(1, 6)] == [v for _, v in found], q
    few = df.where("vec_id in (1, 2, 3)")
    assert multiindex.search(few, few).count() == 6
    assert multiindex.search(df.limit(0), df).count() == 0 and multiindex.search(df, df.limit(0)).count() == 0
