import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from vellum.llm import mixing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights):
    """Shares again and again, exactly."""
    goal, capped = {}, set()
    while True:
        left = Fraction(3, 2) * sum(sizes) - sum(2 * sizes[i] for i in capped)
        total = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        goal = {i: (2 * sizes[i] if i in capped else left * weights[i] / total) for i in range(len(sizes))}
        over = {i for i in goal if goal[i] > 2 * sizes[i]}
        if not over:
            return [float(goal[i]) for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 5, 7], [0, 0], [3], [0, 9, 100, 4, 4, 80, 1]])
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 7))
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert out.tolist() != mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 8)).tolist() != list(range(n))


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = {k: len(WORD.findall(d.text or "")) for k, d in docs.items()}
    names = sorted({d.source for d in docs.values()})
    words = Counter()
    for k, d in docs.items():
        words[d.source] += sizes[k]
    goals = dict(zip(names, plain_targets([words[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    got = Counter()
    for r in rows:
        name = docs[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], words[name])
        assert r.target == pytest.approx(goals[name])
        assert 0 <= r.taken <= 2 * r.size
        got[name] += r.taken
    for n in names:
        assert abs(got[n] - goals[n]) <= max(0.03 * goals[n], 3 * mixing.BLOCK)
    again = queries.op7_mixing(spark, SF).repartition(7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mixed_texts_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    before = {r.doc_id: Counter(WORD.findall(r.text or "")) for r in docs.collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        words = WORD.findall(r.text)
        seen[r.doc_id] = len(words)
        assert all(n <= 2 * before[r.doc_id][w] for w, n in Counter(words).items())
    assert seen == {k: n for k, n in taken.items() if n}


def test_blocks_come_twice_at_most(spark):
    sources = [mixing.Source("a", 12_800, 9, 19_200.0, 100, 150.0), mixing.Source(None, 640, 1, 1280.0, 5, 10.0)]
    times = defaultdict(int)
    for r in mixing.slots(spark, sources).collect():
        times[r.src, r.block] += 1
    assert set(times.values()) <= {1, 2} and all(0 <= b < sources[s].blocks for s, b in times)
    assert sum(n for (s, _), n in times.items() if s == 0) == pytest.approx(150, abs=3)


def test_draws_meet_their_targets_and_vary(spark):
    """Every shard is full, every source ends at what it is due, and a shard's counts spread as multinomial ones."""
    sources = [mixing.Source(n, 10_000_000, 9, 0.0, 400_000, k) for n, k in (("a", 300_000.0), ("b", 100_000.0), (None, 200_000.0))]
    shards, last = [], Counter()
    for run in mixing.runs(sources):
        for s in run.single(mixing.SEED):
            shards.append((s.first, s.due.tolist()))
            assert s.before.tolist() == [last[i] for i in range(3)]
            last.update(dict(enumerate(s.due.tolist())))
    assert [f for f, _ in shards] == list(range(len(shards))) and [last[i] for i in range(3)] == [300_000, 100_000, 200_000]
    assert {sum(c) for _, c in shards[:-1]} == {mixing.SLOTS}
    counts = np.array([c for _, c in shards[:-1]])
    p = np.array([0.5, 1 / 6, 1 / 3])
    assert counts.mean(axis=0) == pytest.approx(mixing.SLOTS * p, rel=0.01)
    assert counts.var(axis=0) == pytest.approx(mixing.SLOTS * p * (1 - p), rel=0.35)
    assert [r.due.tolist() for r in mixing.runs(sources)] == [r.due.tolist() for r in mixing.runs(sources)]
    rows = mixing.slots(spark, sources)
    assert rows.count() == 600_000 and rows.select("src", "slot").distinct().count() == 600_000 and rows.rdd.getNumPartitions() > 8


def test_more_draws_than_the_driver_takes():
    many = [mixing.Source(str(i), 1, 1, 0.0, 10_000, 5000.0 + i) for i in range(3000)]
    found = mixing.runs(many)
    assert len(found) * len(many) <= mixing.MAX_DRAWS and sum(r.due for r in found).tolist() == [5000 + i for i in range(3000)]
    last = list(found[-1].single(mixing.SEED))[-1]
    assert last.first == found[0].shards * 0 + sum(r.shards for r in found) - 1 and (last.before + last.due).tolist() == [5000 + i for i in range(3000)]


def test_edge_cases(spark):
    rows = [(1, None, "a", 0), (2, "", None, 0), (3, " \n", "b", 0), (4, "x y " * 30_000, None, 1), (4, "x y " * 30_000, None, 1), (None, "one two three", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _row int")
    got = mixing.taken(df).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 120_003
    assert all(r.taken == 0 for r in got if not r.size) and all(r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(180_004, rel=0.01)
    out = mixing.mixed(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {4, None}
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_draws_are_hypergeometric_at_every_size():
    rng = np.random.default_rng(1)
    for good, bad, n in ((300, 700, 100), (700, 300, 900), (50, 5000, 60), (400, 400, 400), (5, 10**6, 1000), (900, 100, 40), (7, 9, 16), (0, 9, 4)):
        ours = np.array([mixing.hypergeometric(rng, good, bad, n, many=0) for _ in range(5000)])
        share, rest = good / (good + bad), good + bad - n
        mean, deviation = n * share, (n * share * (1 - share) * rest / max(1, good + bad - 1)) ** 0.5
        assert abs(ours.mean() - mean) <= 5 * deviation / 5000**0.5 + 1e-9
        assert 0.93 * deviation <= ours.std() <= 1.07 * deviation or deviation < 0.1
        assert ours.min() >= max(0, n - bad) and ours.max() <= min(n, good)
    due = np.array([3 * 10**12, 0, 10**12, 5, 4 * 10**12])
    got = np.array([mixing.drawn(rng, 2 * 10**12, due) for _ in range(300)])
    assert (got.sum(axis=1) == 2 * 10**12).all() and (got <= due).all() and (got >= 0).all()
    assert np.abs(got.mean(axis=0) / 2e12 - due / due.sum()).max() < 1e-6
    small = np.array([3, 5, 2])
    assert (mixing.drawn(np.random.default_rng(2), 10, small, many=0) == small).all()
