import random
import re

import pytest
import xxhash

from vellum.llm import queries, simhash
from vellum.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """key -> smallest key reachable, comparing all pairs."""
    out = {}
    keys = sorted(pairs)
    for k in keys:
        if k in out:
            continue
        todo, seen = [k], {k}
        while todo:
            at = todo.pop()
            for o in keys:
                if o not in seen and bin(pairs[at] ^ pairs[o]).count("1") <= 2:
                    seen.add(o)
                    todo.append(o)
        for s in seen:
            out[s] = k
    return out


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op4_simhash(spark, SF).collect()}
    prints = {k: plain_fingerprint(t) for k, t in docs.items()}
    assert {k: f"{v:016x}" for k, v in prints.items()} == {k: r.fingerprint for k, r in rows.items()}
    assert plain_components(prints) == {k: r.component_id for k, r in rows.items()}


@pytest.mark.parametrize("limit", [512, 4])
def test_links_of_crowded_fingerprints(spark, monkeypatch, limit):
    """With tiny trees the crowded shards are dealt twice more, and nothing changes."""
    monkeypatch.setattr(simhash, "TREE_SIZE", limit)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set(base)
    for b in base[:3]:
        for _ in range(60):
            v = b
            for _ in range(rng.randrange(1, 7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint long")
    roots = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(df)).collect()}
    want = plain_components({v: v for v in values})
    groups, found = {}, {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
        found.setdefault(roots.get(v, simhash._signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    values = [rng.getrandbits(10) for _ in range(200)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.within(q, 2)) == sorted({v for v in values if bin(v ^ q).count("1") <= 2})


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_edge_cases(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "x"), (3, text.upper(), "y"), (3, text.upper(), "y"), (7, None, "z"), (8, " \n", "z"), (9, "only two", None), (None, text, None), (4, "word " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted([(5, 3), (3, 3), (3, 3), (7, 7), (8, 7), (9, 9), (None, 3), (4, 4)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0
