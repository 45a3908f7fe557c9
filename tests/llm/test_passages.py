import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from vellum.llm import fmindex, passages, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(texts, least=35):
    """For each text its words and whether each is removed."""
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            if count[tuple(w[i : i + least])] > 1:
                gone[i : i + least] = [True] * least
        out.append((w, gone))
    return out


def expected(rows, least=35):
    return sorted(((k, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for (k, _), (w, g) in zip(rows, brute_force([t for _, t in rows], least))), key=repr)


def result(df, **how):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in passages.drop_repeated(df, **how).collect()), key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_index_finds_what_recurs(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint64) * np.uint64(2**62 + 12345) for _ in range(rng.integers(1, 12))]
    heavy, least = rng.random(len(texts)) < 0.1, int(rng.integers(2, 6))
    count = Counter()
    for t, h in zip(texts, heavy):
        for i in range(len(t) - least + 1):
            count[tuple(t[i : i + least].tolist())] += 1 + h
    for t, got in zip(texts, fmindex.Index(texts, heavy).recurring(texts, least)):
        assert got.tolist() == [count[tuple(t[i : i + least].tolist())] > 1 for i in range(len(t) - least + 1)]


def test_index_counts_patterns():
    text = np.array([7, 8, 7, 8, 7, 9], np.uint64)
    index = fmindex.Index([text], np.zeros(1, bool))
    for pattern, n in (([7], 3), ([7, 8], 2), ([8, 7, 8], 1), ([9, 7], 0), ([5], 0)):
        low, high = np.array([0]), np.array([index.size])
        for symbol in index.symbols_of(np.array(pattern, np.uint64))[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        assert int(high[0] - low[0]) == n


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(50):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 40))] + [-1]
        assert fmindex.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_windows_are_in_one_segment_each():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 4, n).astype(np.uint64) for n in (0, 5, 34, 35, 36, 400)] + [np.zeros(300, np.uint64)]
    own, first, n, key, _, twice = passages.segments(pieces, 35)
    got = sorted((o, f + k) for o, f, m in zip(own.tolist(), first.tolist(), n.tolist()) for k in range(m))
    assert got == [(i, k) for i, p in enumerate(pieces) for k in range(len(p) - 34)]
    keys = {}
    for o, f, m, x, t in zip(own.tolist(), first.tolist(), n.tolist(), key.tolist(), twice.tolist()):
        windows = [tuple(pieces[o][f + k : f + k + 35].tolist()) for k in range(m)]
        assert t or len(set(windows)) == len(windows)
        for w in windows:
            assert keys.setdefault(w, x) == x


def planted(rng, docs):
    """Documents of few words with copied passages of many lengths, edits and repeats within."""
    base = [f"w{rng.randrange(40)}" for _ in range(3000)]
    rows = []
    for i in range(docs):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            a, n = rng.randrange(2900), rng.choice([20, 34, 35, 36, 70, 90])
            at = rng.randrange(len(words) + 1)
            words[at:at] = base[a : a + n]
        if words and rng.random() < 0.2:
            words += words[: rng.randrange(80)]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    return rows


@pytest.mark.parametrize("crowd", [1024, 2])
def test_equals_brute_force(spark, crowd):
    rng = random.Random(crowd)
    rows = planted(rng, 300)
    line = " ".join(f"c{i}" for i in range(40))  # one passage between many different neighbours
    rows += [(1000 + i, f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(40))} {line} {' '.join(f'b{rng.randrange(10**6)}' for _ in range(40))}") for i in range(30)]
    rows += [(2000, "x " * 200), (2001, "x y " * 34), (2002, "p q " * 35), (2003, ""), (2004, None)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd, shard_words=4000)
    assert got == expected(rows)


def test_copies_need_no_index_and_texts_are_read_once(spark, monkeypatch):
    rng = random.Random(5)
    line = " ".join(f"c{i}" for i in range(40))
    copies = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(5)]
    near = [(1000 + i, f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(40))} {line} {' '.join(f'b{rng.randrange(10**6)}' for _ in range(40))}") for i in range(30)]
    reads, real = [], passages._fetched
    monkeypatch.setattr(passages, "_fetched", lambda docs, wanted, least: reads.append(wanted.count()) or real(docs, wanted, least))
    same = [(i, copies[i % 5]) for i in range(20)]
    assert result(spark.createDataFrame(same, "doc_id long, text string")) == expected(same) and sum(reads) == 0
    reads.clear()
    rows = same + near
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), crowd=2) == expected(rows) and len(reads) == 1 and reads[0] > 0


def test_repeated_rows_null_keys_and_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, "a " + long[3:]), (None, None), (2, "ünïcode " * 50), (3, "few words"), (3, "few words")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_words int, mark string, found int")
    out = passages.drop_repeated(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_words", "mark", "found", "n_removed"])
    assert {(r.mark, r.found) for r in out.collect()} == {("x", 2)}
    assert result(df) == expected(rows)


def test_empty_table_and_other_lengths(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []
    rows = planted(random.Random(9), 60)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), least=8) == expected(rows, 8)
    with pytest.raises(ValueError):
        passages.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"), least=5)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 50)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(700)) for _ in range(3)]
    pieces = [passages.digests(t.encode()) for t in texts]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(3)), "mark": pa.array(range(3)), "text": pa.array(texts)})
    got = [r for b in passages._cut(35)([batch]) for r in b.to_pylist()]
    assert sorted((r["doc"], r["start"] + k) for r in got for k in range(r["n"])) == [(d, k) for d in range(3) for k in range(666)]
    assert [list(passages.words_of(t.encode(), 100)) != [t.encode().split()] for t in texts] == [True] * 3
    assert all(sum(passages.words_of(t.encode(), 100), []) == t.encode().split() for t in texts)
    assert all(len(p) == 700 for p in pieces)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (n, gone, hashlib.sha256(text.encode()).hexdigest()) for k, n, gone, text in expected(rows)}
    got = queries.op12_fm_index(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 0
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert {r[0]: r[1:] for r in db.execute(queries.ORACLE_SQL["op12_fm_index"]).fetchall()} == want
