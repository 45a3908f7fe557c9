import hashlib
import random

import numpy as np
import pytest

from vellum.llm import phrases, queries

SF = "/root/testdata/sf0.001"


def names(text, level):
    row = phrases._mix(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + phrases._A)
    for _ in range(level):
        row, _ = phrases.next_level(row, np.zeros(1, np.int64))
    return row.tolist()


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_equal_substrings_share_interior_names_at_any_offset(level):
    rng = random.Random(level)
    shared = "".join(rng.choice("abcdefgh  aab") for _ in range(3000))
    one = names("".join(rng.choice("xyz ab") for _ in range(517)) + shared, level)
    two = names("".join(rng.choice("pq ab") for _ in range(88)) + shared + "tail", level)
    inside = names(shared, level)
    rim = 40
    window = inside[rim:-rim]
    if window:
        text = lambda row: "," + ",".join(map(str, row)) + ","
        assert text(window) in text(one) and text(window) in text(two)


def test_phrases_are_short_and_cover_the_row():
    rng = random.Random(1)
    for size in (2, 3, 5, 50, 5000):
        text = "".join(rng.choice("abc") for _ in range(size))
        up = names(text, 1)
        assert size / 40 < len(up) <= max(1, size / 2 + 1)
    assert len(names("a" * 5000, 1)) == 1


def test_near_copies_of_any_length_are_alike():
    """Likeness does not fall where a text grows past some length."""
    rng = random.Random(7)
    for _ in range(20):
        text = "".join(rng.choice("abcdefgh  ") for _ in range(300))
        for size in range(100, 300, 13):
            assert phrases.alike(*phrases.sketches([text[:size], text[: size + 2]])) > 0.5
        assert phrases.alike(*phrases.sketches([text[:255], text[:257]])) > 0.7


def plain_likeness(a, b):
    """Jaccard similarity of the SKETCH smallest of the union."""
    if a == b:
        return 1.0
    x, y = ({v[i : i + 8] for i in range(0, len(v), 8)} for v in (a, b))
    union = sorted(x | y)
    if max(len(x), len(y)) >= phrases.SKETCH:
        union = union[: phrases.SKETCH]
    return sum(v in x and v in y for v in union) / len(union)


def test_query_matches_plain_version(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), reverse=True)
    rows = {r.doc_id: r for r in queries.op5_phrases(spark, SF).collect()}
    assert len(rows) == len(docs)
    one = lambda t: phrases.hexed(phrases.sketches([t])[0])
    for i, (key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)].text or ""
        text = text or ""
        m = len(text) // 3
        new = text[: len(text) - m] + following[:m]
        r = rows[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (one(text), one(new))
        assert r.near_edited == pytest.approx(plain_likeness(one(text), one(new)))
        assert r.near_next == pytest.approx(plain_likeness(one(text), one(following)))
    long = [r for r in rows.values() if r.n_chars > 300]
    assert min(r.near_edited for r in long) > 0.2 and np.mean([r.near_next for r in long]) < 0.05


def test_one_key_lies_in_many_ranges(spark):
    """Rows of one key and rows without one follow one another by the hashes of their texts, over all ranges."""
    rows = [(k, f"text number {i} of key {k}") for i in range(300) for k in (7, None)] + [(9, "first"), (-(1 << 63), "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {(r.doc_id, r.text): r.h for r in df.selectExpr("*", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r]))
    want = sorted(hashlib.sha256(phrases.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    out = phrases.compare_with_next(df, ranges=12)
    assert sorted(r.edited_sha256 for r in out.collect()) == want


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edge_cases(spark, ranges):
    texts = {9: "same text of some length, twice", 7: "same text of some length, twice", 5: None, 4: "", 3: "ß😀é", -2: "z" * 200_000, None: "no key"}
    rows = [(k, t, "x") for k, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = {r.doc_id: r for r in phrases.compare_with_next(df, ranges=ranges).collect()}
    order = [9, 7, 5, 4, 3, -2, None]
    assert set(got) == set(order)
    for k, nxt in zip(order, order[1:] + order[:1]):
        new = phrases.edited(texts[k] or "", texts[nxt] or "")
        assert got[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest(), k
    assert got[9].fingerprint == got[7].fingerprint and got[9].near_next == 1.0 and got[5].fingerprint == "" and got[5].near_edited == 1.0
    assert phrases.compare_with_next(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "doc_id long, text string")
    assert phrases.compare_with_next(twice, ranges=ranges).count() == 3
    assert {r.f for r in phrases.fingerprint(df, out="f").where("doc_id > 5").collect()} == {got[9].fingerprint}
