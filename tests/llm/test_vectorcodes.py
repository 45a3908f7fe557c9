import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from vellum.llm import queries, vectorcodes

SF = "/root/testdata/sf0.001"


def brute_force(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (id, vector, label); plain integers and loops."""
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = vectorcodes.bounds(len(good[0][1]), parts)
    books = [[r[1][cut[p] : cut[p + 1]] for r in good[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        held = [[[] for _ in books[p]] for p in range(parts)]
        for _, v, _ in good:
            for p in range(parts):
                x = v[cut[p] : cut[p + 1]]
                held[p][nearest(p, x)[1]].append(x)
        books = [[[sum(c) // len(xs) for c in zip(*xs)] if xs else books[p][k] for k, xs in enumerate(held[p])] for p in range(parts)]
    out = []
    for i, v, label in good:
        near = [nearest(p, v[cut[p] : cut[p + 1]]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, label, code, error in out), key=repr)


def coded(df, **how):
    rows = vectorcodes.compress(df, **how).collect()
    return sorted(((r.vec_id, "".join(f"{k:02x}" for k in r.code), r.error, r.label_error, r.codebooks_sha256) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_nearest_with_ties_to_the_lower_index(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3, 4, (64, 3)) * 10 ** (2 * seed)
    points = rng.integers(-4, 5, (2000, 3)) * 10 ** (2 * seed)
    index, squares = vectorcodes.Tree(entries).nearest(points)
    full = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (squares == full.min(axis=1)).all()


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries.op13_vector_codes(spark, SF).collect()), key=repr)
    assert got == brute_force(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(db.execute(queries.ORACLE_SQL["op13_vector_codes"]).fetchall(), key=repr) == got


def test_nulls_ties_repeats_and_extra_columns(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-0.5, 0.0, 0.25, 1 / 512, -1 / 512]) for _ in range(18)]
    rows = [(i, vector(), rng.choice([None, 1, 2])) for i in range(150)]
    rows += [rows[3], rows[3], (3, vector(), 2), (None, vector(), None), (200, None, 1), (201, [None] * 18, 1), (202, [float("nan")] + [0.0] * 17, 1), (203, [float("-inf")] + [0.0] * 17, 1)]
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as code", "'x' as error", "2 as coded")
    assert coded(df) == brute_force(rows)
    assert coded(df.repartition(7)) == brute_force(rows)


def test_other_widths_empty_tables_and_few_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert coded(spark.createDataFrame([], schema)) == []
    assert coded(spark.createDataFrame([(1, None, 1)], schema)) == []
    rows = [(1, [0.5] * 16, 1), (2, [0.25] * 16, 1), (3, [1.0] * 3, 1), (4, [], 1)]
    assert coded(spark.createDataFrame(rows, schema)) == brute_force(rows[:2])


def test_decode_gives_the_entries(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.125, 0.75], 0)], "vec_id long, embedding array<double>, label int")
    books = vectorcodes.fit(df, parts=2)
    rows = vectorcodes.decode(vectorcodes.encode(df, books), books).collect()
    assert all(r.decoded == r.embedding and r.error == 0 for r in rows)


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 16, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        vectorcodes.fit(df)
