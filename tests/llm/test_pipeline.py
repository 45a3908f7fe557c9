import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from test_mixing import plain_targets
from test_shingles import plain_kept
from test_simhash import plain_components, plain_fingerprint
from vellum.llm import bpe, lines, mixing, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage leaves, written and read back as the next one's input."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append(docs)
    return out


def test_against_plain_versions(spark, kept):
    """Each stage against a plain version of it over the same input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~corpus_pipeline.fold(0, 5)))
    for frame in kept[:4]:
        assert frame.columns == docs.columns and dict(frame.dtypes) == dict(docs.dtypes)
    rows = docs.collect()
    assert sorted(r.doc_id for r in kept[0].collect()) == sorted(r.doc_id for r, s in zip(rows, model.score([r.text or "" for r in rows])) if s >= 0.3)

    con = duckdb.connect()
    con.register("documents", kept[0].select("doc_id", "text").toPandas())
    assert sorted(con.sql(f"SELECT doc_id, text FROM ({lines.SQL})").fetchall()) == sorted((r.doc_id, r.text) for r in kept[1].collect())
    assert all(r.n_chars == len(r.text) for r in kept[1].collect())

    texts = {r.doc_id: r.text for r in kept[1].collect()}
    first = set(plain_components({k: plain_fingerprint(t) for k, t in texts.items()}).values())
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(plain_kept({k: texts[k] for k in first}))

    sizes = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in kept[2].collect()}
    words, got = Counter(), Counter()
    for s, n in sizes.values():
        words[s] += n
    names = sorted(words)
    goals = plain_targets([words[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for r in kept[3].collect():
        n = len(WORD.findall(r.text))
        assert 0 < n <= 2 * sizes[r.doc_id][1]
        got[r.source] += n
    for n, goal in zip(names, goals):
        assert abs(got[n] - goal) <= max(0.05 * goal, 3 * mixing.BLOCK)

    codec = bpe.Codec(open(public_tokenizers.path(bpe.RANKS), "rb").read(), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    final = kept[4].collect()
    assert sorted(r.doc_id for r in final) == sorted(texts)
    for r in final:
        ids = codec.encode(texts[r.doc_id])
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_nulls_and_empty(spark, tmp_path):
    at = str(tmp_path)
    rows = [(1, None, None, None, None), (None, "a b c d", "en", "s", 7), (2, "", "en", None, 0), (2, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    for name, data in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, at)
        assert docs.count() == (1 if data else 0)
