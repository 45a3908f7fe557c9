import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from vellum.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(public_tokenizers.path(bpe.RANKS), "rb").read(), public_tokenizers.PATTERN)


def brute_force(text, ranks):
    """Merges the lowest-ranked pair of each match, again and again."""
    out = []
    for match in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while True:
            best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        out += [ranks[p] for p in parts]
    return out


TEXTS = ["", " ", "a", "It's we'll  x \n\n y\t", "naïve 😀😀 été १२", "<|endoftext|>", "a" * 300, "0123456789 " * 9, "\r\n  　x", "\x00\x1f"]


def test_matches_brute_force_and_round_trip(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(98, None), (0, "")], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.ids == brute_force(r.text or "", ranks)
        assert bytes(r.decoded) == (r.text or "").encode()
    packed = bpe.decode(bpe.encode(df, packed=True)).collect()
    assert [bytes(r.ids) for r in packed] == [b"".join(i.to_bytes(4, "little") for i in r.ids) for r in rows]
    assert [r.decoded for r in packed] == [r.decoded for r in rows]


def test_pieces_do_not_change_tokens(codec):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "'s", "'", " ", "  ", "\n", "\t", "7", "é", "!", " ", " ", "😀"]) for _ in range(rng.randrange(80)))
        cut = list(bpe.pieces(text, 5))
        assert "".join(cut) == text
        assert sum((codec.encoding.encode_ordinary(p) for p in cut), []) == codec.encoding.encode_ordinary(text)


def test_long_text(spark, codec):
    text = ("word 12 été\n" * 40_000) + "x" * 100_000
    row = bpe.decode(bpe.encode(spark.createDataFrame([(text,)], "text string"), packed=True)).first()
    assert bytes(row.decoded).decode() == text
    assert len(row.ids) // 4 == len(codec.encoding.encode_ordinary(text))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "text string, ids string, decoded int")
    assert bpe.decode(bpe.encode(df)).count() == 0
    one = bpe.encode(spark.createDataFrame([("a b", "old", 1)], "text string, ids string, n int"))
    assert one.columns == ["text", "ids", "n"] and len(one.first().ids) == 2


def test_query(spark, codec):
    rows = queries.op1_byte_bpe(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect())
    assert len(rows) == len(texts)
    for r in rows:
        ids = codec.encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
