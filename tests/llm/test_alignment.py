import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from vellum.llm import alignment, queries

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", None, " ", "a", "Hello world", "naïve café 你好 😀 é", "two  spaces", "tab\tand\nnewline\r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", " lead", "trail ",
    "x" * 300, "ﬁ ligature ½ Å", "\x00\x1f control", "don't we'll 1234567 !?!? ---", "١٢٣ हिन्दी ไทย", "é   nbsp　",
]


@pytest.fixture(scope="module")
def plain():
    """A text's token ids and bytes by both libraries, as their files say."""
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = alignment.byte_level()

    def of(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None

    return of


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute_force(texts, plain):
    docs, count = [], Counter()
    for text in texts:
        found = plain(text)
        if found is None:
            docs.append(None)
            continue
        ids_a, bytes_a, ids_b, bytes_b = found
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, at_a) for y, (u, v) in zip(ids_b, at_b) if s < v and u < e]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            sides = [",".join(str(i) for i, (s, e) in zip(ids, at) if lo <= s and e <= hi) for ids, at in ((ids_a, at_a), (ids_b, at_b))]
            groups.append("|".join(sides))
        docs.append((len(ids_a), len(ids_b), ";".join(groups), links))
        count.update(links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, "", 0, 0))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, groups.count(";") + 1, len(links), hashlib.sha256(groups.encode()).hexdigest(), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def scored(df, **how):
    return sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in alignment.score_links(df, **how).collect()), key=repr)


@pytest.mark.parametrize("max_table", [alignment.MAX_TABLE, 0])
def test_equals_brute_force(spark, plain, max_table):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["the ", "cat", " sat", "é", " ", "12", "\n", "ing", "😀", ", "]) for _ in range(rng.randrange(40))) for _ in range(40)] + ["same text"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert scored(df, max_table=max_table) == sorted(((i, *r) for i, r in enumerate(brute_force(texts, plain))), key=repr)


def test_groups_and_pairs(spark, plain):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in alignment.align(df).collect():
        found = plain(r.text)
        got = r.aligned
        if found is None:
            assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.groups, got.pairs, got.times) == (0, 0, 0, 0, "", [], [])
            continue
        sides = [g.split("|") for g in got.groups.split(";")]
        assert [int(i) for a, _ in sides for i in a.split(",")] == found[0] and [int(i) for _, b in sides for i in b.split(",")] == found[2]
        assert sum(got.times) == got.n_links == got.n_a + got.n_b - got.n_groups and got.pairs == sorted(set(got.pairs))


def test_cut_texts_have_the_same_tokens(plain, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE_CHARS", 5)
    files = [open(public_tokenizers.path(n), "rb").read() for n in (alignment.TOKENIZER_A, alignment.TOKENIZER_B)]
    both, rng = alignment.Tokenizers(*files), random.Random(2)
    assert not any("▁" in both.b.id_to_piece(i).lstrip("▁") for i in range(both.b.get_piece_size()))
    texts = ["".join(rng.choice(["a", "B", "'s", "'", " ", "  ", "\n", "7", "é", "!", " ", "　", "😀", "_", "你", "́"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    assert any(len(list(alignment.pieces(t, 5))) > 2 for t in texts)
    for text, got in zip(texts, both.encode(texts)):
        want = plain(text)
        assert (got is None) == (want is None)
        if want:
            assert got[0].tolist() == want[0] and got[1].tolist() == want[2]


def test_byte_level_is_a_bijection():
    table = alignment.byte_level()
    assert len(table) == 256 and sorted(table.values()) == list(range(256)) and table["Ġ"] == 32 and table["A"] == 65


def test_sums_of_many_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 50, 9)).tolist(),) for _ in range(200)]
    df = spark.createDataFrame([([(a << 32) | 1 for a in r], list(range(1, len(r) + 1))) for (r,) in rows], "pairs array<long>, times array<int>")
    want = Counter()
    for (r,) in rows:
        want.update({(a << 32) | 1: k + 1 for k, a in enumerate(r)})
    got = alignment.link_counts(df).collect()
    assert {r.pair: r["count"] for r in got} == dict(want)
    assert {r.pair for r in got if r.best} == {p for p, n in want.items() if n == max(want.values())}


def test_empty_table_repeats_and_other_columns(spark, plain):
    assert scored(spark.createDataFrame([], "doc_id long, text string")) == []
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 6, None)], "doc_id long, text string, N_A int, aligned string")
    out = alignment.score_links(df)
    assert out.columns == ["doc_id", "text", "aligned", *COLUMNS]
    assert scored(df) == sorted(((k, *r) for k, r in zip([1, 1, None], brute_force(["a b", "a b", None], plain))), key=repr)


def test_query_equals_brute_force(spark, plain):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op11_alignment(spark, SF).collect()}
    assert set(got) == set(texts)
    for r, want in zip(rows, brute_force([r.text for r in rows], plain)):
        assert tuple(got[r.doc_id][c] for c in COLUMNS[:5]) == want[:5]
    # corpus-wide sums agree: each pair counted n times adds n * n
    assert all(r.n_best <= r.n_links <= r.count_sum for r in got.values())
