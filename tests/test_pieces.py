"""Large batches are worked off in pieces: the results are those of single rows, and no function sees more than a piece."""

import pyarrow as pa
import pytest

from vellum.functions import pieces
from vellum.llm import bpe, mixing
from vellum.operators import blocks, markup, packing
from vellum.sources import splits

PAGES = [f"<body><ul>{''.join(f'<li><a href=x{i}>item {i} {k}</a></li>' for k in range(40))}</ul></body>" for i in range(1500)] + [None, ""]


def test_no_more_than_a_piece_at_once():
    seen = []

    def run(texts):
        seen.append(sum(len(t or "") for t in texts))
        return [[t] for t in texts]

    texts = ["x" * 1000] * 5000 + ["y" * (3 * pieces.PIECE), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    out = list(pieces.batched(run, pa.list_(pa.string()))(iter([batch])))
    assert sorted(seen)[-1] == 3 * pieces.PIECE and sorted(seen)[-2] <= pieces.PIECE and max(b.num_rows for b in out) < 1100
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(len(texts))) and [v for b in out for v in b.column(1).to_pylist()] == [[t] for t in texts]
    seen.clear()
    assert pieces.over(run, pa.list_(pa.string()))(pa.array(texts)).to_pylist() == [[t] for t in texts] and sorted(seen)[-2] <= pieces.PIECE
    assert pieces.over(run, pa.list_(pa.string()))(pa.array([], pa.string())).to_pylist() == []


def test_results_as_large_as_rows_leave_in_pieces(spark):
    texts = ["x" * 1000] * 5000 + ["y" * (3 * pieces.PIECE), None]
    done = []
    work = pieces.streamed(lambda t, k: pa.array([a and a + b for a, b in zip(t.to_pylist(), k.to_pylist())]), lambda: done.append(1))
    out = list(work(iter([(pa.array(texts), pa.array(["z"] * len(texts))), (pa.array([], pa.string()), pa.array([], pa.string()))])))
    assert [v for a in out for v in a.to_pylist()] == [t and t + "z" for t in texts] and max(map(len, out)) < 1100 and done == [1]
    calls = []  # the token codec and the mix work so

    real = pieces.streamed
    with pytest.MonkeyPatch.context() as m:
        for module in (bpe, mixing):
            m.setattr(module, "streamed", lambda run, after: calls.append(run) or real(run, after))
        docs = spark.createDataFrame([(i, f"word{i} " * 50, "a", "b") for i in range(300)], "doc_id long, text string, lang string, source string").coalesce(1)
        coded = bpe.decode(bpe.encode(docs, packed=True)).collect()
        mixed = mixing.mixed(docs).collect()
    assert len(calls) == 3 and all(r.decoded.decode() == r.text for r in coded) and len(coded) == 300
    words = {r.doc_id: r.text.split() for r in docs.collect()}
    assert mixed and all(set(r.text.split()) <= set(words[r.doc_id]) for r in mixed)


def test_operators_as_row_by_row(spark):
    df = spark.createDataFrame([(i, f"{i}.html", p) for i, p in enumerate(PAGES)], "k int, name string, html string").coalesce(1)
    got = {r.k: r.n for r in markup.nodes(df, "html", "k").groupBy("k").count().withColumnRenamed("count", "n").collect()}
    assert got == {i: n for i, p in enumerate(PAGES) if (n := len(markup.Elements(p or "").rows))}
    got = {r.k: r.n for r in blocks.of_pages(df, "k").groupBy("k").count().withColumnRenamed("count", "n").collect()}
    assert got == {i: n for i, p in enumerate(PAGES) if (n := len(blocks.Reader(p or "").rows))}
    parts = {(r.k, r.part): r.content for r in splits.split_pages(df, 1024, "k", least=1000).collect()}
    want = {(i, n): "".join(x) for i, p in enumerate(PAGES) if p is not None for n, x in enumerate([("", p, "")] if len(p) <= 1024 else splits.Page(p, 1024).parts(1024), 1)}
    assert parts == want
    texts = {(r.k, r.part): r.body for r in packing.split_texts(df, 1024, text="html", least=1000).collect()}
    assert texts == {(i, n): t for i, p in enumerate(PAGES) for n, t in enumerate(packing.cut_text(p or "", 1024), 1)}
