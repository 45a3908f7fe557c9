"""Reports of provider calls, versioned logs, shared tables, outputs and reasons."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vellum import shared
from vellum.functions import files, text
from vellum.operators import accounts, structure, translate
from vellum.sources import logs


def fake(replies):
    """Stands for the network: replies by endpoint."""

    def send(url, body, headers, timeout):
        texts = json.loads(body)["text_list"]
        kind = replies[url.removesuffix("/translate")]
        if kind == "network":
            raise OSError("no route")
        if isinstance(kind, int):
            return kind, b""
        found = {"ok": [f"<{t}" for t in texts], "length": texts[:-1], "reply": None}[kind]
        return 200, json.dumps({"success": True, "translated": found}).encode()

    return send


def test_calls_are_reported(spark):
    replies = {"https://a": 401, "https://b": "length", "https://c": "network", "https://d": 429, "https://e": "reply", "https://f": 500, "https://g": "ok"}
    provider = translate.Http(list(replies), "hi", attempts=9, pause=0, send=fake(replies))
    texts = spark.createDataFrame([(f"t{i}", i) for i in range(30)], "body string, n int").coalesce(1)
    done = translate.reported(texts, provider, items=10).cache()
    assert {r.body: r.translated for r in done.collect()} == {f"t{i}": f"<t{i}" for i in range(30)}
    report = {r.endpoint[-1]: r for r in translate.health(translate.attempts(done)).collect()}
    assert {e: r.calls for e, r in report.items()} == dict.fromkeys("abcdefg", 3)
    for endpoint, code in zip("abcdef", ("secret", "length", "network", "busy", "reply", "status")):
        r = report[endpoint]
        assert r[code] == 3 and r.fails == r.longest == 3 and r.latency is None
    assert report["g"].fails == 0 and report["g"].latency >= 0
    with pytest.raises(translate.Busy):
        translate.Http(["https://d"], "hi", pause=0, send=fake(replies)).translate(["x"])
    with pytest.raises(translate.Failed):
        translate.finished(texts, translate.Http(["https://a"], "hi", pause=0, send=fake(replies)))
    assert translate.finished(texts.limit(0), translate.Http(["https://a"], "hi", pause=0, send=fake(replies))).count() == 0


def test_logs_grow_and_are_compacted(spark, tmp_path):
    at, to = f"file://{tmp_path}/log", f"file://{tmp_path}/small"
    with pytest.raises(ValueError):
        logs.read(spark, at)
    logs.append(spark.createDataFrame([(1, 1), (2, 2)], "id long, seq long"), at, 1)
    logs.append(spark.createDataFrame([(1, 3, "x"), (3, 4, None)], "id long, seq long, lang string"), at, 2)
    logs.append(spark.createDataFrame([(2, 5, "y", True), (4, 6, "z", False)], "id long, seq long, lang string, gone boolean"), at, 3)
    whole = logs.read(spark, at, {"lang": "en", "gone": False})
    assert sorted(map(tuple, whole.collect())) == [(1, 1, "en", False), (1, 3, "x", False), (2, 2, "en", False), (2, 5, "y", True), (3, 4, None, False), (4, 6, "z", False)]
    for _ in range(2):  # a second run gives the same
        logs.compact(spark, at, to, "id", "seq", deleted="gone", defaults={"lang": "en", "gone": False})
        assert sorted(map(tuple, logs.read(spark, to).collect())) == [(1, 3, "x", False), (3, 4, None, False), (4, 6, "z", False)]
        assert logs.versions(spark, to) == [3]
    logs.append(spark.createDataFrame([(9, "seven")], "id long, seq string"), at, 4)
    with pytest.raises(ValueError, match="seq was bigint"):
        logs.read(spark, at)


def test_shared_tables_go_with_their_scope(spark):
    with shared.scope(spark):
        table = shared.written(spark.range(5))
        at = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 5 and os.path.exists(at)
    assert not os.path.exists(at)
    kept = shared.written(spark.range(3))
    assert os.path.exists(kept.inputFiles()[0].removeprefix("file://"))


def test_reasons_and_outputs(spark):
    rows = [(".zip", "sub", 1, False, True), (".epub", "blocked", 1, False, True), (".epub", "sub", 200 << 20, True, True), (".epub", "sub", (200 << 20) + 1, True, True), (".txt", "sub", 5, False, False), (".md", "sub", 5, False, True), (None, "sub", 5, False, True)]
    df = spark.createDataFrame(rows, "ext string, source string, size long, busy boolean, up boolean")
    got = [r[0] for r in df.select(accounts.file_reason(F.col("ext"), F.col("source"), F.col("size"), F.lit(200), F.col("busy"), F.col("up"))).collect()]
    assert got == ["unsupported", "blocked", "busy", "plan_limit", "offline", None, "unsupported"]
    assert files.outputs() == [".epub", ".docx", ".txt", ".html"]
    big = df.limit(1).select(accounts.file_reason(F.lit(".epub"), F.lit("admin"), F.lit(3000 << 20), F.lit(9000), F.lit(False), F.lit(True)), accounts.file_reason(F.lit(".epub"), F.lit("admin"), F.lit(1), F.lit(1), F.lit(False), F.lit(True), out=F.lit(".pdf")))
    assert tuple(big.first()) == ("service_limit", "unavailable")


def test_entries_that_are_pages(spark):
    rows = [("O/a.XHTML", b"x"), ("O/b.xml", b"<page-map/>"), ("O/c.xml", b"<?xml?><HTML>"), ("META-INF/container.xml", b"<html"), ("META-INF/x.html", b""), ("t.ncx", b"<html"), ("o.opf", b""), ("d/", b""), ("p.png", b"")]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "name string, data binary")
    assert [r.name for r in df.where(files.page_entry(F.col("name"), F.col("data"))).collect()] == ["O/a.XHTML", "O/c.xml"]
    one = spark.range(1).select(text.unescaped(F.lit("a &amp; b &#x27;")), text.chunked(F.array(*[F.lit(i) for i in range(5)]), 2), text.chunked(F.array().cast("array<int>"), 2), files.output_label(F.lit(None).cast("string"), F.lit(""))).first()
    assert tuple(one) == ("a & b '", [[0, 1], [2, 3], [4]], [], "same as input")


def test_groups_inside_a_row(spark):
    rows = [([False, True, False, True], [False, True, True, True]), ([True, True], [True, False]), ([], []), (None, None), ([True, True, True], [False, False, True])]
    got = spark.createDataFrame(rows, "e array<boolean>, c array<boolean>").select(structure.spans_at(F.col("e"), F.col("c"))).collect()
    spans = [[(s.group, s.start, s.n) for s in r[0]] for r in got]
    assert spans == [[(1, 0, 3), (2, 3, 1)], [(1, 0, 1), (2, 1, 1)], [], [], [(1, 0, 3)]]
