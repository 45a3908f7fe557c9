import pytest
from pyspark.sql import functions as F

from vellum.operators import service, structure, translate


def test_runs_are_cut_by_tabs_and_breaks(spark):
    rows = [(1, 0, "text", "a"), (1, 1, "text", "b"), (1, 2, "tab", None), (1, 3, "text", "c"), (1, 4, "br", None), (1, 5, "br", None), (1, 6, "text", "d"), (2, 0, "text", "e")]
    got = structure.runs(spark.createDataFrame(rows, "p int, n int, kind string, text string"), ["p"], "n").orderBy("p", "run").collect()
    assert [(r.p, r.body) for r in got] == [(1, "ab"), (1, "c"), (1, "d"), (2, "e")]


def test_table_rows_and_image_names(spark):
    assert spark.range(1).select(structure.flat_row(F.array(F.lit(" a  b "), F.lit(""), F.lit("c")))).first()[0] == "a b  |  c"
    uses = spark.createDataFrame([("d", 1, "x.png"), ("d", 2, "gone.png")], "doc string, pos int, src string")
    images = spark.createDataFrame([("d", "x.png", "img_0001.png")], "doc string, src string, name string")
    assert [(r.pos, r.src) for r in structure.rewritten(uses, images, "doc").collect()] == [(1, "images/img_0001.png")]


def test_health(spark):
    row = service.health(spark.createDataFrame([(3, True), (4, False)], "strings long, served boolean"), "local", 7).first()
    assert (row.status, row.requests, row.strings, row.errors, row.max_items) == ("ok", 2, 7, 1, 400)


class Scripted:
    """Raises or returns what it is told, and counts its calls."""

    def __init__(self, *acts):
        self.acts, self.calls = list(acts), 0

    def translate(self, texts):
        self.calls += 1
        act = self.acts.pop(0) if self.acts else texts
        if isinstance(act, Exception):
            raise act
        return act


def test_second_provider_takes_over_and_rests():
    bad = lambda n: Scripted(*[translate.Failed("no")] * n)
    second = Scripted(translate.Failed("once"), ["x"])
    assert translate.Fallback(bad(1), second, pause=0).translate(["a"]) == ["x"] and second.calls == 2
    assert translate.Fallback(Scripted(["y"]), second).translate(["a"]) == ["y"] and second.calls == 2
    busy = Scripted(translate.Busy("429"), ["z"])
    both = translate.Fallback(bad(2), busy, pause=0, rest=60)
    for _ in range(2):
        with pytest.raises(translate.Failed):
            both.translate(["a"])
    assert busy.calls == 1
