"""Files changed in place, packages after clean-up, conversions, plain markup and splits, on small built documents."""

import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from test_documents import CHAPTERS, FOOT, PROSE, epub, page, spine_of
from vellum.operators import cleanup, markup, packing, structure, translate
from vellum.sources import packages, rewrite

TAG = translate.Tagging("hi")


def names_of(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        return {i.filename: z.read(i).decode() for i in z.infolist()}


def test_texts_keep_their_white_space_and_line_ends(spark):
    rows = [("a", " one \r\n\r\n12\r\n\ttwo"), ("b", "three\nfour\n"), ("c", ""), ("d", "1\n2")]
    got = dict(rewrite.translated_texts(spark.createDataFrame(rows, "path string, text string"), TAG).collect())
    assert got == {"a": " [hi] one \r\n\r\n12\r\n\t[hi] two", "b": "[hi] three\n[hi] four\n", "c": "", "d": "1\n2"}


PAGE = """<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html><head><title>T</title><style>p{}</style></head>
<body><!-- kept --><p class='x'> one &amp; two<br/>3 &lt; 4 </p><p>12</p><script>var a = "<p>no</p>";</script>a < b</body></html>"""


def test_pages_keep_all_markup(spark):
    df = spark.createDataFrame([("a", PAGE, 7), ("b", None, 8), ("c", "", 9)], "path string, html string, n int")
    got = {r.path: (r.html, r.n) for r in rewrite.translated_pages(df, TAG).collect()}
    want = PAGE.replace("one &amp; two", "[hi] one &amp; two").replace("a < b", "[hi] a &lt; [hi] b")
    assert got["a"][1] == 7 and got["a"][0].replace("[hi] a < [hi] b", "[hi] a &lt; [hi] b") == want
    assert got["b"] == (None, 8) and got["c"] == ("", 9)


@pytest.mark.parametrize("seed", range(30))
def test_replacing_texts_by_themselves_changes_nothing(seed):
    rng = random.Random(seed)
    made = "".join(rng.choice(["<p>", "</p>", "<b a='>'>", "text", " ", "\n", "<br/>", "<!-- c -->", "<script>x<y</script>", "ü", "a<3"]) for _ in range(60))
    texts = markup._parsed(made).found
    if "<" not in "".join(texts):
        assert markup.with_texts(made, list(texts)) == made
    assert markup.with_texts(made, [None] * len(texts)) == made


def test_books_are_translated_in_place(spark):
    data = epub(CHAPTERS)
    df = spark.createDataFrame([("b.epub", bytearray(data))], "path string, content binary")
    old, new = names_of(data), names_of(bytes(rewrite.translated_books(df, TAG).first().content))
    assert list(new) == list(old) and new["OEBPS/content.opf"] == old["OEBPS/content.opf"] and new["mimetype"] == old["mimetype"]
    assert new["OEBPS/ch2.xhtml"] == old["OEBPS/ch2.xhtml"].replace("Chapter 2", "[hi] Chapter 2").replace(PROSE, f"[hi] {PROSE}")


def with_lists(pages, nav=None, ncx=()):
    """An EPUB with an NCX list beside the navigation page; its package file has a prolog and a comment."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(epub(pages, nav))) as z, zipfile.ZipFile(out, "w") as w:
        for i in z.infolist():
            data = z.read(i).decode()
            if i.filename.endswith(".opf"):
                data = '<?xml version="1.0"?>\n<!-- c -->' + data
            w.writestr(i, data)
        points = "".join(f'<navPoint id="n{i}"><navLabel><text>{n}</text></navLabel><content src="{n}"/></navPoint>' for i, n in enumerate(ncx))
        w.writestr("OEBPS/toc.ncx", f"<?xml version='1.0'?><ncx><navMap>{points}</navMap></ncx>")
    return out.getvalue()


def cleaned(spark, data):
    row = rewrite.cleaned_books(spark.createDataFrame([("b.epub", bytearray(data))], "path string, content binary")).first()
    return bytes(row.content), row.notes


INTRO = ("page1.xhtml", "<div id='intro'><h1>Book</h1><p>Summary: x</p></div>")
NAV = ("nav.xhtml", "<nav><ol><li><a href='page1.xhtml'>Intro</a></li><li><a href='ch1.xhtml#a'>Chapter 1</a></li></ol></nav>")


def test_removed_pages_leave_the_package(spark):
    data = with_lists([INTRO, *CHAPTERS], None, ["page1.xhtml", "ch1.xhtml"])
    got, notes = cleaned(spark, data)
    new = names_of(got)
    assert notes == ["removed 1 extra page"] and "OEBPS/page1.xhtml" not in new and len(new) == len(names_of(data)) - 1
    opf = new["OEBPS/content.opf"]
    assert opf.startswith('<?xml version="1.0"?>\n<!-- c -->') and "page1" not in opf and 'idref="i0"' not in opf and opf.count("<itemref") == 5
    assert "page1" not in new["OEBPS/toc.ncx"] and 'src="ch1.xhtml"' in new["OEBPS/toc.ncx"] and new["OEBPS/toc.ncx"].count("<navPoint") == 1
    assert [r.name for r in packages.spine(packages.entries(spark.createDataFrame([("c", bytearray(got))], "path string, content binary"))).orderBy("spine_ix").collect()] == [f"OEBPS/ch{i}.xhtml" for i in range(1, 6)]


def test_navigation_lists_are_pruned(spark):
    """The navigation page itself leaves by its property; without it the list stays, less its dead entries."""
    got, notes = cleaned(spark, with_lists([INTRO, NAV, *CHAPTERS], "nav.xhtml"))
    assert notes == ["removed 2 extra pages"] and "OEBPS/nav.xhtml" not in names_of(got)
    late = with_lists([INTRO, *CHAPTERS, ("last.xhtml", f"<h1>Chapter 6</h1><p>{PROSE}</p>{NAV[1]}")])
    last = names_of(cleaned(spark, late)[0])["OEBPS/last.xhtml"]
    assert "page1.xhtml" not in last and "<li><a href='ch1.xhtml#a'>Chapter 1</a></li>" in last


def test_marked_blocks_are_cut_out(spark):
    footed = [(n, b + f"<div class='footer'>{FOOT}</div><!-- end -->") for n, b in CHAPTERS]
    got, notes = cleaned(spark, with_lists(footed))
    assert notes == ["removed 5 clutter blocks"]
    new = names_of(got)
    assert all(new[f"OEBPS/{n}"] == page(b + "<!-- end -->") for n, b in CHAPTERS)


@pytest.mark.parametrize("pages", [CHAPTERS, [INTRO], [("f.xhtml", f"<h1>Foreword</h1><p>{PROSE}</p>"), *CHAPTERS]])
def test_books_without_extras_keep_their_bytes(spark, pages):
    data = with_lists(pages)
    assert cleaned(spark, data) == (data, [])


def test_page_of_many_elements_takes_linear_time(spark):
    pages = spine_of(spark, [("a.xhtml", "".join(f"<p>paragraph <b>{i}</b></p>" for i in range(20_000))), CHAPTERS[0]])
    began = time.time()
    facts = {r.name: r for r in cleanup.page_facts(pages).collect()}
    assert time.time() - began < 40 and facts["OEBPS/a.xhtml"].n_lines == 20_000


def test_conversion(spark):
    rows = [("x/a.txt", "a.txt", ".txt", "txt", b"CHAPTER ONE\n\nsome text"), ("x/b.epub", "b.epub", ".epub", "epub", epub(CHAPTERS)), ("x/c.html", "c.html", ".html", "html", b"<h1>T</h1><p>x &amp; y</p>"), ("x/d.md", "d.md", ".md", "txt", b"# Top\n\n- one"), ("x/e.bin", "e.bin", None, None, b"?")]
    df = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "path string, name string, ext string, kind string, content binary")
    text = {r.path: (r.name, r.content) for r in rewrite.convert(df, ".txt").collect()}
    assert text["x/a.txt"] == ("a.txt", rows[0][4]) and text["x/d.md"] == ("d.md", rows[3][4])  # of one kind: the same bytes
    assert text["x/c.html"][0] == "c.txt" and b"x & y" in text["x/c.html"][1] and b"CHAPTER 5" in text["x/b.epub"][1] and text["x/e.bin"][1] is None
    pages = {r.path: r.content for r in rewrite.convert(df, ".html").collect()}
    assert b"<h2>CHAPTER ONE</h2>" in pages["x/a.txt"] and bytes(pages["x/c.html"]) == rows[2][4]
    books = {r.path: r.content for r in rewrite.convert(df, ".epub").collect()}
    assert bytes(books["x/b.epub"]) == rows[1][4] and "OEBPS/ch1.xhtml" in names_of(bytes(books["x/a.txt"]))


@pytest.mark.parametrize(
    "data,text",
    [
        ("<meta charset='windows-1251'>ж".encode("cp1251"), "<meta charset='windows-1251'>ж"),
        ("<?xml version='1.0' encoding=\"iso-8859-15\"?>€".encode("iso-8859-15"), "<?xml version='1.0' encoding=\"iso-8859-15\"?>€"),
        ("<meta charset=nosuch>é".encode(), "<meta charset=nosuch>é"),
        (b"<p>\x93", "<p>“"),
        (b"\xef\xbb\xbf<meta charset=utf-8>", "<meta charset=utf-8>"),
        (b"", ""),
    ],
)
def test_declared_encodings(data, text):
    assert packages.decode_markup(data) == text


def test_plain_markup(spark):
    made = """<x:DIV onclick=a class=c><!-- no --><script>no</script>tail <A HREF="#in">in</A> <a href="https://o.example/">out</a><img src="a.png" alt="A" width=3><img src=b.png>
<svg><g><image xlink:href="a.png"/></g>no</svg><form>no</form><p>open</x:DIV>"""
    df = spark.createDataFrame([(made, ["a.png"]), (None, None)], "html string, kept array<string>")
    got = [r[0] for r in df.select(markup.cleaned(F.col("html"), F.col("kept"))).collect()]
    assert got[1] is None
    assert got[0] == '<div class="c">tail in <a href="https://o.example/">out</a><img src="a.png" alt="A"/>\n<img src="a.png"/><p>open</p></div>'
    assert df.where("html IS NOT NULL").select(markup.cleaned(F.col("html"))).first()[0].count("<img") == 3
    assert spark.range(1).select(rewrite.text_only(F.lit("a<img src='x'>b<image/>c"))).first()[0] == "abc"


def test_text_parts_fit(spark):
    rng = random.Random(2)
    for _ in range(200):
        text = "\n".join("x" * rng.choice([0, 0, 5, 20, 60]) for _ in range(rng.randrange(1, 50)))
        parts = packing.cut_text(text, 64)
        assert "\n".join(parts) == text and all(len(p) + 1 <= 64 for p in parts)
    assert packing.cut_text("a\nb\n\nc\nd", 6) == ["a\nb\n", "c\nd"] and packing.cut_text("", 7) == [""]
    row = packing.split_texts(spark.createDataFrame([("a.txt", "y" * 50 + "\n" + "z")], "name string, text string"), 20, least=1).first()
    assert row.error == "no part can be smaller than 50 bytes" and row.parts == 2


def test_block_and_chapter_parts(spark):
    blocks = [("a", i, "x" * (10 + i % 7)) for i in range(60)] + [("b", 0, "y" * 500), ("b", 1, "z")]
    got = packing.split_blocks(spark.createDataFrame(blocks, "path string, pos int, piece string"), 100, 10).collect()
    for key in "ab":
        bodies = [r.body for r in sorted((r for r in got if r.path == key), key=lambda r: r.part)]
        assert "\n".join(bodies) == "\n".join(p for k, _, p in blocks if k == key)
    assert all(r.size + 10 <= 100 and r.error is None for r in got if r.path == "a")
    assert {r.error for r in got if r.path == "b"} == {"no part can be smaller than 510 bytes"}

    chapters = [("b", c, f"T{c}", ["p" * 900] * n, 50) for c, n in ((1, 1), (2, 12), (3, 0), (4, 2))]
    df = spark.createDataFrame(chapters, "path string, ch int, title string, blocks array<string>, media long")
    slices = packing.chapter_slices(df, 9000).orderBy("ch", "k").collect()
    assert [s.title for s in slices] == ["T1", "T2 (1)", "T2 (2)", "T2 (3)", "T2 (4)", "T3", "T4"]
    assert [b for s in slices for b in s.blocks] == [b for c in chapters for b in c[3]]
    assert slices[0].estimate == 900 // 3 + 650 and slices[2].estimate == 2700 // 3 + 600
    parts = packing.split_chapters(df, 9000, css=300, cover=1000).orderBy("ch", "k").collect()
    held = {}
    for p in parts:
        held[p.part] = held.get(p.part, 0) + p.estimate + (1000 if (p.ch, p.k) == (1, 1) else 0)
    assert [(p.ch, p.k) for p in parts] == [(s.ch, s.k) for s in slices] and [p.part for p in parts] == sorted(p.part for p in parts)
    assert len(held) == parts[0].parts > 1 and all(n <= 9000 * 9 // 10 - (100 + 4096) for n in held.values())


def test_provider_that_never_answers(spark):
    df = spark.createDataFrame([("a" * 7,), ("b" * 14,)], "body string")
    done = translate.run(df, translate.Tagging("hi", fails_at=7))
    with pytest.raises(Exception, match="no text could be translated"):
        translate.complete(done).collect()
    assert translate.complete(translate.run(df, TAG)).count() == 2 and translate.complete(done.limit(0)).count() == 0


def test_groups_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), (None, 3, True), (None, 4, False)], "k string, n int, gone boolean")
    assert {r.n: r.gone for r in structure.keep_last(df, ["k"], "n", "gone").collect()} == {1: True, 2: False, 3: True, 4: False}
    assert structure.medians(df, "k", "n").orderBy("k").collect() == [(None, 3.5, 4), ("a", 1.5, 2)]
