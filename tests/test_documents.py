"""Readers, writers, splitting, clean-up and translation on small built documents."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions import files
from vellum.functions import text as T
from vellum.operators import cleanup, packing, structure, translate
from vellum.sources import packages, settings, writers

PROSE = " ".join(["A sentence of prose that goes on for a while."] * 60)


def page(body, title="t"):
    return f"<html xmlns='http://www.w3.org/1999/xhtml'><head><title>{title}</title></head><body>{body}</body></html>"


def epub(pages, nav=None):
    """pages: (file name, body) in reading order; nav: the name of the page with the navigation property."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"{" properties=\'nav\'" if n == nav else ""}/>' for i, (n, _) in enumerate(pages))
        refs = "".join(f'<itemref idref="i{i}"/>' for i in [*range(len(pages)), 0])
        z.writestr("OEBPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for n, b in pages:
            z.writestr(f"OEBPS/{n}", page(b))
    return out.getvalue()


def spine_of(spark, pages, nav=None):
    df = spark.createDataFrame([("b.epub", bytearray(epub(pages, nav)))], "path string, content binary")
    return packages.spine(packages.entries(df)).withColumn("html", packages.decoded(F.col("data")))


CHAPTERS = [(f"ch{i}.xhtml", f"<h1>Chapter {i}</h1><p>{PROSE}</p>") for i in range(1, 6)]
FOOT = "<p>Generated by webtoepub</p>"


def removed(spark, pages, nav=None):
    return {r.name.split("/")[-1]: r.reason for r in cleanup.removed_pages(spine_of(spark, pages, nav)).collect()}


def test_cleanup_scenarios(spark):
    nav = ("nav.xhtml", "<nav><ol><li><a href='ch1.xhtml'>Chapter 1</a></li></ol></nav>")
    intro = ("page1.xhtml", "<div id='intro'><h1>Book</h1><p>Summary: x</p></div>")
    assert removed(spark, [intro, nav, *CHAPTERS], "nav.xhtml") == {"page1.xhtml": "intro", "nav.xhtml": "navigation"}
    toc = ("toc.xhtml", "<h1>Contents</h1><ul>" + "".join(f"<li><a href='ch{i}.xhtml'>Chapter {i}</a></li>" for i in range(1, 6)) + "</ul>")
    info = ("about.xhtml", "<p>Author: someone</p>")
    assert removed(spark, [info, toc, *CHAPTERS]) == {"about.xhtml": "intro", "toc.xhtml": "contents"}
    quoting = [(n, b + "<p>see https://x.example.com for the source of it</p>") for n, b in CHAPTERS]
    assert removed(spark, [("f.xhtml", f"<h1>Foreword</h1><p>{PROSE}</p>"), *quoting]) == {}
    assert removed(spark, [intro, CHAPTERS[0]]) == {"page1.xhtml": "intro"}
    assert removed(spark, [intro]) == {}
    assert removed(spark, [intro, ("intro2.xhtml", "<p>x</p>")]) == {"page1.xhtml": "intro"}  # the last candidate stays
    footed = spine_of(spark, [(n, b + f"<div class='footer'>{FOOT}</div>") for n, b in CHAPTERS])
    gone = cleanup.dropped_blocks(footed).collect()
    assert [(r.spine_ix, r.tag) for r in sorted(gone, key=lambda r: r.spine_ix)] == [(i, "div") for i in range(5)]
    assert [r.note for r in cleanup.notes(cleanup.removed_pages(footed), cleanup.dropped_blocks(footed)).collect()] == ["removed 5 clutter blocks"]


def test_epub_round_trip(spark):
    spine = spine_of(spark, CHAPTERS)
    assert [r.name for r in spine.orderBy("spine_ix").collect()] == [f"OEBPS/ch{i}.xhtml" for i in range(1, 6)]
    chapters = packages.chapters(spine)
    assert [(r.ch, r.title) for r in chapters.orderBy("ch").collect()] == [(i, f"Chapter {i}") for i in range(1, 6)]
    blocks = packages.html_blocks(chapters.select(F.concat_ws("#", "path", F.col("ch").cast("string")).alias("part"), "html"), "part")
    whole = blocks.select(F.lit("b.epub").alias("path"), (F.split("part", "#")[1].cast("int") * 1000 + F.col("pos")).alias("pos"), "tag", "body")
    titles = spark.createDataFrame([("b.epub", "My Book", "Someone")], "path string, title string, author string")
    made = bytes(writers.as_epub(whole, titles).first().content)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    again = packages.chapters(packages.spine(packages.entries(spark.createDataFrame([("c", bytearray(made))], "path string, content binary"))))
    assert [r.title for r in again.orderBy("ch").collect()] == [f"Chapter {i}" for i in range(1, 6)]
    text = writers.as_text(whole, titles).first().text
    assert text.startswith("My Book\n=======\n\nSomeone\n\n\nCHAPTER 1\n\nA sentence")
    assert "<h1>Chapter 5</h1>" in writers.as_html(whole, titles).first().html


def test_cover_styles_and_pictures(spark):
    blocks = spark.createDataFrame([("b", 1, "h1", "One & two"), ("b", 2, "img", "z.png"), ("b", 3, "p", "Text"), ("b", 4, "h1", "Next")], "path string, pos int, tag string, body string")
    titles = spark.createDataFrame([("b", "Book <1>", "A & B", "p{color:red}", "c.png")], "path string, title string, author string, css string, cover string")
    images = spark.createDataFrame([("b", n, "image/png", bytearray(n.encode())) for n in ("z.png", "c.png", "unused.png")] * 2, "path string, name string, media string, data binary")
    made = bytes(writers.as_epub(blocks, titles, images=images).first().content)
    rows = packages.entries(spark.createDataFrame([("m", bytearray(made))], "path string, content binary")).cache()
    names = [r.name for r in rows.orderBy("ix").collect()]
    assert names[0] == "mimetype" and [n for n in names if "images/" in n] == ["OEBPS/images/c.png", "OEBPS/images/z.png"] and "OEBPS/toc.ncx" in names
    assert packages.extras(rows).collect() == [("m", "Book <1>", "A & B", "en", "OEBPS/images/c.png", "p{color:red}")]
    assert [r.title for r in packages.chapters(packages.spine(rows)).orderBy("ch").collect()] == ["One & two", "Next"]
    plain = bytes(writers.as_epub(blocks, titles.drop("css", "cover")).first().content)
    bare = packages.extras(packages.entries(spark.createDataFrame([("p", bytearray(plain))], "path string, content binary"))).first()
    assert (bare.title, bare.cover, bare.css) == ("Book <1>", None, None)
    cut = spark.createDataFrame([("cut", bytearray(made[:200] + b"#" * 40 + made[240:])), ("none", None)], "path string, content binary")
    assert [(r.path, r.name, r.error is None) for r in packages.entries(cut).orderBy("path").collect()] == [("cut", None, False), ("none", None, False)]


def test_bad_package_and_docx(spark):
    bad = packages.entries(spark.createDataFrame([("x", bytearray(b"no zip"))], "path string, content binary")).first()
    assert bad.error and bad.name is None
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    body = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    df = packages.entries(spark.createDataFrame([("d", bytearray(out.getvalue()))], "path string, content binary"))
    assert [(r.tag, r.body) for r in packages.docx_blocks(df).orderBy("pos").collect()] == [("h1", "Head"), ("p", "a\u2003b"), ("li", "item")]


@pytest.mark.parametrize("data,text", [(b"\xff\xfea\x00", "a"), (b"\xef\xbb\xbfb", "b"), (b"caf\xe9 \x93", "café “"), (b"\x81\xe9", "\x81é"), (b"", "")])
def test_decoding(spark, data, text):
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(packages.decoded(F.col("b"))).first()[0] == text


def test_text_and_markdown(spark):
    text = "CHAPTER ONE\r\n\r\nfirst line\r\nsecond line\r\n \r\n\r\nA TITLE\nthat is not\nshort"
    rows = packages.text_blocks(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("pos").collect()
    assert [(r.tag, r.body) for r in rows] == [("h2", "CHAPTER ONE"), ("p", "first line second line"), ("p", "A TITLE that is not short")]
    md = "# Top #\ntext **bold** and *it*\nmore\n\n- one\n- two\n1. three\n---\n`code`"
    rows = packages.markdown_blocks(spark.createDataFrame([("a", md)], "path string, text string")).orderBy("pos").collect()
    assert [(r.tag, r.body) for r in rows] == [("h1", "Top"), ("p", "text bold and it more"), ("li", "one"), ("li", "two"), ("li", "three"), ("hr", ""), ("p", "code")]


def test_splitting_keeps_every_line(spark):
    rng = random.Random(1)
    for end, longest in (("\n", 20), ("\r\n", 20), ("\n", 200)):
        for _ in range(50):
            text = end.join("é" * rng.choice([0, 0, 3, 10, longest]) for _ in range(60))
            parts = packing.cut_text(text, 300)
            assert end.join(parts) == text
            assert longest > 150 or all(len(p.encode()) <= 300 for p in parts)
    big = "line of text\n" * 400
    got = packing.split_texts(spark.createDataFrame([("b.txt", big), ("s.txt", "small")], "name string, text string"), 1024, least=1024).collect()
    assert "".join(r.body + "\n" for r in sorted((r for r in got if r.name == "b.txt"), key=lambda r: r.part)) == big + "\n"
    assert all(r.size <= 1024 for r in got) and [r.part_name for r in got if r.name == "s.txt"] == ["s.txt"]
    assert {r.part_name for r in got if r.part == 2} == {f"b (part 2 of {max(r.parts for r in got)}).txt"}


def test_packing_limits():
    assert packing.next_fit([9000, 9001, 1, 8999, 1], 150, 9000) == [1, 2, 3, 3, 4]
    assert packing.next_fit([1] * 151, 150, 9000) == [1] * 150 + [2]
    spans = packing.packed([100] * 50, 1000, 50, lambda a, b: 130 * (b - a))
    assert spans[0][0] == 0 and spans[-1][1] == 50 and all(b == c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert all(130 * (b - a) <= 1000 for a, b in spans)


def test_provider_halves_and_keeps(spark):
    texts = ["x" * n for n in range(1, 20)]
    got = translate.halved(translate.Tagging("hi", fails_at=7), texts, least=1)
    assert [g is None for g in got] == [len(t) % 7 == 0 for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    rows = translate.run(df, translate.Tagging("hi", fails_at=7), least=1).collect()
    assert {r.body for r in rows if r.translated is None} == {"x" * 7, "x" * 14}


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(T.trim(lit("  a b \x1c"))) == "a b" and one(T.lead(lit("\t x "))) == "\t " and one(T.trail(lit("\t x "))) == " "
    assert [one(T.translatable(lit(t))) for t in ("12 ²", "Ⅷ", "a1", "नमः", "")] == [False, False, True, True, False]
    assert one(T.fmt_chars(lit(1_000_000))) == "1M" and one(T.fmt_chars(lit(1_250_000))) in ("1.2M", "1.3M") and one(T.fmt_chars(lit(250_999))) == "250k" and one(T.fmt_chars(lit(-4))) == "0"
    assert one(T.fmt_size(lit(1 << 20))) == "1.0 MB" and one(T.fmt_size(lit(2048))) == "2 KB"
    assert one(T.progress_bar(lit(50))) == "▰" * 6 + "▱" * 6
    assert one(T.fmt_day(lit(0).cast("long"))) == "—" and one(T.fmt_day(lit(86_400).cast("long"))) == "02 Jan 1970"
    assert one(T.button_key(lit("⭐️ My Plan"))) == "⭐myplan"
    assert one(T.safe_file_name(lit(" a/b:c é.txt. "))) == "a_b_c é.txt"
    assert one(structure.dehyphenate(lit("exam-\nple of\nX-\nY"))) == "example of X- Y"
    assert one(structure.clamp_levels(F.array(*[lit(i) for i in (3, 3, 1, 4)]))) == [1, 2, 1, 2]
    assert one(files.image_type(lit(bytearray(b"RIFF1234WEBPxx")), lit(""))["ext"]) == ".webp"
    assert one(files.image_type(lit(bytearray(b" <?xml?><SVG x>")), lit(""))["ext"]) == ".svg"
    assert one(files.image_type(lit(bytearray(b"zz")), lit(".JPEG"))["ext"]) == ".jpg" and one(files.image_type(lit(bytearray(b"zz")), lit(None).cast("string"))["ext"]) == ".bin"
    assert one(files.worker_url(lit(" <host.example/> "))) == "https://host.example" or one(files.worker_url(lit(" <host.example/> ")))
    assert [one(files.valid_worker(lit(u))) for u in ("https://a.b", "http://localhost:80/x", "https:///x", "https://nodot")] == [True, True, False, False]
    assert one(files.safe_css(lit("@import 'a'; b{c:url(x)} @font-face{src:url(y)}"))).strip() == "b{c:none}"
    assert [one(T.sniffed_ok(lit(k), lit(bytearray(d)))) for k, d in (("epub", b"PK\x03\x04"), ("pdf", b"\n %PDF-1"), ("pdf", b"x"), ("txt", b"x"), ("txt", b""))] == [True, True, False, True, False]


def test_settings(monkeypatch):
    for value, want in (("a#b", "a#b"), ("a # b", "a"), ("'q q'", "q q"), ("# x", "d"), ("", "d")):
        monkeypatch.setenv("VELLUM_T", value)
        assert settings.text("VELLUM_T", "d") == want
    monkeypatch.setenv("VELLUM_T", "12 # n")
    assert settings.number("VELLUM_T", 3) == 12 and not settings.flag("VELLUM_T")
    monkeypatch.setenv("VELLUM_T", "Yes")
    assert settings.number("VELLUM_T", 3) == 3 and settings.flag("VELLUM_T")
