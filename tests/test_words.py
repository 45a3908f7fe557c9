"""Word packages: written from blocks, translated in place and split, read back each time."""

import io
import random
import zipfile

import pytest

from vellum.operators import translate
from vellum.sources import packages, rewrite, words, writers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="urn:mc" mc:Ignorable="w14" xmlns:w14="urn:w14"'
IMAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
TAG = translate.Tagging("hi")


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def parts_of(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        return {n: z.read(n) for n in z.namelist()}


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, name string, content binary")


def test_blocks_read_back(spark):
    blocks = [("a", 0, "h1", "One & two"), ("a", 1, "p", "x < y\x01 “ü”"), ("a", 2, "li", "item"), ("a", 3, "hr", None), ("a", 4, "h3", "Deep")]
    titles = [("a", "T", None), ("b", "Only", "Me")]
    made = writers.as_word(spark.createDataFrame(blocks, "path string, pos int, tag string, body string"), spark.createDataFrame(titles, "path string, title string, author string"))
    back = packages.docx_blocks(packages.entries(made)).orderBy("path", "pos").collect()
    want = [("h1", "T"), ("h1", "One & two"), ("p", "x < y “ü”"), ("li", "item"), ("p", "* * *"), ("h3", "Deep"), ("h1", "Only"), ("p", "Me")]
    assert [(r.tag, r.body) for r in back] == want


def test_texts_change_in_place(spark):
    run = lambda t, a="": f"<w:r><w:rPr><w:b/></w:rPr><w:t{a}>{t}</w:t></w:r>"
    document = f"""<?xml version="1.0"?><w:document {W}><w:body><!-- kept --><w:p>{run("Hel")}{run("lo &amp; ")}<w:r><w:tab/></w:r>{run("12")}</w:p>
<w:p>{run(" outer ", ' xml:space="preserve"')}<w:r><w:txbxContent><w:p>{run("inner")}</w:p></w:txbxContent></w:r>{run("end")}</w:p><w:p><w:r><w:t/></w:r></w:p></w:body></w:document>"""
    source = package({words.MAIN: document, "word/header1.xml": f"<w:hdr {W}><w:p>{run('top')}</w:p></w:hdr>", "word/styles.xml": "<a>no</a>"})
    rows = [("a", "a.docx", source), ("b", "b.docx", b"no zip"), ("c", "c.docx", None), ("d", "d.docx", package({words.MAIN: "<broken>"}))]
    got = {r.path: r.content for r in words.translated_words(table(spark, rows), TAG).collect()}
    want = document.replace("<w:t>Hel<", '<w:t xml:space="preserve">[hi] Hello &amp; <').replace("<w:t>lo &amp; <", "<w:t><").replace("> outer <", "> [hi] outer end<").replace("<w:t>end<", "<w:t><").replace("<w:t>inner<", '<w:t xml:space="preserve">[hi] inner<')
    found = parts_of(got["a"])
    assert found[words.MAIN].decode() == want
    assert b"[hi] top" in found["word/header1.xml"] and found["word/styles.xml"] == b"<a>no</a>"
    assert (got["b"], got["c"], got["d"]) == (b"no zip", None, rows[3][2])


def test_parts_hold_all_blocks_in_order_and_their_own_pictures(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    bodies = [f"{i} {text(300)}" for i in range(60)]
    picture = lambda i: f'<w:p><w:r><a:blip xmlns:a="urn:a" r:embed="rId{i}"/></w:r></w:p>'
    blocks = "".join(f"<w:p><w:r><w:t>{b}</w:t></w:r></w:p>" + (picture(i // 20) if i % 20 == 10 else "") for i, b in enumerate(bodies))
    links = "".join(f'<Relationship Id="rId{i}" Type="{IMAGE}" Target="media/{i}.png"/>' for i in range(4)) + '<Relationship Id="rId9" Type="x/styles" Target="styles.xml"/>'
    head = f'<Relationships xmlns="urn:p"><Relationship Id="rId1" Type="{IMAGE}" Target="/word/media/3.png"/></Relationships>'
    media = {f"word/media/{i}.png": r.randbytes(1500) for i in range(4)}
    source = package({words.MAIN: f"<w:document {W}><w:body>{blocks}<w:sectPr/></w:body></w:document>", words.LINKS: f'<Relationships xmlns="urn:p">{links}</Relationships>', "word/_rels/header1.xml.rels": head, "word/styles.xml": "<s/>", **media})
    huge = package({words.MAIN: f"<w:document {W}><w:body><w:p><w:r><w:t>{text(30000)}</w:t></w:r></w:p><w:p/></w:body></w:document>"})
    rows = [("a", "a.docx", source), ("b", "b.docx", source[:500]), ("c", "c.docx", r.randbytes(9000)), ("d", "d.docx", None), ("e", "e.docx", huge)]
    got = words.split_words(table(spark, rows), 8000, least=1000).orderBy("path", "part").collect()
    a = [x for x in got if x.path == "a"]
    assert len(a) > 2 and all(x.size <= 8000 and x.error is None and x.parts == len(a) for x in a)
    assert a[0].part_name == f"a (part 1 of {len(a)}).docx"
    read = packages.docx_blocks(packages.entries(spark.createDataFrame([(f"{x.part:03}", x.content) for x in a], "path string, content binary"))).orderBy("path", "pos").collect()
    assert [x.body for x in read] == bodies
    for x in a:
        parts = parts_of(x.content)
        main, kept = parts[words.MAIN].decode(), parts[words.LINKS].decode()
        assert main.endswith("<w:sectPr/></w:body></w:document>") and "rId9" in kept and "word/media/3.png" in parts
        for i in range(3):
            assert (f'r:embed="rId{i}"' in main) == (f"word/media/{i}.png" in parts) == (f'Id="rId{i}"' in kept)
    rest = {x.path: x for x in got if x.path != "a"}
    assert rest["b"].content == source[:500] and rest["b"].error is None and rest["c"].parts == 1 and rest["c"].error and "d" not in rest
    assert [x.error is None for x in got if x.path == "e"] == [False, True]


def test_limits_and_conversion(spark):
    with pytest.raises(ValueError):
        words.split_words(table(spark, []), 10)
    assert words.split_words(table(spark, []), 1 << 20).count() == 0
    files = spark.createDataFrame([("a", "a.txt", ".txt", "txt", bytearray(b"CHAPTER 1\n\nBody text.\n"))], "path string, name string, ext string, kind string, content binary")
    row = rewrite.convert(files, ".docx").first()
    assert row.name == "a.docx" and b"Body text." in parts_of(row.content)[words.MAIN]
