import html
import random
import re
import time

import pytest

from vellum.llm import queries, wrapper

SF = "/root/testdata/sf0.01"


def plain_article(page):
    """Extraction for the test tables alone, whose articles have no clutter inside: a split at p and h1."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op8_wrapper(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html), r.page_id
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def soup(rng, i, paragraphs):
    """A site of unnamed divs, with labelled clutter and constant lines in and around the article."""
    text = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"""<html><head><title>x</title><style>p{{}}</style></head><body>
    <div class="site-header"><a href=/>Home</a></div><div>All our <b>topics</b> at a glance, every day</div>
    <div><div><h1>Title {i}</h1>{text}<p>Read more of our stories every morning</p>
    <div class="ad-box">buy {words(rng, 4)}</div><form><p>mail {i}</p><input></form></div>
    <aside>see {words(rng, 9)}</aside></div>
    <div id="comments"><p>first! {words(rng, 30)}</p></div><div class="cookieNotice">We use cookies</div>
    <footer>&copy; {i}</footer><script>"</p>"</script></body></html>"""


def test_template_and_slots_of_a_site_without_named_article():
    rng = random.Random(4)
    articles = [[words(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    found = wrapper.extract_group([soup(rng, i, a) for i, a in enumerate(articles)])
    for i, (got, paragraphs) in enumerate(zip(found, articles)):
        assert got.split("\n") == [f"Title {i}", *paragraphs]


def test_copies_of_one_page_keep_their_text():
    rng = random.Random(5)
    page = soup(rng, 1, ["a paragraph of the article that is long enough to be the main one"])
    assert len(set(wrapper.extract_group([page] * 20))) == 1
    assert "a paragraph of the article" in wrapper.extract_group([page] * 20)[0]


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("no markup &amp; more", "no markup & more"),
        ("<p>one<p>two <i>x</i>y\n z", "one\ntwo xy z"),
        ("<article><h1>T</h1><b>bold<p>a<br>b</article><nav>m</nav>", "T\nbold\na b"),
        ("<body><ul><li>a<li>b</ul><!-- no --><p>c&nbsp;d &lt;e&gt; &#233;", "a\nb\nc d <e> é"),
        ("<article><p>x<script>var a='</p><p>no';</script>y</p><div class=advert>no</div></article><p hidden>no</p>", "xy"),
        ("<article><p>x</p><p hidden>the contract names what goes, and not this</p></article>", "x\nthe contract names what goes, and not this"),
        ("<main><article><header><h1>t</h1></header><p>a</p><footer>no</footer></article></main>", "t\na"),
        ("<div class=page-header>no</div><article><div class='entry-header'><h1>t</h1></div><p>a</p></article><article class=comment><p>no</article>", "t\na"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>a < b and <3 <p class='x>y", "a < b and <3 <p class='x>y"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_single_pages(page, text):
    assert wrapper.extract_group([page]) == [text]


def test_simple_tree_matching():
    a, b = (wrapper.skeleton(wrapper.parse(t)) for t in ("<div><p>1</p><ul><li>x</li></ul><p>2</p></div><p>z</p>", "<div><ul><li>y</li><li>w</li></ul><p>2</p></div><h1>q</h1>"))
    pairs = wrapper.match(a, b)
    assert len(pairs) == 5  # root, div, ul, its run of li, and the p after it
    assert sorted(s.sign.strip() for s in pairs.values()) == ["div", "li", "p", "root", "ul"]


def test_two_deep_pages_of_one_host():
    pages = ["<div>" * 3000 + f"deep {i}" + "</div>" * 3000 for i in range(2)]
    assert wrapper.extract_group(pages) == ["deep 0", "deep 1"]


def plain_matching(a, b):
    """Size of the largest simple tree matching, by the recursive definition."""
    if a.sign != b.sign:
        return 0
    rows = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, p in enumerate(a.kids):
        for j, q in enumerate(b.kids):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + plain_matching(p, q))
    return 1 + rows[-1][-1]


def random_tree(rng, depth):
    slot = wrapper.Slot(rng.choice("ab") if depth < 4 else "a", [], False)
    if depth:
        slot.kids = [random_tree(rng, depth - 1) for _ in range(rng.randrange(5))]
    return slot


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_the_largest(seed):
    rng = random.Random(seed)
    a, b = (random_tree(rng, 4) for _ in range(2))
    found = wrapper.match(a, b)
    assert len(found) == plain_matching(a, b)
    parents = {id(k): s for t in (a, b) for s in wrapper._slots(t) for k in s.kids}
    places = {id(k): i for t in (a, b) for s in wrapper._slots(t) for i, k in enumerate(s.kids)}
    for y in wrapper._slots(b):
        if id(y) in found:
            assert found[id(y)].sign == y.sign
            if y is not b:
                assert found[id(parents[id(y)])] is parents[id(found[id(y)])]
            taken = [places[id(found[id(k)])] for k in y.kids if id(k) in found]
            assert taken == sorted(set(taken))


def test_long_lists_of_children():
    rng = random.Random(3)
    a, b = (wrapper.skeleton(wrapper.parse("".join(f"<{t}>{i}</{t}>" for i, t in enumerate(rng.choices(("p", "h2", "pre"), k=4000))))) for _ in range(2))
    began = time.time()
    found = wrapper.match(a, b)
    assert time.time() - began < 20
    x, y = [k.sign for k in a.kids], [k.sign for k in b.kids]
    row = [0] * (len(y) + 1)
    for p in x:
        last, row = row, [0]
        for j, q in enumerate(y):
            row.append(last[j] + 1 if p == q else max(last[j + 1], row[j]))
    assert len(found) == 1 + row[-1]


@pytest.mark.parametrize("piece", ['<a "', "<a '\"", "<a ", "<!", "<!--", "<script", "</p", "<noscript>", "<script>", "<div>", "<li>", "<div></li>", "<h1>", "<ul><div>", "<p><b>", "<td><div>"])
def test_any_markup_takes_linear_time(piece):
    page = piece * (500_000 // len(piece))
    began = time.time()
    wrapper.text_blocks(wrapper.parse(page))
    wrapper.text_blocks(wrapper.parse("<div>" * 50_000 + "<li>x</li>" * 50_000))
    assert time.time() - began < 12


def test_names_inside_an_article():
    rng = random.Random(8)
    page = lambda i, more="": f"<html><body><nav>m</nav><article><h1>T {i}</h1><p>{words(rng, 30)}</p>{more}<p>end {i}</p></article></body></html>"
    own = "<div class='related-work'>r w</div><div class='search results'>s r</div><section id=social-history>s h</section><p>x <math><mi>y</mi></math> <span hidden>z</span></p><noscript>n</noscript>"
    found = wrapper.extract_group([page(0, own)] + [page(i, f"<div class='ad-box'>no {i}</div><div class='related-posts'>no {words(rng, 5)}</div><div class=comments>no {i}</div>") for i in range(1, 8)])
    got = found[0].split("\n")
    assert got[0] == "T 0" and got[2:] == ["r w", "s r", "s h", "x y z", "n", "end 0"]
    assert all("no" not in t.split() for t in found[1:])


def test_copies_have_one_text(spark):
    rng = random.Random(6)
    site = [soup(rng, i, [words(rng, 30) for _ in range(3)]) for i in range(150)]
    rows = [(i, f"http://a.b/{i}", p) for i, p in enumerate(site)] + [(1000 + i, "http://a.b/7", site[7]) for i in range(300)] + [(5000, "http://a.b/7", None), (5001, "http://c.d/7", site[7])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in wrapper.extract(df).collect()}
    assert len(got) == len(rows) and all(got[i].html == p and got[i].url == u for i, u, p in rows)
    assert {got[1000 + i].text for i in range(300)} == {got[7].text} and got[5000].text == "" and "Title 7" in got[5001].text
    assert "Read more" not in got[7].text and got[7].text.startswith("Title 7\n")


def test_edge_cases(spark):
    rows = [(1, "http://a.b/x", None, 5), (2, None, "<p>t</p>", 5), (3, "nonsense", "", 5), (4, "http://a.b/y", "<article>" + "<p>long text</p>" * 20_000, 5), (4, "http://a.b/y", "<p>other", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host int")
    out = wrapper.extract(df)
    assert out.columns == [*df.columns, "text"]
    got = sorted((r.page_id, len(r.text)) for r in out.collect())
    assert got == [(1, 0), (2, 1), (3, 0), (4, 5), (4, 20_000 * 10 - 1)]
    assert wrapper.extract(df.limit(0)).count() == 0
