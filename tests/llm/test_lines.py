import duckdb
import pytest

from vellum.llm import lines, queries

SF = "/root/testdata/sf0.001"


def by_sql(df):
    con = duckdb.connect()
    con.register("documents", df)
    return sorted(map(tuple, con.sql(f"SELECT doc_id, n_dropped, text FROM ({lines.SQL})").fetchall()), key=str)


def test_query_matches_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    rows = sorted(map(tuple, queries.op2_line_dedup(spark, SF).collect()), key=str)
    assert rows == by_sql(docs)
    assert sum(r[1] for r in rows) > 0


HEAD = "Posted on 3 May by the team of editors and friends"


def made(spark):
    rows = [
        (1, f"{HEAD}\nfirst own line here\n\nAll rights reserved.", "a"),
        (2, f"second own line here\n{HEAD.replace('3', '14')}\nAll rights reserved.", "a"),
        (3, f"{HEAD.replace('3', '7')}\nAll rights reserved.", "a"),
        (4, "the list of items was red\nthe list of items was blue\nno such thing as this", "b"),
        (5, "the list of items was green\nOk then\nAll rights reserved.\nAll rights reserved.", None),
        (6, "the list of items was grey", None),
        (6, "the list of items was grey", None),
        (7, None, None),
        (8, "", None),
        (None, "All rights reserved.\nnull key", "c"),
        (9, "Ok then", None),
        (10, "Ok then", None),
        (11, "pair of copies in two documents", None),
        (12, "pair of copies in two documents", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, _doc string")


def test_templates(spark):
    df = made(spark)
    out = lines.drop_recurring_lines(df, dropped="n_dropped")
    assert out.columns == ["doc_id", "text", "_doc", "n_dropped"]
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, f"{HEAD}\nfirst own line here\n") in got  # the first of the dated lines stays
    assert (2, "second own line here") in got
    assert (3, "") in got  # loses all its lines
    assert (4, "the list of items was red\nno such thing as this") in got  # one word in six varies
    assert (5, "Ok then") in got and (9, "Ok then") in got and (10, "Ok then") in got  # too short for a template
    assert (6, "") in got and (7, None) in got and (8, "") in got
    assert (None, "All rights reserved.\nnull key") in got  # null comes first
    assert (11, "pair of copies in two documents") in got and (12, "pair of copies in two documents") in got
    assert sorted(((r.doc_id, r.n_dropped, r.text) for r in out.collect()), key=str) == by_sql(df.toPandas().astype({"doc_id": "Int64"}))


def test_empty_table_and_long_text(spark):
    df = made(spark)
    assert lines.drop_recurring_lines(df.limit(0)).count() == 0
    long = "\n".join(f"own line number is {'x' * (i % 97)}a{chr(97 + i % 26)} z{i}q" for i in range(3000))
    docs = spark.createDataFrame([(i, long) for i in range(3)] + [(9, "x " * 200_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lines.drop_recurring_lines(docs, dropped="n").collect()}
    assert rows[9].n == 0 and rows[1].text == rows[2].text == ""


def texts_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.drop_recurring_lines(df, dropped="n_dropped").collect()
    assert sorted(((r.doc_id, r.n_dropped, r.text) for r in got), key=str) == by_sql(df.toPandas())
    return {r.doc_id: r.text for r in got}


def test_documents_count_and_not_lines(spark):
    own = "\n".join(f"error in module main at {w} stage of the run" for w in ("alpha", "beta", "gamma"))
    other = "error in module main was seen by nobody else today"
    assert texts_of(spark, [(1, own), (2, other)]) == {1: own, 2: other}
    # a line that repeats in one document only
    assert texts_of(spark, [(1, "one line of its own\n" * 5), (2, "quite another line")])[1] == "one line of its own\n" * 5
    # two documents with the template, one of them three times
    rows = [(1, own), (2, "error in module main at delta stage of the run"), (3, "error in module main was not seen in that week")]
    assert texts_of(spark, rows) == dict(rows)
    got = texts_of(spark, [(1, own), (2, own), (3, "error in module main at delta stage of the run")])
    assert got == {1: own.split("\n")[0], 2: "", 3: ""}


@pytest.mark.parametrize("line", ["Page {} of 10", "Copyright {} Example Media", "Posted on 2024-01-{} at 10:30"])
def test_lines_of_many_numbers(spark, line):
    assert texts_of(spark, [(i, line.format(10 + i) + f"\nword{'abcd'[i]} of its own") for i in range(4)])[3] == "wordd of its own"


def test_rows_of_numbers_stay(spark):
    rows = [(i, "12 14 15 16\nsum 4 5 6 7") for i in range(4)]
    assert texts_of(spark, rows) == dict(rows)


def test_passages_need_two_documents(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60))
    short = " ".join(long.split()[:49])
    assert texts_of(spark, [(1, f"a b {long}\nend"), (2, f"a b {long}\nown"), (3, short), (4, short)]) == {1: f"a b {long}\nend", 2: "own", 3: short, 4: short}


@pytest.mark.parametrize("line,words", [("a\tb  c\r", "a b c"), ("", ""), ("\x0b\x0c", ""), ("a\u00a0b c", "a\u00a0b c"), ("a1 b  2 c-3,x", "<*> b <*> <*>"), ("v" * 500_000 + " 7", "v" * 500_000 + " <*>")])
def test_tokens(spark, line, words):
    df = lines.spaced(spark.createDataFrame([(line,)], "line string"), "line")
    assert df.select(lines.F.trim(lines.masked("line"))).first()[0] == words
