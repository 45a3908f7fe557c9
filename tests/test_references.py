"""Queries over pages with character references that do not end in a semicolon, against their SQL."""

import duckdb
import pytest

from vellum.plans import catalog

PAGES = [
    (1, "http://a/1", "<html><head><title>Cut at &&amp</title></head><body><nav><a href='/x'>n</a></nav><h1>Cut at &amp;&amp</h1><p><b>Bold &quot text</b> &copy 1</p></body></html>"),
    (2, "http://a/2", "<html><head><title>A &amp; B</title></head><body><h1>AT&T &amp;amp;</h1><p>&middot &quot;x&quot; & &copy; &#65 y</p></body></html>"),
]


@pytest.mark.parametrize("name", ["cleaned_pages", "converted_pages", "html_segments", "html_title", "page_blocks", "bold_openings", "page_facts"])
def test_as_sql(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = db.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want.fetchall())
