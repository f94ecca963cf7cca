"""Every registered query against DuckDB over the same tables."""

import os

import duckdb
import pytest

from postloom.functions.html import page_text
from postloom.plans import more, nested, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries.QUERIES | nested.QUERIES | more.QUERIES, queries.SQL | nested.SQL | more.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    rel = duck.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, rel.fetchall())


def test_references_without_a_semicolon(spark, duck, tmp_path):
    """Titles are cut at a length, in the midst of a reference too."""
    cut = ["&quot", "&amp", "&am", "&", "&#39", "&#3", "&lt", "&copy", "&eacute", "&quot.", "&amp.", "&amp-x", "&ampx", "&quot;", "&amp;quot", "&amp&quot;", "AT&T"]
    pages = [(i, f'<title>a = {c}</title><a href="?x=1{c}">b {c} c</a><script>{c}</script>') for i, c in enumerate(cut)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(path)
    got = {r.page_id: r.text for r in more.QUERIES["h05_html_text"](spark, str(tmp_path)).collect()}
    with duck.cursor() as con:
        con.execute("CREATE SCHEMA cut; USE cut")
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
        assert got == dict(con.execute(SQL["h05_html_text"]).fetchall())
    assert got[1] == "a = &\nb & c" and got[4] == "a = &#39\nb &#39 c"
    assert page_text("<title>a = &quot</title>") == 'a = "'  # the parser itself reads them all
