"""Queries with SQL against DuckDB, on the small tables and on pages full of links."""

from pathlib import Path

import pytest

from filigree.llm import queries

duckdb = pytest.importorskip("duckdb")


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        if not (Path(folder) / f"{t}.parquet").exists():
            continue
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if 'testdata' not in str(folder) else ''}')")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_small_tables(spark, small, name):
    same(spark, small, name)


def test_linked_pages(spark, tmp_path):
    c = "<link href='{}' rel=canonical>"
    pages = [
        (1, "http://A.org/x?q=1#f", c.format("http://b.net/es/1")),
        (2, "http://a.org/x?q=1", '<meta content="0; URL=\'/y\'" http-equiv=refresh>'),
        (3, "http://a.org/y", "<LINK REL='x canonical' HREF=z>"),
        (4, "http://a.org/z", c.format("//good.com/a?b=1&amp;c=2") + c.format("http://a.org/z")),
        (5, "http://solo.org", c.format("")),
        (6, "http://solo.org/p/q", c.format("r/s")),
        (7, None, c.format("http://b.net/es/1")),
        (8, "no url", None),
        (9, "http://w.net/es/9", None),
        (11, "http://up.org/a/b/c", c.format("../../x/./y") + c.format("..")),
        (12, "http://up.org/x/y", c.format("http://b.net/es/../es/1")),
        (13, "http://up.org/a/", None),
        (14, "http://base.org/deep/page", "<base target=x href='/other/'>" + c.format("leaf?a=1&#38;b=2")),
        (15, "http://base.org/other/leaf?a=1&b=2", c.format(" \n http://w.net/es/9\t")),
        (16, "http://js.org/", "<script>var s = \"" + c.format("http://w.net/es/9").replace("'", "`") + "\";</script>"),
        (17, "http://../up/../../top/.", c.format("http://s.org/?q=/../x")),
        (18, "http://s.org/?q=/../x", None),
        (10, "http://v.org/", "<!--" + c.format("http://b.net/es/1") + "-->" + c.format("http://w.net/es/9")),
    ]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "a")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, tmp_path, "op1_url_alias")
    got = {r.page_id: (r.verdict, r.alias_of) for r in queries.op1_url_alias(spark, str(tmp_path)).collect()}
    assert got[11] == got[12] == ("allow", "http://a.org/x?q=1")  # by .. and . to a chain with an allowed address
    assert got[14] == got[15] == ("block", "http://base.org/deep/page") and got[16] == ("allow", None)
    assert got[17] == got[18] == ("allow", "http://../top/")
