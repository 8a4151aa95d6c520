"""Columns that a contract fixes, against their SQL."""

import pytest

from tallymark.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")

FIXED = ("page_rules", "text_statistics", "shingle_counts", "mix_targets", "plain_secrets")


def compared(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    places = [[c[0] for c in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(r) for r in got.select(columns).collect()), key=str)
    assert rows == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=str)
    return rows


@pytest.mark.parametrize("name", FIXED)
def test_given_tables(spark, sf, name):
    assert compared(spark, name, sf)


def test_odd_rows(spark, tmp_path):
    words = "a b c d e f g h i j"
    texts = [None, "", " \n\t", "One", "two Words", "\u00dc \u00fc A a", f"{words} {words}\n{words}\n{words}\n\n x\u00a0y",
             "password = 'abc123' Token:abc12 api_key=Zz9+/=", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "f" * 24 + "g" + "0" * 23, "same", "same"]
    docs = [(i // 2, t, None, "en", "extra") if i % 3 else (i, t, "src%d" % (i % 2), "en", "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, host string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet" / "d"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/documents.parquet/d/*.parquet') TO '{tmp_path}/t.parquet' (FORMAT parquet)")
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://example.com/en", "x://a.net/es/1", "x://net/fr/",
            "x://cnet/fr/", "a://b://c/d", "http://example.com?/en/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/p/*.parquet') TO '{tmp_path}/q.parquet' (FORMAT parquet)")
    folder = tmp_path / "sf"
    folder.mkdir()
    (folder / "documents.parquet").write_bytes((tmp_path / "t.parquet").read_bytes())
    (folder / "pages.parquet").write_bytes((tmp_path / "q.parquet").read_bytes())
    for name in FIXED:
        assert compared(spark, name, str(folder))
