"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from lodestead import catalogue

DATA = os.environ.get("LODESTEAD_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.sql(entry.oracle_sql()[name])
    columns = found.columns
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=key)
    want = sorted(([plain(v) for v in r] for r in found.fetchall()), key=key)
    assert got == want


def rows_of(spark, name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def test_extract_pages(spark):
    """Every document with an answer of its own is extracted once; hash and text agree, furniture elements leave no text."""
    got = {r.fetch_id: r for r in entry.queries()["extract_pages"](spark, DATA).collect()}
    fetched = {r["fetch_id"]: r for r in rows_of(spark, "fetched_pages")}
    assert set(got) <= set(fetched) and {k for k, r in fetched.items() if r["html"] and 200 <= r["status"] < 300} <= set(got)
    by_text = {}
    for k, r in got.items():
        assert r.hash and (r.n_blocks > 0 or not r.text) and "<script" not in r.text and "var t=" not in r.text
        assert by_text.setdefault((r.title, r.text), r.hash) == r.hash
    assert len({r.hash for r in got.values()}) == len(by_text)


def test_chunk_pages(spark):
    """Chunks are numbered from 0 without gaps, none is empty or longer than 900 characters, and together they hold every word of the text blocks."""
    got, words = {}, {}
    for r in entry.queries()["chunk_pages"](spark, DATA).collect():
        key = str(r.page_id)
        got.setdefault(key, []).append(r.chunk_index)
        words.setdefault(key, set()).update(r.body.split())
        assert r.body.strip() == r.body and 0 < len(r.body) <= 900
    assert got and all(sorted(v) == list(range(len(v))) for v in got.values())
    for page in rows_of(spark, "extracted_pages"):
        key = str(page["page_id"])
        if key in words and page["blocks"]:
            text = {w for b in page["blocks"] if b["type"] != "heading" and b["text"] for w in b["text"].split() if len(w) < 200}
            assert text <= words[key]


def test_all_queries_have_sql_or_a_test():
    tested = {n.removeprefix("test_") for n in globals()}
    assert set(catalogue.QUERIES) - set(catalogue.SQL) <= tested


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
