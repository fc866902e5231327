"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest

from suite.check import connect, difference
from tablewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op3_jaccard", "op5_substrings", "op7_warc"])
def test_agrees_with_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name]) is None


def _compare(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert difference(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name]) is None


def test_equal_payloads_agree_with_sql(spark, tmp_path):
    long, wide = "x" * 1000, "é" * 500
    htmls = [long, long, wide, "x" * 999, "x" * 999, None, "", wide, long + "y", long]
    rows = [(i * 7 % 10, "u", h) for i, h in enumerate(htmls)]
    _compare(spark, tmp_path, "op7_warc", "pages", rows, "page_id long, url string, html string")


ODD_TEXTS = [None, "", "  \t", "one two", "One TWO", "a b c d e", "a b c d e f", "A b\nc  d e", "É a b c d e", "é a b c d e"]


def _documents():
    passage = " ".join(f"p{i}" for i in range(13))
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + [f"n{k}"] + words[k + 1 :]) for k in (0, 5, 30, 59)]
    texts = [*ODD_TEXTS, passage, f"x {passage} y", f"{passage} {passage}", " ".join(words), *near, passage.upper(), passage[:-2]]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name", ["op3_jaccard", "op5_substrings"])
def test_odd_texts_agree_with_sql(spark, tmp_path, name):
    _compare(spark, tmp_path, name, "documents", _documents(), "doc_id long, text string")
