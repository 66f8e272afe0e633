"""The queries that have SQL against it, and against SQL on odd rows."""

import os

import duckdb
import pytest
from helpers import documents, texts

from orefield.llm import decontamination, licenses, mixing, queries, substrings, warc


def rows_of(frame, columns):
    return sorted((tuple(None if x is None or x != x else round(float(x), 6) if not isinstance(x, str) else x for x in r) for r in frame[columns].itertuples(index=False)), key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


def same(spark_frame, con, sql):
    want = con.execute(sql).df().astype(object)
    want = want.where(want.notna(), None)
    got = spark_frame.toPandas().astype(object)
    got = got.where(got.notna(), None)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows_of(got, columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    same(queries.QUERIES[name](spark, data), con, queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Odd rows as tables of a scale folder."""
    folder = str(tmp_path_factory.mktemp("odd"))
    sources = ["a", "b", None, "é"]
    rows = [(i, t, sources[n % 4]) for n, (i, t) in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    items = [(9, "Same, ROW"), (11, "one"), (12, None), (13, ""), (14, "pass1 pass2 pass3 pass4 pass5 pass6 pass7 pass8 pass9 pass10 pass11 elsewhere")]
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    big = "x" * 1200
    pages = [(1, "u", big), (2, "u", big), (None, "n", big), (3, None, None), (None, "v", "y" * 1000), (None, "w", "y" * 1000), (4, "z", "é" * 600), (5, "z", "é" * 600), (6, "s", "small"), (7, "s", "small")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql_on_odd_rows(spark, odd, name):
    folder, con = odd
    same(queries.QUERIES[name](spark, folder), con, queries.ORACLE_SQL[name])


def test_small_parameters(spark, odd):
    folder, con = odd
    from orefield.llm import sql

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    same(substrings.removed(docs, width=3, gram=2).drop("kept_text"), con, sql.substrings_sql(3))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    same(decontamination.scan(docs, items, 4).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), con, sql.decontamination_sql(4))
    shapes = (mixing.FALLING, mixing.RISING)
    same(mixing.mix(docs, weights=(5, 1), cap=2.0, shapes=shapes), con, sql.mixing_sql((5, 1), 2.0, shapes))
    same(warc.archive(spark.read.parquet(f"{folder}/pages.parquet"), 5).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured"), con, sql.warc_sql(5))
    same(licenses.scan(documents(spark), licenses.PHRASES, {"odd": "base1 base2 base3 base4 base5 base6 base7 base8 base9 base10"}, 0.5), con, sql.licenses_sql(licenses.PHRASES, {"odd": "base1 base2 base3 base4 base5 base6 base7 base8 base9 base10"}, 0.5))
