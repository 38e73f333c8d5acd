"""Every contract query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from tessella.plans import contract


def flat(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.10g}"  # -0.0 is not 0.0
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(flat, v))}]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(flat(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(contract.SQL))
def test_query_gives_what_sql_gives(spark, sf, duck, name):
    df = contract.QUERIES[name](spark, sf)
    want = duck.sql(contract.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - set(contract.SQL) - {"index_search"}))
def test_other_queries_give_rows(spark, sf, name):
    assert contract.QUERIES[name](spark, sf).count() > 0


ODD_TEXTS = [
    "a\r\nb\r\n\r\nc", "a\n\n", "x\n\u2028", "x\n\r", "x\n\u0085", "\u00a0\nq\n\u3000\nz\nw\nv", "\t\nq\nr\ns", None, "", "\n", "\r\n", "a\n\n\nb\n",
    "\u2003 \nk", "\x0b\nl", "a\rb\n\rc", "\u200b\nm", "\u1680\nm \n\u205f\nn", "\n\n\nlast\n\n",
]


@pytest.mark.parametrize("name", ["result_lines", "result_markdown", "result_json", "preview_lines", "fallback_head", "line_chunks"])
def test_lines_of_odd_texts_are_those_of_sql(spark, tmp_path, name):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = [*ODD_TEXTS, *[f"{'long words ' * 20}\n{t}" for t in ODD_TEXTS if t]]
    docs = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 3 else "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, want = contract.QUERIES[name](spark, str(tmp_path)), c.sql(contract.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_terms_of_queries_are_not_broadcast(spark, tmp_path):
    from tessella.operators import lexical

    spark.range(50).selectExpr("id AS query_id", "concat('delete the error handler ', id) AS t").write.parquet(f"{tmp_path}/q")
    synonyms = spark.createDataFrame([("delete", "remove", 0), ("error", "exception", 1)], "term string, synonym string, ord int")
    for table in (synonyms, synonyms.hint("broadcast")):
        out = lexical.expand_queries(spark.read.parquet(f"{tmp_path}/q"), "query_id", "t", table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any("Generate" in part.split("BroadcastHashJoin")[0] for part in plan.split("BroadcastExchange")[1:])
        assert plan.count("BroadcastExchange") == (table is not synonyms)
        assert out.filter("t LIKE '% 7 %'").first()["t"] == "delete the error handler 7 remove exception"
