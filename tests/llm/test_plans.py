"""Encoding and sentences are one pass over a pruned scan."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.mark.parametrize("name, schema", [("p6_ids", "ReadSchema: struct<doc_id:bigint,text:string>"), ("p8_found", "ReadSchema: struct<doc_id:bigint,text:string,format:string,status:string>")])
def test_no_shuffle(spark, name, schema):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and schema in plan
    assert name != "p8_found" or "EqualTo(status,ok)" in plan


@pytest.mark.parametrize("name", ["p1_found", "p1_groups", "p2_found", "p2_forms", "p2_groups", "p3_slices", "p3_documents", "p4_found", "p4_paragraphs", "p5_found", "p5_pieces", "p6_ids", "p7_containers", "p7_usage", "p8_found", "p8_units"])
def test_every_query_gives_rows(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.count() > 0


def test_p5_found_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("chunks", "documents", "chunk_params"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = sorted(r.chunk_id for r in entry.queries()["p5_found"](spark, FOLDER).collect())
    assert got == sorted(r[0] for r in con.sql(entry.oracle_sql()["p5_found"]).fetchall())
