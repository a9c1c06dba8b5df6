"""Keys of eight bytes where the files have oids of four."""

import duckdb

from pagewright.queries import QUERIES
from pagewright.queries_sql import SQL

#: Two differ by 2^32, so that cut ones would meet; every third is long enough for several pages or pieces.
IDS = [1, 1 + 2**32, 2**32 - 1, 2**32, 90_000_020_000, 2**63 - 1, -5, 0, 7]


def same_rows(spark, folder, name):
    docs = spark.createDataFrame([(k, f"é{i} " * (1500 * (i % 3 + 1) if i % 3 else 1), "en") for i, k in enumerate(IDS)], "doc_id bigint, text string, lang string")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_large_object_script(spark, tmp_path):
    same_rows(spark, tmp_path, "cluster_large_object_script")


def test_out_of_line_values(spark, tmp_path):
    same_rows(spark, tmp_path, "cluster_read_documents")


def test_numbers_differ(spark):
    from pagewright.plans.position import with_number

    rows = with_number(spark.range(0, 1000, 1, 7).where("id % 5 > 0").selectExpr("id % 3 AS k"), "n")
    assert rows.columns == ["k", "n"] and sorted(r.n for r in rows.collect()) == list(range(1, 801))
    assert with_number(spark.range(0), "n").count() == 0
