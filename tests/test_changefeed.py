import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import changefeed as C
from pagewright.plans import skew
from tests_feed import CLOG, HEAP, brute, feed

@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [False, True])
def test_current_tuples(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    rng = random.Random(seed)
    heap, clog = feed(rng, 150)
    # order ties of t_xmin within a row by place, as documented
    df = spark.createDataFrame(heap, HEAP).withColumn("before_", F.lit(1)).withColumn("xid_", F.lit("clash")).withColumn("image", F.lit(0))
    log = spark.createDataFrame(clog, CLOG).withColumn("salt", F.lit(1))
    got = {(r.rel_oid, r.page_no, r.item_no) for r in C.current_tuples(df, log).collect()}
    assert got == brute(heap, clog)
    texts = C.current_rows(df, log)
    assert {(r.rel_oid, r.page_no, r.item_no) for r in texts.collect()} == got


def test_apply_changes_with_base(spark):
    base = spark.createDataFrame([(1, "a0"), (2, "b0"), (3, "c0")], "k int, v string")
    changes = spark.createDataFrame([(1, 5, "a1"), (1, 9, None), (1, 7, "a2"), (1, 5, "a1"), (2, 4, "b1"), (4, 1, "d1"), (5, 1, None)], "k int, n bigint, v string")
    got = {(r.k, r.v) for r in C.apply_changes(base, changes, ["k"], ["n"], "v").collect()}
    assert got == {(2, "b1"), (3, "c0"), (4, "d1")}


def test_hot_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    changes = spark.createDataFrame([(1, n, f"v{n}") for n in range(500)] + [(2, 1, "x")], "k int, n bigint, v string")
    got = {(r.k, r.v) for r in C.apply_changes(None, changes, ["k"], ["n"], "v").collect()}
    assert got == {(1, "v499"), (2, "x")}


def test_empty(spark):
    assert C.current_tuples(spark.createDataFrame([], HEAP), spark.createDataFrame([], CLOG)).count() == 0
