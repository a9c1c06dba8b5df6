import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.operators import orphans as O
from pagewright.plans import skew

DAY = datetime.datetime(2031, 1, 10)


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_reasons(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 3)
    meta = spark.createDataFrame([(1, 1, 1, day(0), None), (2, 1, 2, day(0), None), (2, 5, 3, day(3), day(4)), (2, 5, 3, day(3), day(4)), (None, 1, 4, day(0), None)], "oid bigint, t_xmin bigint, row_no bigint, seen_ts timestamp_ntz, drop_ts timestamp_ntz")
    known = O.targets(meta, "oid", ["t_xmin", "row_no"], "drop_ts", "seen_ts")
    refs = [("a", 1, 1, day(1)), ("a", 2, 1, day(-1)), ("a", 3, 2, day(4)), ("a", 4, 2, day(3)), ("a", 5, 9, day(1)), ("a", 6, 0, day(1)), ("a", 7, None, day(1)), ("a", 8, 9, None), ("a", 9, 2, None)]
    df = spark.createDataFrame(refs, "child_table string, child_id bigint, target bigint, seen_ts timestamp_ntz").withColumn("reason_", F.lit(1))
    got = {(r.child_id, r.reason) for r in O.direct_orphans(df, known).collect()}
    assert got == {(2, "late"), (3, "deleted"), (5, "missing"), (8, "missing")}
    report = {(r.ref_table, r.reason): r.n for r in O.per_period(O.direct_orphans(df, known)).groupBy("ref_table", "reason").agg(F.sum("n").alias("n")).collect()}
    assert report == {("a", "late"): 1, ("a", "deleted"): 1, ("a", "missing"): 2}


def test_cascade(spark):
    direct = spark.createDataFrame([("t", 1, "missing"), ("t", 1, "late")], "table string, id bigint, reason string")
    links = spark.createDataFrame([("t", 2, "t", 1), ("t", 2, "t", 1), ("u", 3, "t", 2), ("t", 1, "u", 3), ("u", 4, "t", 99), ("u", 5, None, None)], "table string, id bigint, parent_table string, parent_id bigint")
    got = {(r.table, r.id, r.level, r.reason) for r in O.cascade(direct, links).collect()}
    assert got == {("t", 1, 0, "missing"), ("t", 1, 0, "late"), ("t", 2, 1, "inherited"), ("u", 3, 2, "inherited")}


def test_long_chains_are_followed_or_refused(spark):
    direct = spark.createDataFrame([("t", 0, "missing")], "table string, id bigint, reason string")
    links = spark.createDataFrame([("t", i + 1, "t", i) for i in range(6)], "table string, id bigint, parent_table string, parent_id bigint")
    assert {(r.id, r.level) for r in O.cascade(direct, links).collect()} == {(i, i) for i in range(7)}
    with pytest.raises(RuntimeError):
        O.cascade(direct, links, most_rounds=3)


def test_empty(spark):
    direct = spark.createDataFrame([], "table string, id bigint, reason string")
    links = spark.createDataFrame([], "table string, id bigint, parent_table string, parent_id bigint")
    assert O.cascade(direct, links).count() == 0
