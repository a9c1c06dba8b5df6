"""Salted joins and look-backs against plain ones, with keys hot enough to be split."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.plans import skew
from pagewright.plans.position import with_position


@pytest.fixture()
def eager(monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)


def rows(spark, n=600):
    rng = random.Random(7)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), i, f"v{i}") for i in range(n)]
    return spark.createDataFrame(data, "k int, o bigint, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join(spark, eager, how):
    left = rows(spark).withColumn("salt", F.lit("kept"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d"), (None, "e")], "k int, w string")
    assert skew.hot_hashes(left, ["k"])
    got = sorted(map(str, skew.skew_join(left, right, ["k"], how).collect()))
    assert got == sorted(map(str, left.join(right, "k", how).select(*skew.skew_join(left, right, ["k"], how).columns).collect()))


def test_look_back(spark, eager):
    df = rows(spark)
    got = skew.previous(df, ["k"], [F.col("o")], F.col("v"), "p", split=True)
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    assert sorted(map(str, got.select("k", "o", "v", "p").collect())) == sorted(map(str, want.collect()))


def test_look_back_with_one_first_order_value(spark, eager):
    df = rows(spark).withColumn("tx", F.lit(700))
    got = skew.previous(df, ["k"], [F.col("tx"), F.col("o")], F.col("v"), "p", split=True)
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("tx", "o")))
    assert sorted(map(str, got.select("k", "o", "v", "tx", "p").collect())) == sorted(map(str, want.collect()))


def test_small_sides_only_are_broadcast(spark):
    df = rows(spark)
    plan = lambda x: rows(spark).join(x, "k")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(skew.small(df)) and "broadcast" not in plan(skew.small(df, 10))


def test_few_rows_have_no_hot_keys(spark):
    assert skew.hot_hashes(rows(spark), ["k"]) == []


def test_positions(spark):
    df = rows(spark).repartition(7)
    got = {r.o: r.n for r in with_position(df, ["o"], "n").collect()}
    assert got == {i: i + 1 for i in range(600)}
