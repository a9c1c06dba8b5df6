"""Joins and ordered look-backs that stay balanced when one key holds a large share of all rows.

Hot keys are those that hold more than 1/SHARES of the rows, so there are fewer than SHARES of them whatever the
size of the data; only their hashes come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans.lineage import materialize

#: A key is hot beyond this share of the rows.
SHARES = 48
#: Ways in which the rows of a hot key are split.
SPLITS = 32
#: Below this number of rows no key is worth splitting.
LEAST_ROWS = 200_000


def _name(stem: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """df marked for broadcast if it has at most most_rows rows, else as it is; counting stops beyond that bound."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def hot_hashes(df: DataFrame, keys: Sequence[str], least_rows: int | None = None, nulls: bool = False) -> list[int]:
    """xxhash64 of each key combination with more than 1/SHARES of the rows. Rows with a NULL key count with `nulls` only:
    they meet in no join, but in one window."""
    least = LEAST_ROWS if least_rows is None else least_rows
    present = df
    for k in keys if not nulls else ():
        present = present.where(F.col(k).isNotNull())
    counts = present.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # fewer than SHARES rows can pass, so the window-free two-step aggregate ends in a small array
    top = counts.orderBy(F.desc("n")).limit(SHARES).collect()
    total = None
    hot = []
    for row in top:
        if row.n * SHARES <= least:
            break
        if total is None:
            total = present.count()
        if total >= least and row.n * SHARES > total:
            hot.append(row.h)
    return hot


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot: list[int] | None = None) -> DataFrame:
    """Equi join (inner, left, left_semi, left_anti) of a side that may be skewed on `on` with a side that isn't.

    Rows of hot keys on the left are spread over SPLITS salts, the right rows of those keys are repeated once per salt.
    Left rows with a NULL key match nothing and are spread as well.
    """
    on = list(on)
    if hot is None:
        hot = hot_hashes(left, on)
    is_null = F.lit(False)
    for k in on:
        is_null = is_null | F.col(k).isNull()
    salt = _name("salt", left)
    others = [c for c in left.columns if c not in on]
    spread = F.pmod(F.xxhash64(*(others or on)), F.lit(SPLITS)).cast("int")
    if not hot:
        return left.join(right, on, how)
    hot_left = F.xxhash64(*on).isin(hot)
    left = left.withColumn(salt, F.when(is_null, spread).when(hot_left, spread).otherwise(F.lit(0)))
    copies = F.when(F.xxhash64(*on).isin(hot), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn(salt, F.explode(copies))
    return left.join(right, [*on, salt], how).drop(salt)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    split: bool = False,
    hot: list[int] | None = None,
) -> DataFrame:
    """Add `name`: `value` of the row before this one among the rows with equal keys, in `order`; NULL for the first.

    `order` holds ascending columns only (negate a number to look ahead).
    With `split` rows of hot keys (or of NULL ones, which are a key like others) are cut into ranges of the whole order,
    however many are alike in its first columns; they are looked back within their range, and only the first row of a
    range takes its value from the last row of an earlier one. Rows that are alike in all of `order` stay together.
    """
    keys = list(keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    if hot is None:
        hot = hot_hashes(df, keys, nulls=True) if split else []
    if not hot or not split:
        return df.withColumn(name, F.lag(value).over(window))
    is_hot = F.xxhash64(*keys).isin(hot)
    cold = df.where(~is_hot).withColumn(name, F.lag(value).over(window))
    part, first, last = _name("blk", df), _name("fst", df), _name("lst", df)
    rows = materialize(df.where(is_hot).repartitionByRange(SPLITS, *[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id()))
    inner = Window.partitionBy(*keys, part).orderBy(*order)
    rows = rows.withColumn(name, F.lag(F.struct(value.alias("v"))).over(inner)).withColumn(first, F.row_number().over(inner) == 1)
    ends = rows.groupBy(*keys, part).agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias(last))
    ends = ends.withColumn(last, F.lag(last).over(Window.partitionBy(*keys).orderBy(part)))  # at most SPLITS rows a key
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*keys, part)]
    joined = rows.alias("r").join(ends.alias("e"), reduce(Column.__and__, same), "left").select("r.*", F.col(f"e.{last}").alias(last))
    joined = joined.withColumn(name, F.when(F.col(first), F.col(last)).otherwise(F.col(name))["v"])
    return cold.unionByName(joined.drop(part, first, last))
