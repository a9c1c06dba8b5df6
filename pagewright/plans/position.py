"""Global row positions without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans.lineage import materialize

#: monotonically_increasing_id() has the row's place in its task below this bit, the task above it.
_TASK_BIT = 33


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add `name`: the row's position from 1 in the order of the columns `order`; rows that are equal there are ordered
    arbitrarily. Rows are sorted by range over all partitions; one row for each partition is summed up."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p_", F.spark_partition_id()).withColumn("i_", F.monotonically_increasing_id())
    placed = materialize(placed)
    marked = placed.withColumn("n_", F.row_number().over(Window.partitionBy("p_").orderBy("i_")))
    sums = placed.groupBy("p_").agg(F.count(F.lit(1)).alias("c_"))
    sums = sums.select("p_", F.coalesce(F.sum("c_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_"))
    return marked.join(F.broadcast(sums), "p_").withColumn(name, F.col("b_") + F.col("n_")).drop("p_", "i_", "n_", "b_")


def with_number(df: DataFrame, name: str) -> DataFrame:
    """Add `name`: a number from 1 on, another one for each row, in no order. Rows are written once and neither sorted nor
    shuffled; one row for each task is summed up. release() takes what it gives."""
    placed = materialize(df.withColumn("m_", F.monotonically_increasing_id()))
    task, place = F.shiftright("m_", _TASK_BIT), F.col("m_").bitwiseAND((1 << _TASK_BIT) - 1)
    sums = placed.groupBy(task.alias("p_")).agg((F.max(place) + 1).alias("c_"))
    sums = sums.select("p_", F.coalesce(F.sum("c_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_"))
    out = placed.withColumn("p_", task).join(F.broadcast(sums), "p_").withColumn(name, F.col("b_") + place + 1).drop("p_", "m_", "b_")
    out._pagewright_path = placed._pagewright_path  # type: ignore[attr-defined]
    return out
