"""Evidence of an export: checks, coverage, summary and verdict, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_state(rows: Column, estimate: Column, tolerance: float = 0.1) -> Column:
    """Actual rows against the catalog's estimate: `unknown` (no estimate), `match`, `short` or `over`."""
    return F.when(estimate.isNull() | (estimate < 0), "unknown").when(F.abs(rows - estimate) <= tolerance * estimate, "match").when(rows < estimate, "short").otherwise("over")


def pages_state(actual: Column, expected: Column) -> Column:
    return F.when(expected.isNull() | (expected < 0), "unknown").when(actual < expected, "short").otherwise("match")


def coverage_class(typname: Column, category: Column) -> Column:
    """How values of a type are decoded: `exact`, `fallback` (text or hex) or `unresolved`."""
    return F.when(typname.isNull(), "unresolved").when(category.isin("U"), "fallback").otherwise("exact")


def severity() -> Column:
    """0 ok, 1 warning, 2 failure of a report entry with bad_blocks, toast_missing, rows_state, pages_state."""
    return (
        F.when((F.col("pages_state") == "short") | (F.col("toast_missing") > 0), 2)
        .when((F.col("bad_blocks") > 0) | (F.col("rows_state").isin("short", "over")), 1)
        .otherwise(0)
    )


def summary(entries: DataFrame) -> DataFrame:
    """One row: tables, rows, entries with each kind of trouble, verdict."""
    level = F.max("severity")
    return entries.agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.sum("rows").alias("n_rows"),
        F.count_if(F.col("rows_state") == "short").alias("n_short"),
        F.count_if(F.col("pages_state") == "short").alias("n_short_pages"),
        F.count_if(F.col("toast_missing") > 0).alias("n_toast_missing"),
        F.when(level == 2, "fail").when(level == 1, "warn").otherwise("ok").alias("verdict"),
    )


def reasons(entries: DataFrame) -> DataFrame:
    """Why the verdict isn't ok: reason, n."""
    found = F.filter(
        F.array(
            F.when(F.col("pages_state") == "short", "fewer pages than the catalog tells"),
            F.when(F.col("toast_missing") > 0, "out-of-line values missing"),
            F.when(F.col("bad_blocks") > 0, "bad blocks"),
            F.when(F.col("rows_state").isin("short", "over"), "rows differ from the estimate"),
        ),
        lambda r: r.isNotNull(),
    )
    return entries.select(F.explode(found).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
