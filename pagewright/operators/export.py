"""Tables as text: one format a call, in the order of the file, with marks of deleted rows, and what an export leaves behind as
evidence."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import formatting, report
from pagewright.operators.visibility import deleted_mark

if TYPE_CHECKING:
    from pagewright.sources.bootstrap import Cluster

_HIDDEN = ("_state", "_toast_state", "_page", "_item")


def shown(rows: DataFrame) -> list[str]:
    """The table's own columns of what Cluster.read() gives."""
    return [c for c in rows.columns if c not in _HIDDEN]


def mark_line(rows: DataFrame) -> Column:
    """`-- DELETED ctid=(page,item)` and a line feed before the statement of a deleted row, or `-- SUSPECTED_DELETED ...`; empty
    for live rows, and where rows carry no state."""
    if "_state" not in rows.columns:
        return F.lit("")
    mark = deleted_mark(F.col("_state"))
    ctid = F.concat(F.lit(" ctid=("), F.col("_page").cast("string"), F.lit(","), F.coalesce(F.col("_item"), F.lit(0)).cast("string"), F.lit(")\n"))
    return F.when(mark != "", F.concat(F.lit("-- "), mark, ctid)).otherwise(F.lit(""))


def lines(rows: DataFrame, table: str, form: str = "sql", separator: str = "", complete: bool = True, batch: int = 1) -> DataFrame:
    """One text column `value` in the order of pages and items: INSERT statements (sql), CSV lines (csv) or COPY lines (text).

    With `batch` over 1 an INSERT takes so many rows; a deleted row has one of its own behind its mark. CSV and COPY lines
    can hold no mark: there the state follows as a last column where rows have one. `rows` come from Cluster.read(place=True).
    """
    columns, order = shown(rows), ["_page", "_item"]
    if form == "sql":
        if batch > 1:
            mark = mark_line(rows)
            made = formatting.insert_batches(rows, table, columns, order, batch, mark != "", mark)
            return made.orderBy("first_pos").select(F.col("statement").alias("value"))
        text = F.concat(mark_line(rows), formatting.insert_line(rows, table, columns, complete))
    else:
        marked = rows.withColumn("_state", deleted_mark(F.col("_state"))) if "_state" in rows.columns else rows
        columns = [*columns, *(["_state"] if "_state" in rows.columns else [])]
        rows = marked
        text = formatting.csv_line(rows, columns, separator or ",") if form == "csv" else formatting.copy_line(rows, columns, separator or "\t")
    return rows.select(*order, text.alias("value")).orderBy(*order).select("value")


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Size, crc32 and md5 of files, read in pieces on the executors: path, size, crc32, md5; NULL where unreadable."""

    def read(batches):
        import hashlib
        import zlib

        import pandas as pd

        for batch in batches:
            out = []
            for path in batch["path"]:
                crc, md5, size = 0, hashlib.md5(usedforsecurity=False), 0
                try:
                    with open(path.removeprefix("file://"), "rb") as f:
                        while piece := f.read(1 << 22):
                            crc, size = zlib.crc32(piece, crc), size + len(piece)
                            md5.update(piece)
                    out.append((path, size, f"{crc:08x}", md5.hexdigest()))
                except OSError:
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "size", "crc32", "md5"]).astype({"size": "Int64"})

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, min(len(paths), 256))).mapInPandas(read, "path string, size bigint, crc32 string, md5 string")


def entries(cluster: Cluster, names: list[str]) -> DataFrame:
    """Report entries of tables: name, oid, rows, reltuples, pages, relpages, bad_blocks, bad_pages (the first 1000), states,
    complete, toast_missing, rows_state, pages_state, severity. A table whose files can't be read whole is a failure."""
    from pagewright.sources.pagestate import evidence

    parts = []
    for name in names:
        rel = cluster.find(name)
        rows = cluster.read(name, toast_state=True)
        counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("_toast_state").alias("toast_missing"))
        seen = evidence(cluster.pages(name)).withColumn("one_", F.lit(1))
        known = (F.lit(name).alias("name"), F.lit(rel["oid"]).cast("bigint").alias("oid"), F.lit(rel["reltuples"]).cast("double").alias("reltuples"), F.lit(rel["relpages"]).cast("bigint").alias("relpages"))
        one = counted.withColumn("one_", F.lit(1)).join(seen, "one_").drop("one_")  # one row each
        parts.append(one.select(*known, "rows", "toast_missing", F.col("n_pages").alias("pages"), F.col("n_bad").alias("bad_blocks"), "bad_pages", "states", "complete"))
    if not parts:
        raise ValueError("no table to report on")
    whole = reduce(DataFrame.unionByName, parts)
    whole = whole.withColumn("rows_state", report.rows_state(F.col("rows"), F.col("reltuples"))).withColumn("pages_state", report.pages_state(F.col("pages"), F.col("relpages")))
    return whole.withColumn("severity", F.when(~F.col("complete"), 2).otherwise(report.severity()))


def report_document(whole: DataFrame) -> DataFrame:
    """One JSON document of all entries, the worst first, with totals and the verdict. As many entries as tables asked for."""
    total = report.summary(whole).withColumn("one_", F.lit(1))
    flat = whole.withColumn("states", F.map_entries("states"))  # maps have no order
    one = F.struct((-F.col("severity")).alias("order"), "name", F.struct(*[c for c in whole.columns if c != "name"]).alias("entry"))
    each = flat.agg(F.sort_array(F.collect_list(one)).alias("tables")).withColumn("one_", F.lit(1))
    again = lambda t: F.struct(t["name"].alias("name"), t["entry"].withField("states", F.map_from_entries(t["entry"]["states"])).alias("entry"))
    each = each.withColumn("tables", F.transform("tables", again))
    return total.join(each, "one_").drop("one_").select(F.to_json(F.struct("*")).alias("report"))
