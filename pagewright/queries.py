"""The registry of queries of the core: name -> callable(spark, folder of Parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.plans import file_queries, registry  # noqa: F401
from pagewright.operators import changefeed, drift, hierarchy, orphan_catalog, orphans


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalog_forests(spark: SparkSession, folder: str) -> DataFrame:
    """Links of both forests: id struct<forest, oid>, parent."""
    meta = table(spark, folder, "table_meta").where("oid is not null").groupBy("oid").agg(F.max_by("part_parent", F.struct("t_xmin", "row_no")).alias("up"))
    own = orphan_catalog.current_types(table(spark, folder, "type_def")).select("oid", "base", "elem")
    types = own.unionByName(table(spark, folder, "builtin_type").select("oid", "base", "elem"))
    set_ = lambda c: F.when(F.col(c) != 0, F.col(c))
    both = meta.select(F.lit("part").alias("forest"), "oid", set_("up").alias("up")).unionByName(types.select(F.lit("type").alias("forest"), "oid", F.coalesce(set_("base"), set_("elem")).alias("up")))
    node = lambda c: F.struct("forest", F.col(c).alias("oid"))
    return both.select(node("oid").alias("id"), F.when(F.col("up").isNotNull(), node("up")).alias("parent"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.column_changes(table(spark, folder, "attr_row")).select("attrelid", "snap_no", "attnum", "change_kind")


def p1_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    spans = drift.lifespans(table(spark, folder, "attr_row"))
    return spans.select("attrelid", "snap_no", "attnum", "attname", "atttypid", "atttypmod", "starts", "ends")


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unified_rows(table(spark, folder, "attr_row"), table(spark, folder, "copy_record"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    forest = hierarchy.heavy_paths(catalog_forests(spark, folder))
    # the smallest id of a circle has no parent once the circle is cut there, but is a case too
    cases = forest.where("parent is not null or on_circle")
    return cases.select("id.forest", F.col("id.oid").alias("node_id"), F.col("root.oid").alias("root_id"), F.when(F.col("on_circle"), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("node_depth"))


def p2_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    forest = hierarchy.materialize(hierarchy.heavy_paths(catalog_forests(spark, folder)))
    paths = hierarchy.chain_paths(forest)
    rows = forest.join(paths, "id")
    path = F.array_join(F.transform("path", lambda n: n["oid"].cast("string")), "/")
    return rows.select("id.forest", F.col("id.oid").alias("node_id"), F.col("root.oid").alias("root_id"), F.when(F.col("on_circle"), -1).otherwise(F.col("depth")).cast("int").alias("node_depth"), path.alias("path"), F.when(~F.col("on_circle"), F.col("size") - 1).alias("n_descendants"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All proper descendants of every node of both forests, from the intervals; none of nodes on or below a circle."""
    trees = hierarchy.materialize(hierarchy.heavy_paths(catalog_forests(spark, folder))).where("not on_circle")
    return hierarchy.descendants(trees, trees).select("id.forest", F.col("id.oid").alias("node_id"), F.col("descendant.oid").alias("descendant_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.current_tuples(table(spark, folder, "heap_tuple"), table(spark, folder, "clog_status")).select("rel_oid", "page_no", "item_no")


def p3_rows(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.current_rows(table(spark, folder, "heap_tuple"), table(spark, folder, "clog_status"))


def _catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in (*orphan_catalog.SOURCES, "table_meta")}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    records = orphan_catalog.orphan_records(_catalog(spark, folder))
    return records.where(F.col("level") == 0).where(F.col("table").isin(*orphan_catalog.SOURCES)).select(F.col("table").alias("ref_table"), F.col("id").alias("ref_id"), "reason")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.per_period(orphan_catalog.orphan_references(_catalog(spark, folder)))


def p5_by_level(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans per table, month and level."""
    return orphan_catalog.orphan_report(_catalog(spark, folder))


def p5_inherited(spark: SparkSession, folder: str) -> DataFrame:
    records = orphan_catalog.orphan_records(_catalog(spark, folder))
    return records.groupBy("table", "level", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (p1_found, p1_lifespans, p1_unified, p2_found, p2_hierarchy, p2_descendants, p3_found, p3_rows, p5_found, p5_report, p5_by_level, p5_inherited)
}
QUERIES |= registry.QUERIES
