"""Orphan references of the catalog tables, built on pagewright.operators.orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.orphans import cascade, direct_orphans, per_period, targets

SOURCES = ("constr_row", "index_row", "toast_pointer", "type_def")


def current_types(type_def: DataFrame) -> DataFrame:
    """The current row of each type: highest t_xmin, then highest row_no."""
    rest = [c for c in type_def.columns if c != "oid"]
    return type_def.where("oid is not null").groupBy("oid").agg(F.max_by(F.struct(*rest), F.struct("t_xmin", "row_no")).alias("r_")).select("oid", "r_.*")


def current_relations(table_meta: DataFrame) -> DataFrame:
    """Of each relation's current row: oid, part_parent, toast_rel_id, seen_ts."""
    best = F.max_by(F.struct("part_parent", "toast_rel_id", "seen_ts"), F.struct("t_xmin", "row_no"))
    return table_meta.where("oid is not null").groupBy("oid").agg(best.alias("r")).select("oid", "r.*")


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """All references of the four catalog tables to relations: child_table, child_id, target, seen_ts; repeats fall together."""
    parts = [
        tables["constr_row"].select(F.lit("constr_row").alias("child_table"), F.col("con_oid").alias("child_id"), F.col("confrelid").alias("target"), "seen_ts"),
        tables["index_row"].select(F.lit("index_row"), "ind_index_rel_id", "ind_rel_id", "seen_ts"),
        tables["toast_pointer"].select(F.lit("toast_pointer"), "ptr_id", "toast_rel_id", "seen_ts"),
        current_types(tables["type_def"]).select(F.lit("type_def"), "oid", "typrelid", "seen_ts"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.where("child_id is not null").distinct()


def record_links(tables: dict[str, DataFrame]) -> DataFrame:
    """Foreign keys among the records themselves: table, id, parent_table, parent_id."""
    meta = current_relations(tables["table_meta"])
    types = current_types(tables["type_def"])
    edge = lambda df, table, key, to, parent: df.select(F.lit(table).alias("table"), F.col(key).alias("id"), F.lit(to).alias("parent_table"), F.col(parent).alias("parent_id"))
    parts = [
        edge(meta, "table_meta", "oid", "table_meta", "part_parent"),
        edge(tables["constr_row"], "constr_row", "con_oid", "table_meta", "confrelid"),
        edge(tables["constr_row"], "constr_row", "con_oid", "table_meta", "conrelid"),
        edge(tables["index_row"], "index_row", "ind_index_rel_id", "table_meta", "ind_rel_id"),
        edge(tables["toast_pointer"], "toast_pointer", "ptr_id", "table_meta", "rel_oid"),
        edge(types, "type_def", "oid", "table_meta", "typrelid"),
        edge(types, "type_def", "oid", "type_def", "base"),
        edge(types, "type_def", "oid", "type_def", "elem"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.where("parent_id <> 0")


def orphan_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Direct orphan references of the four tables: child_table, child_id, target, seen_ts, reason."""
    known = targets(tables["table_meta"], "oid", ["t_xmin", "row_no"], "drop_ts", "seen_ts")
    return direct_orphans(references(tables), known)


def orphan_records(tables: dict[str, DataFrame]) -> DataFrame:
    """Direct and inherited orphans of all catalog records: table, id, level, reason.

    Level 0 holds the direct orphan references of the four tables and the partitions whose parent is missing.
    """
    known = targets(tables["table_meta"], "oid", ["t_xmin", "row_no"], "drop_ts", "seen_ts")
    meta = current_relations(tables["table_meta"])
    parents = meta.select(F.lit("table_meta").alias("child_table"), F.col("oid").alias("child_id"), F.col("part_parent").alias("target"), "seen_ts")
    direct = direct_orphans(references(tables).unionByName(parents), known).where("child_table <> 'table_meta' or reason = 'missing'")
    return cascade(direct.select(F.col("child_table").alias("table"), F.col("child_id").alias("id"), "reason"), record_links(tables))


def first_seen(tables: dict[str, DataFrame]) -> DataFrame:
    """When each catalog record was first seen: table, id, seen_ts; of versions of one oid the current one's."""
    parts = [
        tables["constr_row"].select(F.lit("constr_row").alias("table"), F.col("con_oid").alias("id"), "seen_ts"),
        tables["index_row"].select(F.lit("index_row"), "ind_index_rel_id", "seen_ts"),
        tables["toast_pointer"].select(F.lit("toast_pointer"), "ptr_id", "seen_ts"),
        current_types(tables["type_def"]).select(F.lit("type_def"), "oid", "seen_ts"),
        current_relations(tables["table_meta"]).select(F.lit("table_meta"), "oid", "seen_ts"),
    ]
    return reduce(DataFrame.union, parts).where("id is not null").groupBy("table", "id").agg(F.min("seen_ts").alias("seen_ts"))


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphans per table, month of seen_ts and reason, direct and inherited: ref_table, period, reason, level (0: direct), n.

    A direct orphan counts once for each of its reasons, in the month of its record; inherited ones once.
    """
    records = orphan_records(tables)
    dated = records.join(first_seen(tables), ["table", "id"], "left")
    return per_period(dated.withColumnRenamed("table", "child_table"), extra=["level"])
