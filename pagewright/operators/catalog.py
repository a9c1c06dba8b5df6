"""Catalog rows as DataFrames: versions, joins, name resolution, column and key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schemas of the system, prefixes of temporary ones, names of relation kinds.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "sys", "sys_catalog", "xlog_record_read")
TEMP_PREFIXES = ("pg_temp_", "pg_toast_temp_")
RELKINDS = {"r": "table", "p": "partitioned table", "t": "toast table", "c": "composite type", "i": "index", "S": "sequence", "v": "view", "m": "materialized view", "f": "foreign table"}
FIRST_USER_OID = 16384


def latest(rows: DataFrame, key: list[str], rank: list[Column], keep: list[str] | None = None) -> DataFrame:
    """The row of each key that ranks highest; ties are settled by the kept columns, so the result is the same every time.
    Rows with a NULL key are left out."""
    keep = keep or [c for c in rows.columns if c not in key]
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(*rank, *keep)).alias("r_"))
    return best.select(*key, "r_.*")


def current_relations(meta: DataFrame) -> DataFrame:
    """Current versions of relations: highest t_xmin, then highest row_no."""
    return latest(meta, ["oid"], [F.col("t_xmin"), F.col("row_no")])


def current_columns(attr: DataFrame) -> DataFrame:
    """Latest version of each column: one that isn't dropped, then the highest t_xmin, then the latest snapshot."""
    live = (~F.coalesce(F.col("attisdropped"), F.lit(False))).cast("int")
    return latest(attr.where("attnum between 1 and relnatts"), ["attrelid", "attnum"], [F.col("snap_no"), live, F.col("t_xmin")], ["attname", "atttypid", "atttypmod", "attnotnull", "attisdropped", "snap_no"])


def primary_keys(index: DataFrame) -> DataFrame:
    """The primary index of each relation with most key columns: ind_rel_id, ind_index_rel_id, ind_key (key columns only)."""
    keys = F.slice("ind_key", F.lit(1), F.greatest(F.when(F.coalesce("ind_nkeyatts", F.lit(0)) > 0, F.col("ind_nkeyatts")).otherwise(F.size("ind_key")), F.lit(1)))
    primary = index.where(F.col("ind_is_primary") & F.col("ind_rel_id").isNotNull() & (F.col("ind_rel_id") != 0)).withColumn("keys", keys)
    best = primary.groupBy("ind_rel_id").agg(F.max_by(F.struct("ind_index_rel_id", "keys"), F.struct(F.size("keys"), -F.col("ind_index_rel_id"))).alias("r"))
    return best.select("ind_rel_id", "r.ind_index_rel_id", F.col("r.keys").alias("ind_key"))


def column_lists(columns: DataFrame) -> DataFrame:
    """Columns of each relation in order of attnum: attrelid, names, n_columns."""
    live = columns.where(~F.coalesce(F.col("attisdropped"), F.lit(False)))
    return live.groupBy("attrelid").agg(F.transform(F.sort_array(F.collect_list(F.struct("attnum", "attname"))), lambda c: c["attname"]).alias("names"), F.count(F.lit(1)).alias("n_columns"))


def describe(meta: DataFrame, attr: DataFrame, index: DataFrame) -> DataFrame:
    """Relations with their columns and primary key: oid, schema_name (`public` where unknown), relname, n_columns,
    columns, pk_columns, toast_relfilenode. Relations without columns are left out."""
    relations = current_relations(meta)
    lists = column_lists(current_columns(attr)).withColumnRenamed("attrelid", "oid")
    keys = primary_keys(index).select(F.col("ind_rel_id").alias("oid"), F.posexplode("ind_key").alias("pos", "attnum"))
    named = keys.join(current_columns(attr).select(F.col("attrelid").alias("oid"), "attnum", "attname"), ["oid", "attnum"])
    pk = named.groupBy("oid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "attname"))), lambda c: c["attname"]), ",").alias("pk_columns"))
    toast = relations.select(F.col("oid").alias("toast_rel_id"), F.col("relfilenode").alias("toast_relfilenode"))
    rows = relations.join(lists, "oid").join(pk, "oid", "left").join(toast, "toast_rel_id", "left")
    return rows.select("oid", F.coalesce("schema_name", F.lit("public")).alias("schema_name"), "relname", "n_columns", F.array_join("names", ",").alias("columns"), "pk_columns", "toast_relfilenode")


def resolve_name(relations: DataFrame) -> DataFrame:
    """What a bare name means: relname, oid, schema_name; `public` first, then the smallest qualified name."""
    schema = F.coalesce("schema_name", F.lit("public"))
    best = relations.where("relname is not null").groupBy("relname").agg(F.min(F.struct((schema != "public").alias("p"), schema.alias("schema_name"), "oid")).alias("r"))
    return best.select("relname", "r.oid", "r.schema_name")


def is_system_schema(schema: Column) -> Column:
    found = schema.isin(*SYSTEM_SCHEMAS)
    for prefix in TEMP_PREFIXES:
        found = found | schema.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def relkind_name(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RELKINDS.items() for x in pair])[kind], F.concat(F.lit("kind "), kind))


def skip_reason(schema: str | None = None) -> Column:
    """Why a relation isn't exported; NULL: it is."""
    wanted = F.coalesce(F.col("schema_name"), F.lit("public"))
    out = F.when(is_system_schema(F.col("schema_name")), "system schema").when(F.col("drop_ts").isNotNull(), "dropped").when(F.col("relkind") == "p", "partition parent").when(F.col("relkind") != "r", "not a table").when(F.coalesce("relfilenode", F.lit(0)) == 0, "no storage")
    return out.when(wanted != schema, "other schema") if schema else out


def plain_indexes(index: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes that no primary or unique constraint of the same columns owns (left anti join)."""
    owned = constraints.where(F.col("contype").isin("p", "u")).select(F.col("conrelid").alias("ind_rel_id"), F.array_join("conkey", ",").alias("cols_")).distinct()
    return index.withColumn("cols_", F.array_join("ind_key", ",")).join(owned, ["ind_rel_id", "cols_"], "left_anti").drop("cols_")
