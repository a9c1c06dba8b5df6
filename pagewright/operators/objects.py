"""Roles, sequences, keys, enums and views put together from catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.catalog import FIRST_USER_OID


def is_builtin_role(oid: Column, name: Column) -> Column:
    return (oid < FIRST_USER_OID) | name.startswith("pg_")


def role_grants(members: DataFrame, roles: DataFrame) -> DataFrame:
    """Memberships (roleid, member, admin_option) by name: role, member, admin_option; each once, without those of built-in
    members; unknown roles fall out."""
    names = roles.select("oid", "rolname")
    granted = members.join(names.select(F.col("oid").alias("roleid"), F.col("rolname").alias("role")), "roleid")
    named = granted.join(names.select(F.col("oid").alias("member"), F.col("rolname").alias("member_name")), "member")
    builtin = roles.where(is_builtin_role(F.col("oid"), F.col("rolname"))).select(F.col("oid").alias("member"))
    rows = named.join(builtin, "member", "left_anti")
    return rows.groupBy("role", F.col("member_name").alias("member")).agg(F.max("admin_option").alias("admin_option"))


def enum_labels(enums: DataFrame) -> DataFrame:
    """Labels of each enum in order: enumtypid, labels."""
    return enums.groupBy("enumtypid").agg(F.transform(F.sort_array(F.collect_list(F.struct("enumsortorder", "enumlabel"))), lambda e: e["enumlabel"]).alias("labels"))


def composite_fields(columns: DataFrame) -> DataFrame:
    """Fields of composite types in order: attrelid, fields."""
    live = columns.where("attnum > 0 and not attisdropped")
    return live.groupBy("attrelid").agg(F.transform(F.sort_array(F.collect_list(F.struct("attnum", "attname", "atttypid"))), lambda c: F.struct(c["attname"].alias("name"), c["atttypid"].alias("type"))).alias("fields"))


def sequences(relations: DataFrame, definitions: DataFrame, depends: DataFrame, states: DataFrame, columns: DataFrame) -> DataFrame:
    """Sequences with definition, state and owner: relations (oid, schema_name, relname, relkind), definitions (seqrelid, ...),
    depends (objid, refobjid, refobjsubid, deptype), states (oid, last_value, is_called), columns (attrelid, attnum, attname)."""
    own = relations.where("relkind = 'S'").select("oid", "schema_name", "relname")
    owner = depends.where(F.col("deptype").isin("a", "i") & (F.col("refobjsubid") > 0)).groupBy(F.col("objid").alias("oid")).agg(F.min(F.struct("refobjid", "refobjsubid")).alias("o"))
    owner = owner.select("oid", F.col("o.refobjid").alias("attrelid"), F.col("o.refobjsubid").alias("attnum"))
    tables = relations.select(F.col("oid").alias("attrelid"), F.col("relname").alias("owner_table"))
    named = owner.join(columns.select("attrelid", "attnum", F.col("attname").alias("owner_column")), ["attrelid", "attnum"], "left").join(tables, "attrelid", "left").drop("attrelid", "attnum")
    return own.join(definitions.withColumnRenamed("seqrelid", "oid"), "oid", "left").join(states, "oid", "left").join(named, "oid", "left")


def foreign_keys(constraints: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """Foreign keys with names on both sides: con_oid, conname, table_name, columns, target_name, target_columns (NULL names
    where a column or relation isn't known). Repeated rows count once."""
    once = constraints.where("contype = 'f'").select("con_oid", "conname", "conrelid", "confrelid", "conkey", "confkey").distinct()

    def names(side: str, keys: str, out: str) -> DataFrame:
        each = once.select("con_oid", F.col(side).alias("attrelid"), F.posexplode(keys).alias("pos", "attnum"))
        each = each.join(columns.select("attrelid", "attnum", "attname"), ["attrelid", "attnum"], "left")
        return each.groupBy("con_oid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "attname"))), lambda c: c["attname"]), ",", "?").alias(out))

    own = relations.select(F.col("oid").alias("conrelid"), F.col("relname").alias("table_name"))
    target = relations.select(F.col("oid").alias("confrelid"), F.col("relname").alias("target_name"))
    rows = once.join(names("conrelid", "conkey", "columns"), "con_oid", "left").join(names("confrelid", "confkey", "target_columns"), "con_oid", "left")
    rows = rows.join(own, "conrelid", "left").join(target, "confrelid", "left")
    return rows.select("con_oid", "conname", "table_name", "columns", "target_name", "target_columns")


def view_dependencies(views: DataFrame, depends: DataFrame, relations: DataFrame) -> DataFrame:
    """What each view depends on: oid, needs (sorted names, each once, not itself)."""
    edges = depends.select(F.col("objid").alias("oid"), "refobjid").distinct().where("oid <> refobjid")
    names = relations.select(F.col("oid").alias("refobjid"), F.concat_ws(".", "schema_name", "relname").alias("needed"))
    return views.select("oid").join(edges.join(names, "refobjid"), "oid", "left").groupBy("oid").agg(F.sort_array(F.collect_set("needed")).alias("needs"))


def signatures(functions: DataFrame, types: DataFrame) -> DataFrame:
    """`name(type, type)` of each function: oid, signature. functions has oid, proname, proargtypes (array of type oids)."""
    each = functions.select("oid", F.posexplode_outer("proargtypes").alias("pos", "type"))
    named = each.join(types.select(F.col("oid").alias("type"), "typname"), "type", "left")
    args = named.groupBy("oid").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("typname", F.col("type").cast("string")).alias("t"))))).alias("a"))
    shown = F.array_join(F.transform("a", lambda x: x["t"]), ", ")
    return functions.select("oid", "proname").join(args, "oid", "left").select("oid", F.concat("proname", F.lit("("), F.coalesce(shown, F.lit("")), F.lit(")")).alias("signature"))
