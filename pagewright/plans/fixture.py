"""A cluster's files made from the catalog tables: what the queries read that go from files to results."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import catalog
from pagewright.operators.orphan_catalog import current_types
from pagewright.plans.lineage import remove_at_exit, shared_root
from pagewright.sources.bootstrap import CATALOG_OIDS, Cluster, catalog_layout
from pagewright.sources.pagewriter import write_relation

VERSION, DATABASE = 16, 16384
#: Oids of schemas that the tables name only: from here on, in order of names.
FIRST_SCHEMA = 100_000_001


class Folder:
    """A data folder below the shared one that goes when the process ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/cluster-{uuid.uuid4().hex}".removeprefix("file://")
        remove_at_exit(spark, self.root)
        for part in ("base/16384", "base/1", "global", "pg_xact"):
            os.makedirs(f"{self.root}/{part}")
        with open(f"{self.root}/PG_VERSION", "w") as f:
            f.write(f"{VERSION}\n")

    def put(self, name: str, df: DataFrame, spread: bool = True) -> None:
        """Write a catalog; columns that df lacks are zero or empty."""
        write_relation(df, f"{self.root}/base/{DATABASE}/{CATALOG_OIDS[name]}", catalog_layout(name, VERSION), spread=spread)

    def put_shared(self, name: str, df: DataFrame) -> None:
        write_relation(df, f"{self.root}/global/{CATALOG_OIDS[name]}", catalog_layout(name, VERSION))

    def table(self, number: int, df: DataFrame, layout: str, parts: int = 4, spread: bool = True) -> None:
        write_relation(df, f"{self.root}/base/{DATABASE}/{number}", layout, parts=parts, spread=spread)

    def rows(self, name: str, rows: list[dict]) -> None:
        """Write a catalog from a few rows."""
        from pyspark.sql import Row

        self.put(name, self.spark.createDataFrame([Row(**r) for r in rows]))

    def cluster(self) -> Cluster:
        return Cluster(self.spark, self.root, DATABASE)


def _n(column: str | Column, kind: str = "bigint") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0)).cast(kind)


def catalog_cluster(spark: SparkSession, tables: dict[str, DataFrame], names: tuple[str, ...]) -> Cluster:
    """A cluster whose catalogs hold what table_meta, attr_row, type_def, builtin_type, constr_row and index_row tell.

    Versions of relations that aren't the current one are dead tuples. `names` are the catalogs that are wanted.
    """
    out = Folder(spark)
    meta = tables["table_meta"].where("oid is not null")
    schemas = meta.where("schema_name is not null").select("schema_name").distinct()
    from pagewright.plans.position import with_position

    schemas = with_position(schemas, ["schema_name"], "pos").select("schema_name", (F.col("pos") + FIRST_SCHEMA - 1).alias("relnamespace"))
    current = catalog.current_relations(tables["table_meta"])
    if "pg_namespace" in names:
        out.put("pg_namespace", schemas.select(F.col("relnamespace").alias("oid"), F.col("schema_name").alias("nspname")))
    if "pg_class" in names:
        live = current.select("oid", "row_no").withColumn("alive", F.lit(True))
        rows = meta.join(live, ["oid", "row_no"], "left").join(schemas, "schema_name", "left")
        dead = F.col("alive").isNull()
        bound = F.when(_n("part_parent") != 0, F.lit("{PARTITIONBOUNDSPEC :strategy l :is_default true}"))
        made = rows.select(
            "oid", F.coalesce("relname", F.lit("")).alias("relname"), _n("relnamespace").alias("relnamespace"), F.col("relkind"), _n("relfilenode").alias("relfilenode"), _n("toast_rel_id").alias("reltoastrelid"),
            _n("relpages").alias("relpages"), F.coalesce("reltuples", F.lit(-1.0)).alias("reltuples"), F.lit(0).alias("relnatts"), bound.alias("relpartbound"),
            F.lit(100).alias("_xmin"), F.when(dead, 200).otherwise(0).alias("_xmax"), F.when(dead, 0x500).otherwise(0x900).alias("_infomask"),
        )
        taken = meta.select(F.col("oid").alias("ind_index_rel_id"))
        own = tables["index_row"].where("ind_index_rel_id is not null").select("ind_index_rel_id").distinct().join(taken, "ind_index_rel_id", "left_anti")
        index = {"oid": F.col("ind_index_rel_id"), "relname": F.concat(F.lit("ix_"), F.col("ind_index_rel_id").cast("string")), "relkind": F.lit("i"), "_xmin": F.lit(100), "_infomask": F.lit(0x900)}
        out.put("pg_class", made.unionByName(own.select(*[index.get(f.name, F.lit(None if f.name == "relpartbound" else 0)).cast(f.dataType).alias(f.name) for f in made.schema])))
    if "pg_inherits" in names:
        out.put("pg_inherits", current.where("part_parent <> 0").select(F.col("oid").alias("inhrelid"), F.col("part_parent").alias("inhparent"), F.lit(1).alias("inhseqno")))
    if "pg_attribute" in names:
        cols = catalog.current_columns(tables["attr_row"])
        out.put("pg_attribute", cols.select("attrelid", F.coalesce("attname", F.lit("")).alias("attname"), _n("atttypid").alias("atttypid"), F.lit(-1).alias("attlen"), "attnum", F.coalesce("atttypmod", F.lit(-1)).alias("atttypmod"), F.lit("i").alias("attalign"), F.coalesce("attnotnull", F.lit(False)).alias("attnotnull"), F.coalesce("attisdropped", F.lit(False)).alias("attisdropped")))
    if "pg_type" in names:
        own = current_types(tables["type_def"]).select("oid", "typname", "typlen", "typtype", "category", "elem", "base", "typrelid", "notnull")
        built = tables["builtin_type"].select("oid", "typname", "typlen", F.lit("b").alias("typtype"), "category", "elem", "base", F.lit(0).cast("bigint").alias("typrelid"), F.lit(False).alias("notnull"))
        rows = own.unionByName(built)
        out.put("pg_type", rows.select("oid", F.coalesce("typname", F.lit("")).alias("typname"), _n("typlen").alias("typlen"), F.coalesce("typtype", F.lit("")).alias("typtype"), F.coalesce("category", F.lit("")).alias("typcategory"), _n("elem").alias("typelem"), _n("base").alias("typbasetype"), _n("typrelid").alias("typrelid"), F.coalesce("notnull", F.lit(False)).alias("typnotnull"), F.lit(-1).alias("typtypmod")))
    if "pg_index" in names:
        one = tables["index_row"].where("ind_index_rel_id is not null").groupBy("ind_index_rel_id").agg(F.max_by(F.struct("ind_rel_id", "ind_is_primary", "ind_is_unique", "ind_key", "ind_nkeyatts"), F.struct("seen_ts", "ind_rel_id")).alias("r")).select("ind_index_rel_id", "r.*")
        out.put("pg_index", one.select(F.col("ind_index_rel_id").alias("indexrelid"), _n("ind_rel_id").alias("indrelid"), _n("ind_nkeyatts").alias("indnkeyatts"), F.coalesce("ind_is_unique", F.lit(False)).alias("indisunique"), F.coalesce("ind_is_primary", F.lit(False)).alias("indisprimary"), F.coalesce("ind_key", F.array().cast("array<int>")).alias("indkey"), F.array().cast("array<int>").alias("indoption"), F.array().cast("array<int>").alias("indcollation"), F.array().cast("array<int>").alias("indclass")))
    if "pg_constraint" in names:
        one = tables["constr_row"].where("con_oid is not null").groupBy("con_oid").agg(F.max_by(F.struct("conname", "contype", "conrelid", "conkey", "confrelid", "confkey", "validated"), F.struct("seen_ts", "conrelid")).alias("r")).select("con_oid", "r.*")
        out.put("pg_constraint", one.select(F.col("con_oid").alias("oid"), F.coalesce("conname", F.lit("")).alias("conname"), F.coalesce("contype", F.lit("")).alias("contype"), _n("conrelid").alias("conrelid"), _n("confrelid").alias("confrelid"), F.coalesce("validated", F.lit(True)).alias("convalidated"), F.lit("a").alias("confupdtype"), F.lit("a").alias("confdeltype"), "conkey", "confkey"))
    return out.cluster()
