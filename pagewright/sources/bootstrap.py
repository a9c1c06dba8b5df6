"""From a cluster's folder to its tables: system catalogs read as heap files, relations found by name, rows decoded."""

from __future__ import annotations

import json
import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.compress import decompress
from pagewright.functions.decode import OIDS, decode
from pagewright.operators.catalog import FIRST_USER_OID
from pagewright.operators.visibility import admitted, visibility
from pagewright.sources.control import databases, parse_control, relation_path
from pagewright.sources.heap import HeapDataSource, register
from pagewright.sources.layout import ALIGNS, ColumnLayout, dump_columns, parse_columns
from pagewright.sources.pages import _TEXTS, _decoded, decode_columns, standard_tuples

# Oids of the catalogs, and their columns by release (PostgreSQL 12 to 17).
CATALOG_OIDS = {"pg_type": 1247, "pg_attribute": 1249, "pg_proc": 1255, "pg_class": 1259, "pg_authid": 1260, "pg_auth_members": 1261, "pg_database": 1262, "pg_constraint": 2606, "pg_index": 2610, "pg_inherits": 2611, "pg_largeobject": 2613, "pg_namespace": 2615, "pg_sequence": 2224, "pg_enum": 3501, "pg_largeobject_metadata": 2995, "pg_partitioned_table": 3350, "pg_attrdef": 2604, "pg_description": 2609, "pg_extension": 3079, "pg_depend": 2608, "pg_trigger": 2620, "pg_rewrite": 2618, "pg_opclass": 2616, "pg_collation": 3456, "pg_language": 2612}
SHARED = {"pg_authid", "pg_auth_members", "pg_database"}
_CLASS = "oid oid, relname name, relnamespace oid, reltype oid, reloftype oid, relowner oid, relam oid, relfilenode oid, reltablespace oid, relpages int4, reltuples float4, relallvisible int4, {frozen}reltoastrelid oid, relhasindex bool, relisshared bool, relpersistence char, relkind char, relnatts int2, relchecks int2, relhasrules bool, relhastriggers bool, relhassubclass bool, relrowsecurity bool, relforcerowsecurity bool, relispopulated bool, relreplident char, relispartition bool, relrewrite oid, relfrozenxid xid, relminmxid xid, relacl _aclitem, reloptions _text, relpartbound pg_node_tree"
_CATALOGS = {
    "pg_namespace": "oid oid, nspname name, nspowner oid",
    "pg_inherits": "inhrelid oid, inhparent oid, inhseqno int4",
    "pg_enum": "oid oid, enumtypid oid, enumsortorder float4, enumlabel name",
    "pg_index": "indexrelid oid, indrelid oid, indnatts int2, indnkeyatts int2, indisunique bool, {distinct}indisprimary bool, indisexclusion bool, indimmediate bool, indisclustered bool, indisvalid bool, indcheckxmin bool, indisready bool, indislive bool, indisreplident bool, indkey int2vector, indcollation oidvector, indclass oidvector, indoption int2vector, indexprs pg_node_tree, indpred pg_node_tree",
    "pg_type": "oid oid, typname name, typnamespace oid, typowner oid, typlen int2, typbyval bool, typtype char, typcategory char, typispreferred bool, typisdefined bool, typdelim char, typrelid oid, {subscript}typelem oid, typarray oid, typinput oid, typoutput oid, typreceive oid, typsend oid, typmodin oid, typmodout oid, typanalyze oid, typalign char, typstorage char, typnotnull bool, typbasetype oid, typtypmod int4, typndims int4, typcollation oid, typdefaultbin pg_node_tree, typdefault text",
    "pg_sequence": "seqrelid oid, seqtypid oid, seqstart int8, seqincrement int8, seqmax int8, seqmin int8, seqcache int8, seqcycle bool",
    "pg_authid": "oid oid, rolname name, rolsuper bool, rolinherit bool, rolcreaterole bool, rolcreatedb bool, rolcanlogin bool, rolreplication bool, rolbypassrls bool, rolconnlimit int4, rolpassword text, rolvaliduntil timestamptz",
    "pg_largeobject": "loid oid, pageno int4, data bytea",
    "pg_largeobject_metadata": "oid oid, lomowner oid",
    "pg_constraint": "oid oid, conname name, connamespace oid, contype char, condeferrable bool, condeferred bool, {enforced}convalidated bool, conrelid oid, contypid oid, conindid oid, conparentid oid, confrelid oid, confupdtype char, confdeltype char, confmatchtype char, conislocal bool, coninhcount {inhcount}, connoinherit bool, {period}conkey _int2, confkey _int2, conpfeqop _oid, conppeqop _oid, conffeqop _oid, {delsetcols}conexclop _oid, conbin pg_node_tree",
    "pg_attrdef": "oid oid, adrelid oid, adnum int2, adbin pg_node_tree",
    "pg_description": "objoid oid, classoid oid, objsubid int4, description text",
    "pg_partitioned_table": "partrelid oid, partstrat char, partnatts int2, partdefid oid, partattrs int2vector, partclass oidvector, partcollation oidvector, partexprs pg_node_tree",
    "pg_depend": "classid oid, objid oid, objsubid int4, refclassid oid, refobjid oid, refobjsubid int4, deptype char",
    "pg_auth_members": "{member_oid}roleid oid, member oid, grantor oid, admin_option bool",
    "pg_database": "oid oid, datname name, datdba oid, encoding int4",
    "pg_trigger": "oid oid, tgrelid oid, {parent}tgname name, tgfoid oid, tgtype int2, tgenabled char, tgisinternal bool, tgconstrrelid oid, tgconstrindid oid, tgconstraint oid, tgdeferrable bool, tginitdeferred bool, tgnargs int2, tgattr int2vector, tgargs bytea, tgqual pg_node_tree",
    "pg_rewrite": "oid oid, rulename name, ev_class oid, ev_type char, ev_enabled char, is_instead bool, ev_qual pg_node_tree, ev_action pg_node_tree",
    "pg_proc": "oid oid, proname name, pronamespace oid, proowner oid, prolang oid, procost float4, prorows float4, provariadic oid, prosupport oid, prokind char, prosecdef bool, proleakproof bool, proisstrict bool, proretset bool, provolatile char, proparallel char, pronargs int2, pronargdefaults int2, prorettype oid, proargtypes oidvector, proallargtypes _oid, proargmodes _char, proargnames _text, proargdefaults pg_node_tree, protrftypes _oid, prosrc text",
    "pg_opclass": "oid oid, opcmethod oid, opcname name, opcnamespace oid, opcowner oid, opcfamily oid, opcintype oid, opcdefault bool",
    "pg_collation": "oid oid, collname name, collnamespace oid, collowner oid, collprovider char",
    "pg_language": "oid oid, lanname name, lanowner oid",
    "pg_extension": "oid oid, extname name, extowner oid, extnamespace oid",
}
_ATTRIBUTE = {
    12: "attrelid oid, attname name, atttypid oid, attstattarget int4, attlen int2, attnum int2, attndims int4, attcacheoff int4, atttypmod int4, attbyval bool, attstorage char, attalign char, attnotnull bool, atthasdef bool, atthasmissing bool, attidentity char, attgenerated char, attisdropped bool",
    14: "attrelid oid, attname name, atttypid oid, attstattarget int4, attlen int2, attnum int2, attndims int4, attcacheoff int4, atttypmod int4, attbyval bool, attalign char, attstorage char, attcompression char, attnotnull bool, atthasdef bool, atthasmissing bool, attidentity char, attgenerated char, attisdropped bool",
    16: "attrelid oid, attname name, atttypid oid, attlen int2, attnum int2, attcacheoff int4, atttypmod int4, attndims int2, attbyval bool, attalign char, attstorage char, attcompression char, attnotnull bool, atthasdef bool, atthasmissing bool, attidentity char, attgenerated char, attisdropped bool",
    18: "attrelid oid, attname name, atttypid oid, attlen int2, attnum int2, atttypmod int4, attndims int2, attbyval bool, attalign char, attstorage char, attcompression char, attnotnull bool, atthasdef bool, atthasmissing bool, attidentity char, attgenerated char, attisdropped bool",
}
# Codecs by the number of a database's encoding.
ENCODINGS = {0: "utf-8", 1: "euc_jp", 2: "gb2312", 3: "euc_kr", 5: "euc_jisx0213", 6: "utf-8", 8: "latin-1", 9: "iso8859-2", 10: "iso8859-3", 11: "iso8859-4", 12: "iso8859-9", 13: "iso8859-10", 14: "iso8859-13", 15: "iso8859-14", 16: "iso8859-15", 17: "iso8859-16", 18: "cp1256", 19: "cp1258", 20: "cp866", 21: "cp874", 22: "koi8-r", 23: "cp1251", 24: "cp1252", 25: "iso8859-5", 26: "iso8859-6", 27: "iso8859-7", 28: "iso8859-8", 29: "cp1250", 30: "cp1253", 31: "cp1254", 32: "cp1255", 33: "cp1257", 34: "koi8-u", 35: "shift_jis", 36: "big5", 37: "gbk", 38: "cp949", 39: "gb18030", 40: "johab"}
#: Names that show a file to be a catalog, where the file of its oid is missing.
WELL_KNOWN = {"pg_class": ("pg_class", "pg_attribute", "pg_proc"), "pg_namespace": ("pg_catalog", "pg_toast", "public"), "pg_attribute": ("attrelid", "atttypid", "relname"), "pg_type": ("bool", "bytea", "int8")}


def catalog_layout(name: str, version: int) -> str:
    """Columns of a catalog in a major release."""
    if name == "pg_class":
        return _CLASS.format(frozen="relallfrozen int4, " if version >= 18 else "")
    if name == "pg_attribute":
        return _ATTRIBUTE[max(v for v in _ATTRIBUTE if v <= max(version, 12))]
    if name not in _CATALOGS:
        raise ValueError(f"no layout of {name}")
    since = lambda release, text: text if version >= release else ""
    return _CATALOGS[name].format(
        distinct=since(15, "indnullsnotdistinct bool, "), subscript=since(14, "typsubscript oid, "), enforced=since(18, "conenforced bool, "), inhcount="int2" if version >= 17 else "int4",
        period=since(18, "conperiod bool, "), delsetcols=since(15, "confdelsetcols _int2, "), member_oid=since(16, "oid oid, "), parent=since(13, "tgparentid oid, "),
    )


def find_by_content(folder: str, names: tuple[str, ...], least: int = 2) -> str | None:
    """The file of a folder whose first two pages hold at least `least` of some names; the smallest number wins."""
    files = sorted((int(n), n) for n in os.listdir(folder) if n.isdigit())
    for _, n in files:
        try:
            with open(os.path.join(folder, n), "rb") as f:
                head = f.read(16384)
        except OSError:
            continue
        if sum(name.encode() + b"\0" in head for name in names) >= least:
            return os.path.join(folder, n)
    return None


def _out_of_line(column: ColumnLayout, encoding: str):
    """A function of a stored value, its raw size and its stored size with method: the column's value, unpacked if need be."""

    def unpack(stored, raw_size, info):
        if stored is None:
            return None
        stored = bytes(stored)
        if info & 0x3FFFFFFF < raw_size - 4:  # behind four bytes of size and method
            stored = decompress(stored[4:], raw_size - 4, info >> 30)
        if stored is None or column.kind == "bytea":
            return stored
        return _decoded(stored, encoding) if column.kind in _TEXTS else decode(column.kind, stored)

    return F.udf(unpack, column.spark_type)


class Cluster:
    """A data folder without its server. Everything it gives is a DataFrame; only file names are looked at on the driver."""

    def __init__(self, spark: SparkSession, root: str, database: int | None = None, version: int | None = None) -> None:
        register(spark)
        self.spark, self.root = spark, root
        if version is None:
            with open(os.path.join(root, "PG_VERSION")) as f:
                version = int(re.match(r"\d+", f.read()).group())  # type: ignore[union-attr]
        self.version = version
        known = databases(root)
        if database is None and len(known) > 1:
            database = next((d for d in known if d >= FIRST_USER_OID), known[-1])
        self.database = database if database is not None else known[0]

    def catalog(self, name: str) -> DataFrame:
        """Live rows of a catalog, by hint bits; with the place of each row."""
        path = relation_path(self.root, 0 if name in SHARED else self.database, CATALOG_OIDS[name])
        if not os.path.exists(path):
            found = find_by_content(os.path.dirname(path), WELL_KNOWN[name]) if name in WELL_KNOWN else None
            if found is None:
                raise FileNotFoundError(f"no file of {name} at {path}")
            path = found
        rows = self.spark.read.format("pgheap").option("columns", catalog_layout(name, self.version)).load(path)
        state = visibility(F.col("_infomask"), F.col("_xmax"))
        return rows.where(admitted(state))

    def optional(self, name: str) -> DataFrame:
        """catalog(), or no rows where its file isn't there."""
        try:
            return self.catalog(name)
        except FileNotFoundError:
            return self.spark.createDataFrame([], HeapDataSource({"columns": catalog_layout(name, self.version)}).schema())

    def classes(self) -> DataFrame:
        """Current rows of pg_class. The version at the end of an update chain counts, then the last one in the file."""
        cls = self.optional("pg_class")
        end = ((F.col("_ctid_page") == F.col("_page")) & (F.col("_ctid_item") == F.col("_item"))).cast("int")
        keep = [c for c in cls.columns if not c.startswith("_") and c != "oid"]
        return cls.groupBy("oid").agg(F.max_by(F.struct(*keep), F.struct(end, "_page", "_item")).alias("r")).select("oid", "r.*")

    def namespaces(self) -> DataFrame:
        """Names of schemas: relnamespace, schema_name."""
        return self.optional("pg_namespace").groupBy(F.col("oid").alias("relnamespace")).agg(F.max_by("nspname", F.struct("_page", "_item")).alias("schema_name"))

    def relations(self) -> DataFrame:
        """Current relations: oid, schema_name, relname, relkind, relfilenode, reltablespace, toast_rel_id, toast_filenode,
        relpages, reltuples, relnatts."""
        cls = self.classes()
        names = self.namespaces()
        toast = cls.select(F.col("oid").alias("reltoastrelid"), F.col("relfilenode").alias("toast_filenode"))
        rows = cls.join(names, "relnamespace", "left").join(toast, "reltoastrelid", "left")
        return rows.select("oid", F.coalesce("schema_name", F.lit("public")).alias("schema_name"), "relname", "relkind", "relfilenode", "reltablespace", F.col("reltoastrelid").alias("toast_rel_id"), "toast_filenode", "relpages", "reltuples", "relnatts")

    def columns(self) -> DataFrame:
        """Current columns of all relations: attrelid, attnum, attname, atttypid, attlen, attalign, atttypmod, attnotnull,
        attidentity, attgenerated, attisdropped, type_name. Of several versions the one that isn't dropped, then the highest xmin, then the last."""
        att = self.optional("pg_attribute").where("attnum > 0")
        keep = ["attname", "atttypid", "attlen", "attalign", "atttypmod", "attnotnull", "attidentity", "attgenerated", "attisdropped"]
        best = F.struct((~F.col("attisdropped")).cast("int"), "_xmin", "_page", "_item")
        att = att.groupBy("attrelid", "attnum").agg(F.max_by(F.struct(*keep), best).alias("r")).select("attrelid", "attnum", "r.*")
        builtin = F.create_map(*[F.lit(x) for pair in OIDS.items() for x in pair])
        return att.withColumn("type_name", builtin[F.col("atttypid").cast("int")])

    def partitions(self) -> DataFrame:
        """Links of relations to their parents, both of which exist: id, parent, seqno, bound."""
        links = self.optional("pg_inherits").select(F.col("inhrelid").alias("id"), F.col("inhparent").alias("parent"), F.col("inhseqno").alias("seqno"))
        classes = self.classes().select("oid", "relpartbound")
        here = links.join(classes.select(F.col("oid").alias("id"), F.col("relpartbound").alias("bound")), "id")
        return here.join(classes.select(F.col("oid").alias("parent")), "parent", "left_semi").select("id", "parent", "seqno", "bound")

    def leaves(self, name: str) -> list[str]:
        """The tables that hold the rows of a partitioned one, by name; as many as it has. A plain table is its own leaf."""
        from pagewright.operators.hierarchy import descendants, heavy_paths

        rel = self.find(name)
        if rel["relkind"] != "p":
            return [f"{rel['schema_name']}.{rel['relname']}"]
        tables = self.relations()
        links = tables.select(F.col("oid").alias("id")).join(self.partitions().select("id", "parent"), "id", "left")
        below = descendants(heavy_paths(links), self.spark.createDataFrame([(rel["oid"],)], "id bigint"))
        rows = below.join(tables.where("relkind = 'r'").select(F.col("oid").alias("descendant"), "schema_name", "relname"), "descendant")
        return sorted(f"{r.schema_name}.{r.relname}" for r in rows.collect())

    def leaf_counts(self, name: str) -> DataFrame:
        """Live rows of a partitioned table by leaf, and their total with leaf NULL: leaf, n."""
        parts = [self._live(leaf).select(F.lit(leaf).alias("leaf"), "n") for leaf in self.leaves(name)]
        none = self.spark.createDataFrame([], "leaf string, n bigint")
        each = reduce(DataFrame.unionByName, parts, none)
        return each.unionByName(each.agg(F.lit(None).cast("string").alias("leaf"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))

    def types(self) -> DataFrame:
        """Current rows of pg_type, the last one of each oid."""
        rows = self.optional("pg_type")
        keep = [c for c in rows.columns if not c.startswith("_") and c != "oid"]
        return rows.groupBy("oid").agg(F.max_by(F.struct(*keep), F.struct("_page", "_item")).alias("r")).select("oid", "r.*")

    def type_descriptions(self, oids: list[int]) -> dict[int, str]:
        """What values of user types are decoded with: a built-in type's name, or a description that decode.user_type()
        reads. Domains are followed to their base, arrays to their element, row types to their fields; only types that are
        reached come to the driver, level by level. A type that needs itself, or is unknown, is left to hexadecimal text."""
        known: dict[int, object] = {}
        wanted = {o for o in oids if o not in OIDS}
        types, columns = (self.types(), self.columns()) if wanted else (None, None)
        while wanted:
            some = sorted(wanted)
            for r in types.where(F.col("oid").isin(some)).select("oid", "typtype", "typbasetype", "typelem", "typlen", "typrelid").collect():
                known[r.oid] = r
            rels = [known[o].typrelid for o in some if o in known and known[o].typtype == "c" and known[o].typrelid]
            fields: dict[int, list[int]] = {}
            for r in columns.where(F.col("attrelid").isin(rels) & ~F.col("attisdropped")).orderBy("attrelid", "attnum").select("attrelid", "atttypid").collect() if rels else ():
                fields.setdefault(r.attrelid, []).append(r.atttypid)
            for o in some:
                r = known.get(o)
                if r is not None and r.typtype == "c":
                    known[o] = fields.get(r.typrelid, [])
            needs = {t for o in some if (r := known.get(o)) is not None for t in (r if isinstance(r, list) else (r.typbasetype, r.typelem))}
            wanted = {t for t in needs if t and t not in OIDS and t not in known} - set(some)
        enums = [o for o, r in known.items() if not isinstance(r, list) and r.typtype == "e"]
        labels: dict[int, dict[str, str]] = {}
        for r in self.optional("pg_enum").where(F.col("enumtypid").isin(enums)).select("oid", "enumtypid", "enumlabel").collect() if enums else ():
            labels.setdefault(r.enumtypid, {})[str(r.oid)] = r.enumlabel

        def described(oid: int, above: tuple[int, ...] = ()) -> object:
            if oid in OIDS:
                return OIDS[oid]
            r = known.get(oid)
            if r is None or oid in above:
                return "bytea"
            if isinstance(r, list):
                return {"row": [described(t, (*above, oid)) for t in r]}
            if r.typtype == "e":
                return {"enum": labels.get(oid, {})}
            if r.typtype == "d":
                return described(r.typbasetype, (*above, oid))
            return {"array": described(r.typelem, (*above, oid))} if r.typelem and r.typlen == -1 else "bytea"

        return {o: d if isinstance(d := described(o), str) else json.dumps(d) for o in oids if o not in OIDS}

    def tables(self, system: bool = False) -> DataFrame:
        rows = self.relations()
        return rows if system else rows.where((F.col("oid") >= FIRST_USER_OID) & F.col("relkind").isin("r", "p"))

    def layout(self, oid: int) -> list[ColumnLayout]:
        """The columns of one relation, in order; as many rows as it has columns."""
        rows = self.columns().where(F.col("attrelid") == oid).orderBy("attnum").collect()
        described = self.type_descriptions([r.atttypid for r in rows if not r.attisdropped])
        kind = lambda r: r.type_name or described.get(r.atttypid, "bytea")
        return [ColumnLayout(r.attname, kind(r), r.attlen, ALIGNS.get(r.attalign, 4), r.attisdropped, r.attgenerated == "v") for r in rows]

    def find(self, name: str) -> dict:
        """One relation by `schema.name` or bare name (public first, then the smallest schema)."""
        schema, _, bare = name.rpartition(".")
        rows = self.relations().where(F.col("relname") == bare)
        if schema:
            rows = rows.where(F.col("schema_name") == schema)
        found = rows.orderBy(F.col("schema_name") != "public", "schema_name", "oid").limit(1).collect()
        if not found:
            raise LookupError(f"no relation {name}")
        return found[0].asDict()

    def read(self, name: str, mode: str = "live", select: list[str] | None = None, clog: DataFrame | None = None, toast_state: bool = False, place: bool = False, **options: str) -> DataFrame:
        """Rows of a table: decoded columns without headers; mode live, all or deleted (the last two add `_state`). place adds
        `_page` and `_item`.

        Out-of-line values are joined with their pieces. One that can't be had whole is NULL; toast_state adds
        `_toast_state`, a map of those columns and their states (missing, gap, short, conflict, broken), NULL where all is well.
        """
        rel = self.find(name)
        columns = self.layout(rel["oid"])
        path = relation_path(self.root, self.database, rel["relfilenode"], rel["reltablespace"])
        reader = self.spark.read.format("pgheap").option("columns", dump_columns(columns)).option("toast", "full")
        if select:
            reader = reader.option("select", ",".join(select))
        rows = reader.options(**options).load(path)
        state: Column = visibility(F.col("_infomask"), F.col("_xmax"))
        if clog is not None:
            from pagewright.operators.changefeed import with_status

            rows = with_status(rows, F.col("_xmin"), F.lit(True), clog, "in_status_")
            rows = with_status(rows, F.col("_xmax"), F.col("_xmax") != 0, clog, "out_status_")
            state = visibility(F.col("_infomask"), F.col("_xmax"), F.col("in_status_"), F.col("out_status_"), F.col("_xmin"))
        rows = rows.withColumn("_state", state).where(admitted(F.col("_state"), mode))
        names = {c.name for c in columns if not c.dropped}
        shown = [c for c in rows.columns if c in names]
        rows, states = self._with_toast(rows, name, rel, [c for c in columns if f"{c.name}__toast" in rows.columns], mode, options)
        pairs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c, _ in states]), F.array(*[s for _, s in states])), lambda _, v: v.isNotNull()) if states else F.create_map().cast("map<string,string>")
        state_map = F.when(F.size(pairs) > 0, pairs).alias("_toast_state")
        return rows.select(*shown, *(["_page", "_item"] if place else []), *([] if mode == "live" else ["_state"]), *([state_map] if toast_state else []))

    def _with_toast(self, rows: DataFrame, name: str, rel: dict, columns: list[ColumnLayout], mode: str, options: dict[str, str]) -> tuple[DataFrame, list[tuple[str, Column]]]:
        """Rows with out-of-line values in place, and the state of each column that has any (NULL where whole)."""
        from pagewright.operators.toast import resolve_pointers

        if not columns:
            return rows, []
        # one row tells which columns have pointers, so that the others need no join
        used = rows.agg(*[F.max(F.col(f"`{c.name}__toast`").isNotNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        columns = [c for c, there in zip(columns, used or ()) if there]
        if not columns:
            return rows, []
        if rel["toast_filenode"]:
            values = self.toast_values(name, mode, **{k: v for k, v in options.items() if k.lower() in ("pagesize", "pagetransform")})
        else:
            values = self.spark.createDataFrame([], "chunk_id bigint, value binary, state string")
        states = []
        for i, c in enumerate(columns):
            pointer, raw, info = (f"{c.name}__toast{x}" for x in ("", "_raw", "_info"))
            stored = F.col(f"`{info}`").bitwiseAND(0x3FFFFFFF)
            rows = resolve_pointers(rows, pointer, values, "chunk_id", stored)
            text = _out_of_line(c, options.get("encoding", "utf-8"))(F.col("value"), F.col(f"`{raw}`"), F.col(f"`{info}`"))
            rows = rows.withColumn("value_", text)
            broken = (F.col("toast_state") == "ok") & F.col("value_").isNull()
            rows = rows.withColumn(f"state_{i}_", F.when(broken, "broken").when(F.col("toast_state") != "ok", F.col("toast_state")))
            rows = rows.withColumn(c.name, F.when(F.col(f"`{pointer}`").isNotNull(), F.col("value_")).otherwise(F.col(f"`{c.name}`"))).drop("value", "value_", "toast_state")
            states.append((c.name, F.col(f"state_{i}_")))
        return rows, states

    def toast_values(self, name: str, mode: str = "live", **options: str) -> DataFrame:
        """Whole out-of-line values of a table: chunk_id, value, n_chunks, state. As stored: compressed ones aren't unpacked.
        Dead rows need the dead pieces as well: all pieces count unless mode is live."""
        from pagewright.operators.toast import reassemble

        rel = self.find(name)
        path = relation_path(self.root, self.database, rel["toast_filenode"], rel["reltablespace"])
        chunks = self.spark.read.format("pgheap").option("columns", "chunk_id oid, chunk_seq int4, chunk_data bytea").options(**options).load(path)
        chunks = chunks.where(admitted(visibility(F.col("_infomask"), F.col("_xmax")), "live" if mode == "live" else "all"))
        return reassemble(chunks.select("chunk_id", "chunk_seq", "chunk_data"), "chunk_id", "chunk_seq", "chunk_data")

    def count(self, name: str) -> int:
        """Number of live rows; no column is decoded."""
        return self._live(name).first().n

    def _live(self, name: str) -> DataFrame:
        """One row: n, the number of live rows."""
        rel = self.find(name)
        path = relation_path(self.root, self.database, rel["relfilenode"], rel["reltablespace"])
        return self.spark.read.format("pgheap").options(count="true", visibility="live").load(path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def commit_log(self) -> DataFrame:
        """Statuses of the commit log; xids from the control file's next one on have none."""
        control = None
        place = os.path.join(self.root, "global", "pg_control")
        if os.path.exists(place):
            with open(place, "rb") as f:
                control = parse_control(f.read(8192))
        reader = self.spark.read.format("pgclog")
        if control is not None and control.next_xid:
            reader = reader.option("nextXid", str(control.next_xid))
        return reader.load(os.path.join(self.root, "pg_xact"))

    def encoding(self) -> str:
        """The codec of the database's encoding by pg_database; utf-8 where that isn't known."""
        try:
            found = self.catalog("pg_database").where(F.col("oid") == self.database).select("encoding").limit(1).collect()
        except FileNotFoundError:
            return "utf-8"
        return ENCODINGS.get(found[0].encoding, "utf-8") if found else "utf-8"

    def pages(self, name: str) -> DataFrame:
        """State of every page of a table, and of what is missing of its files; see `pgpages`."""
        rel = self.find(name)
        return self.spark.read.format("pgpages").load(relation_path(self.root, self.database, rel["relfilenode"], rel["reltablespace"]))

    def ddl(self, name: str) -> list[str]:
        """The statements that make a relation: table with defaults, keys and checks, comments, indexes; in order."""
        from pagewright.sources.schema import relation_statements

        rel = self.find(name)
        rows = relation_statements(self).where(F.col("oid") == rel["oid"]).orderBy("step", "name")
        return [r.statement for r in rows.collect()]

    def sequence_states(self) -> DataFrame:
        """Where each sequence stands, from its own file: oid, last_value, is_called. The paths come to the driver, one for
        each sequence; the files are read on the executors."""
        own = self.relations().where("relkind = 'S'").select("oid", "relfilenode", "reltablespace").collect()
        paths = [(r.oid, relation_path(self.root, self.database, r.relfilenode, r.reltablespace)) for r in own]

        def read(batches):
            import pandas as pd

            columns = parse_columns("last_value int8, log_cnt int8, is_called bool")
            for batch in batches:
                out = []
                for oid, path in zip(batch["oid"], batch["path"]):
                    try:
                        with open(path, "rb") as f:
                            t = standard_tuples(f.read(8192), 8192, 0)
                    except OSError:
                        continue
                    if len(t):
                        values = decode_columns(t, columns, {"last_value", "is_called"})[0]
                        out.append((oid, values["last_value"][0].as_py(), values["is_called"][0].as_py()))
                yield pd.DataFrame(out, columns=["oid", "last_value", "is_called"])

        if not paths:
            return self.spark.createDataFrame([], "oid bigint, last_value bigint, is_called boolean")
        return self.spark.createDataFrame(paths, "oid bigint, path string").mapInPandas(read, "oid bigint, last_value bigint, is_called boolean")

    def roles(self) -> DataFrame:
        return self.catalog("pg_authid").select("oid", "rolname", "rolsuper", "rolinherit", "rolcreaterole", "rolcreatedb", "rolcanlogin", "rolreplication", "rolbypassrls", "rolconnlimit", "rolpassword", "rolvaliduntil")

    def large_objects(self, oids: list[int] | None = None, page_size: int = 2048) -> DataFrame:
        """Large objects with data or metadata: loid, value, size, state, owner, presence, owner_name (NULL where the role isn't
        known)."""
        from pagewright.operators.toast import large_objects, with_owners

        pages = self.catalog("pg_largeobject").select("loid", "pageno", "data")
        meta = self.catalog("pg_largeobject_metadata").select(F.col("oid").alias("loid"), F.col("lomowner").alias("owner"))
        if oids:
            pages, meta = pages.where(F.col("loid").isin(oids)), meta.where(F.col("loid").isin(oids))
        names = self.optional("pg_authid").groupBy(F.col("oid").alias("owner")).agg(F.max_by("rolname", F.struct("_page", "_item")).alias("owner_name"))
        return with_owners(large_objects(pages, page_size), meta, "loid").join(names, "owner", "left")


def export_meta(cluster: Cluster) -> DataFrame:
    """The catalog as JSON lines, one relation each, that load_meta() reads."""
    cols = cluster.columns().groupBy("attrelid").agg(F.sort_array(F.collect_list(F.struct("attnum", "attname", "atttypid", "attlen", "attalign", "atttypmod", "attnotnull", "attisdropped"))).alias("columns"))
    rows = cluster.tables().join(cols, F.col("oid") == F.col("attrelid")).drop("attrelid")
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    kinds = "oid bigint, schema_name string, relname string, relkind string, relfilenode bigint, reltablespace bigint, toast_rel_id bigint, toast_filenode bigint, relpages int, reltuples float, relnatts int, columns array<struct<attnum:int,attname:string,atttypid:bigint,attlen:int,attalign:string,atttypmod:int,attnotnull:boolean,attisdropped:boolean>>"
    return spark.read.schema(kinds).json(path)
