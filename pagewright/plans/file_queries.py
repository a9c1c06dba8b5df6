"""Queries that go from files to results: clusters, heap files, commit logs and out-of-line values written from the tables and
read again by the sources, each beside its SQL."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from pagewright.operators import toast, visibility
from pagewright.plans.fixture import Folder, catalog_cluster
from pagewright.plans.lineage import materialize, release
from pagewright.plans.position import with_number
from pagewright.plans.registry import _CC, _CM, _CT, query, table

_NAMES = ("table_meta", "attr_row", "type_def", "builtin_type", "constr_row", "index_row")


def _cluster(spark, folder, *names):
    return catalog_cluster(spark, {n: table(spark, folder, n) for n in _NAMES}, names)


def _q(c: str) -> str:
    """SQL of a quoted identifier."""
    return f"CASE WHEN regexp_full_match({c}, '[a-z_][a-z0-9_$]*') THEN {c} ELSE '\"' || replace({c}, '\"', '\"\"') || '\"' END"


_USER = f"{_CM}, ut AS (SELECT oid, coalesce(schema_name, 'public') s, coalesce(relname, '') n, relkind, part_parent, {_q("coalesce(schema_name, 'public')")} || '.' || {_q("coalesce(relname, '')")} AS full_name FROM cm WHERE oid >= 16384)"

# ---- catalogs ----


@query(f"WITH {_CM} SELECT c.oid, coalesce(c.schema_name, 'public') AS schema_name, coalesce(c.relname, '') AS relname, c.relkind, coalesce(c.relfilenode, 0) AS relfilenode, coalesce(c.toast_rel_id, 0) AS toast_rel_id, CASE WHEN t.oid IS NOT NULL THEN coalesce(t.relfilenode, 0) END AS toast_filenode FROM cm c LEFT JOIN cm t ON t.oid = coalesce(c.toast_rel_id, 0)")
def cluster_relations(spark, folder):
    """pg_class and pg_namespace from their files, dead versions left out, joined with the out-of-line tables."""
    rows = _cluster(spark, folder, "pg_class", "pg_namespace").relations().where("relkind <> 'i'")
    return rows.select("oid", "schema_name", "relname", "relkind", "relfilenode", "toast_rel_id", "toast_filenode")


@query(f"WITH {_CC} SELECT attrelid, CAST(attnum AS INTEGER) AS attnum, coalesce(attname, '') AS attname, coalesce(atttypid, 0) AS atttypid, coalesce(attisdropped, false) AS attisdropped, b.typname AS type_name FROM cc LEFT JOIN builtin_type b ON b.oid = cc.atttypid")
def cluster_columns(spark, folder):
    """pg_attribute from its file, with names of types."""
    cluster = _cluster(spark, folder, "pg_attribute", "pg_type")
    names = cluster.types().where("oid < 16384").select(F.col("oid").alias("atttypid"), F.col("typname"))
    rows = cluster.columns().join(names, "atttypid", "left")
    return rows.select("attrelid", F.col("attnum").cast("int").alias("attnum"), "attname", "atttypid", "attisdropped", F.col("typname").alias("type_name"))


@query(f"WITH {_CM} SELECT oid AS id, part_parent AS parent FROM cm WHERE part_parent <> 0 AND part_parent IN (SELECT oid FROM cm)")
def cluster_partitions(spark, folder):
    """pg_inherits joined with pg_class on both ends."""
    return _cluster(spark, folder, "pg_class", "pg_inherits").partitions().select("id", "parent")


@query(f"WITH {_CT} SELECT oid, coalesce(typname, '') AS typname, coalesce(typtype, '') AS typtype, coalesce(elem, 0) AS elem, coalesce(base, 0) AS base FROM ct UNION ALL SELECT oid, typname, 'b', coalesce(elem, 0), coalesce(base, 0) FROM builtin_type")
def cluster_types(spark, folder):
    rows = _cluster(spark, folder, "pg_type").types()
    return rows.select("oid", "typname", "typtype", F.col("typelem").alias("elem"), F.col("typbasetype").alias("base"))


# ---- statements ----

_TYPE = "CASE atttypid WHEN 23 THEN 'integer' WHEN 25 THEN 'text' WHEN 1043 THEN 'character varying(' || (atttypmod - 4) || ')' WHEN 1082 THEN 'date' WHEN 1114 THEN 'timestamp without time zone' WHEN 1184 THEN 'timestamp with time zone' WHEN 16 THEN 'boolean' WHEN 701 THEN 'double precision' WHEN 2950 THEN 'uuid' WHEN 20 THEN 'bigint' WHEN 1700 THEN 'numeric(' || ((atttypmod - 4) // 65536) || ',' || ((atttypmod - 4) % 65536) || ')' WHEN 3802 THEN 'jsonb' WHEN 27 THEN 'tid' WHEN 21 THEN 'smallint' WHEN 28 THEN 'xid' END"
_LIVE = f"lc AS (SELECT attrelid, attnum, attname, {_q('attname')} q, {_q('attname')} || ' ' || {_TYPE} || CASE WHEN attnotnull THEN ' NOT NULL' ELSE '' END line FROM cc WHERE NOT coalesce(attisdropped, false))"
_ONE_CONSTRAINT = "k AS (SELECT * FROM (SELECT DISTINCT con_oid, conname, contype, conrelid, conkey, confrelid, confkey, validated FROM constr_row WHERE con_oid IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY con_oid) = 1)"
_ONE_INDEX = "ix AS (SELECT * FROM (SELECT DISTINCT ind_index_rel_id, ind_rel_id, ind_is_primary, ind_is_unique, ind_key, ind_nkeyatts FROM index_row) QUALIFY row_number() OVER (PARTITION BY ind_index_rel_id) = 1)"


@query(f"""WITH {_USER}, {_CC}, {_LIVE}, {_ONE_CONSTRAINT}, {_ONE_INDEX},
pc AS (SELECT conrelid, conkey keys FROM k WHERE contype = 'p' AND conkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conrelid ORDER BY len(conkey) DESC, con_oid) = 1),
pi AS (SELECT ind_rel_id, list_slice(ind_key, 1, CASE WHEN coalesce(ind_nkeyatts, 0) > 0 THEN ind_nkeyatts ELSE len(ind_key) END) keys FROM ix WHERE ind_is_primary QUALIFY row_number() OVER (PARTITION BY ind_rel_id ORDER BY len(keys) DESC, ind_index_rel_id) = 1),
pk AS (SELECT ut.oid, CASE WHEN len(pc.keys) > 0 THEN pc.keys ELSE pi.keys END keys FROM ut LEFT JOIN pc ON pc.conrelid = ut.oid LEFT JOIN pi ON pi.ind_rel_id = ut.oid),
pn AS (SELECT u.oid, 'PRIMARY KEY (' || string_agg(lc.q, ', ' ORDER BY pos) || ')' line FROM (SELECT oid, unnest(keys) a, generate_subscripts(keys, 1) pos FROM pk) u JOIN lc ON lc.attrelid = u.oid AND lc.attnum = u.a GROUP BY u.oid),
body AS (SELECT attrelid oid, string_agg(line, ',' || chr(10) || '    ' ORDER BY attnum) b FROM lc GROUP BY 1),
notes AS (SELECT conrelid oid, string_agg('-- CHECK ' || conname || ' can''t be written as SQL' || chr(10), '' ORDER BY conname) n FROM k WHERE contype = 'c' GROUP BY 1)
SELECT ut.oid, CASE WHEN up.oid IS NOT NULL THEN 'CREATE TABLE ' || ut.full_name || ' PARTITION OF ' || up.full_name || ' DEFAULT;'
 ELSE coalesce(notes.n, '') || 'CREATE TABLE ' || ut.full_name || ' (' || chr(10) || '    ' || concat_ws(',' || chr(10) || '    ', body.b, pn.line) || chr(10) || ');' END AS statement
FROM ut LEFT JOIN ut up ON up.oid = ut.part_parent AND ut.part_parent <> 0 LEFT JOIN body ON body.oid = ut.oid LEFT JOIN pn ON pn.oid = ut.oid LEFT JOIN notes ON notes.oid = ut.oid WHERE ut.relkind IN ('r', 'p')""")
def cluster_table_ddl(spark, folder):
    """CREATE TABLE of every table from pg_class, pg_attribute, pg_type, pg_constraint, pg_index and pg_inherits."""
    from pagewright.sources import schema

    cluster = _cluster(spark, folder, "pg_class", "pg_namespace", "pg_attribute", "pg_type", "pg_constraint", "pg_index", "pg_inherits")
    rows = schema.table_statements(cluster)
    return rows.where(F.col("step").isin(schema.TABLE, schema.PARTITION)).select("oid", "statement")


@query(f"""WITH {_USER}, {_CC}, {_LIVE}, {_ONE_CONSTRAINT}, e AS (SELECT con_oid, conname, contype, conrelid, confrelid, validated, conkey, confkey FROM k WHERE contype IN ('u', 'f')),
a AS (SELECT con_oid, string_agg(q, ', ' ORDER BY pos) cols, bool_and(q IS NOT NULL) complete FROM (SELECT con_oid, conrelid r, unnest(conkey) n, generate_subscripts(conkey, 1) pos FROM e) LEFT JOIN lc ON attrelid = r AND attnum = n GROUP BY 1),
b AS (SELECT con_oid, string_agg(q, ', ' ORDER BY pos) cols, bool_and(q IS NOT NULL) complete FROM (SELECT con_oid, confrelid r, unnest(confkey) n, generate_subscripts(confkey, 1) pos FROM e) LEFT JOIN lc ON attrelid = r AND attnum = n GROUP BY 1)
SELECT e.con_oid, CASE WHEN contype = 'u' AND a.complete THEN 'ALTER TABLE ' || t.full_name || ' ADD CONSTRAINT ' || {_q('conname')} || ' UNIQUE (' || a.cols || ');'
 WHEN contype = 'f' AND a.complete AND coalesce(b.complete, true) AND x.n <> '' THEN 'ALTER TABLE ' || t.full_name || ' ADD CONSTRAINT ' || {_q('conname')} || ' FOREIGN KEY (' || a.cols || ') REFERENCES ' || x.full_name || ' (' || coalesce(b.cols, '') || ')' || CASE WHEN coalesce(validated, true) THEN '' ELSE ' NOT VALID' END || ';'
 ELSE '-- constraint ' || conname || ' on ' || t.full_name || ' can''t be written as SQL' END AS statement
FROM e JOIN ut t ON t.oid = e.conrelid LEFT JOIN ut x ON x.oid = e.confrelid LEFT JOIN a ON a.con_oid = e.con_oid LEFT JOIN b ON b.con_oid = e.con_oid WHERE EXISTS (SELECT 1 FROM cc WHERE cc.attrelid = e.conrelid)""")
def cluster_key_ddl(spark, folder):
    """Unique constraints and foreign keys as ALTER TABLE."""
    from pagewright.sources import schema

    rows = schema.key_statements(_cluster(spark, folder, "pg_class", "pg_namespace", "pg_attribute", "pg_type", "pg_constraint"))
    return rows.select(F.element_at(F.split("name", " "), -1).cast("bigint").alias("con_oid"), "statement")


@query(f"""WITH {_USER}, {_CC}, {_LIVE}, {_ONE_INDEX}, e AS (SELECT * FROM ix WHERE NOT coalesce(ind_is_primary, false) AND ind_index_rel_id NOT IN (SELECT oid FROM table_meta WHERE oid IS NOT NULL)),
p AS (SELECT ind_index_rel_id i, pos, q, CASE WHEN coalesce(nk, 0) > 0 THEN nk ELSE n END nk FROM (SELECT ind_index_rel_id, ind_rel_id r, ind_nkeyatts nk, len(ind_key) n, unnest(ind_key) a, generate_subscripts(ind_key, 1) pos FROM e) LEFT JOIN lc ON attrelid = r AND attnum = a),
g AS (SELECT i, bool_and(q IS NOT NULL) complete, string_agg(q, ', ' ORDER BY pos) FILTER (pos <= nk) keys, string_agg(q, ', ' ORDER BY pos) FILTER (pos > nk) inc FROM p GROUP BY 1)
SELECT ind_index_rel_id AS index_oid, CASE WHEN coalesce(g.complete, true) THEN 'CREATE ' || CASE WHEN ind_is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX ix_' || ind_index_rel_id || ' ON ' || t.full_name || ' USING btree (' || coalesce(g.keys, '') || ')' || coalesce(' INCLUDE (' || g.inc || ')', '') || ';'
 ELSE '-- index ix_' || ind_index_rel_id || ' on ' || t.full_name || ' can''t be written as SQL' END AS statement
FROM e JOIN ut t ON t.oid = e.ind_rel_id LEFT JOIN g ON g.i = e.ind_index_rel_id WHERE EXISTS (SELECT 1 FROM cc WHERE cc.attrelid = e.ind_rel_id)""")
def cluster_index_ddl(spark, folder):
    """CREATE INDEX of all indexes but primary ones."""
    from pagewright.sources import schema

    rows = schema.index_statements(_cluster(spark, folder, "pg_class", "pg_namespace", "pg_attribute", "pg_type", "pg_index"))
    return rows.select(F.regexp_extract("name", "ix_([0-9]+)$", 1).cast("bigint").alias("index_oid"), "statement")


@query(f"WITH {_CM} SELECT DISTINCT 'CREATE SCHEMA IF NOT EXISTS ' || {_q('schema_name')} || ';' AS statement FROM cm WHERE schema_name NOT IN ('pg_catalog', 'pg_toast', 'information_schema', 'public') AND NOT starts_with(schema_name, 'pg_temp_') AND NOT starts_with(schema_name, 'pg_toast_temp_')")
def cluster_schema_ddl(spark, folder):
    from pagewright.sources import schema

    return schema.schema_statements(_cluster(spark, folder, "pg_namespace")).select("statement")


@query(f"WITH {_CT} SELECT oid, 'CREATE TYPE public.' || {_q('typname')} || ' AS ENUM (''low'', ''it''''s ' || oid || ''', ''high'');' AS statement FROM ct WHERE typtype = 'e' AND oid >= 16384")
def cluster_enum_ddl(spark, folder):
    """CREATE TYPE of enums, with three labels each, stored out of order."""
    from pagewright.sources import schema

    out = _cluster(spark, folder, "pg_type")
    made = out.types().where("typtype = 'e' and oid >= 16384").select(F.col("oid").alias("enumtypid"), F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("k"))
    label = F.when(F.col("k") == 1, "low").when(F.col("k") == 2, F.concat(F.lit("it's "), F.col("enumtypid").cast("string"))).otherwise("high")
    _more(out, "pg_enum", made.select((F.col("enumtypid") * 4 % 2_000_000_000 + F.col("k")).alias("oid"), "enumtypid", F.col("k").cast("float").alias("enumsortorder"), label.alias("enumlabel")))
    return schema.type_statements(out).where("statement like '% AS ENUM %'").select("oid", "statement")


def _more(cluster, name, df, shared: bool = False):
    """Another catalog beside those that a cluster has."""
    from pagewright.sources.bootstrap import CATALOG_OIDS, catalog_layout
    from pagewright.sources.pagewriter import write_relation

    write_relation(df, f"{cluster.root}/{'global' if shared else f'base/{cluster.database}'}/{CATALOG_OIDS[name]}", catalog_layout(name, cluster.version))


_FLAGS = "'NOSUPERUSER INHERIT NOCREATEROLE ' || CASE WHEN n_regionkey = 1 THEN 'CREATEDB' ELSE 'NOCREATEDB' END || ' LOGIN NOREPLICATION NOBYPASSRLS'"


@query(f"""SELECT 0 AS step, 'DO $pw$ BEGIN' || chr(10) || '  CREATE ROLE "' || n_name || '" WITH ' || {_FLAGS} || ';' || chr(10) || 'EXCEPTION WHEN duplicate_object THEN NULL;' || chr(10) || 'END $pw$;' AS statement FROM nation
UNION ALL SELECT 0, 'DO $pw$ BEGIN' || chr(10) || '  CREATE ROLE "' || r_name || '" WITH NOSUPERUSER INHERIT NOCREATEROLE NOCREATEDB NOLOGIN NOREPLICATION NOBYPASSRLS;' || chr(10) || 'EXCEPTION WHEN duplicate_object THEN NULL;' || chr(10) || 'END $pw$;' FROM region
UNION ALL SELECT 1, 'GRANT "' || r_name || '" TO "' || n_name || '"' || CASE WHEN n_nationkey < 5 THEN ' WITH ADMIN OPTION' ELSE '' END || ';' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def cluster_role_ddl(spark, folder):
    """Nations as login roles, regions as groups: CREATE ROLE and GRANT from pg_authid and pg_auth_members."""
    from pagewright.sources import schema

    nation, region, out = table(spark, folder, "nation"), table(spark, folder, "region"), Folder(spark)
    oid = lambda c, base: (F.col(c) + base).cast("bigint")
    flags = lambda login, createdb: (F.lit(True).alias("rolinherit"), createdb.alias("rolcreatedb"), F.lit(login).alias("rolcanlogin"), F.lit(-1).alias("rolconnlimit"))
    users = nation.select(oid("n_nationkey", 20_000).alias("oid"), F.col("n_name").alias("rolname"), *flags(True, F.col("n_regionkey") == 1))
    groups = region.select(oid("r_regionkey", 30_000).alias("oid"), F.col("r_name").alias("rolname"), *flags(False, F.lit(False)))
    boss = spark.range(1).select(F.lit(10).cast("bigint").alias("oid"), F.lit("pg_boss").alias("rolname"), *flags(True, F.lit(True)))
    out.put_shared("pg_authid", users.unionByName(groups).unionByName(boss))
    out.put_shared("pg_auth_members", nation.select(oid("n_nationkey", 1).alias("oid"), oid("n_regionkey", 30_000).alias("roleid"), oid("n_nationkey", 20_000).alias("member"), (F.col("n_nationkey") < 5).alias("admin_option")))
    return schema.role_statements(out.cluster()).select("step", "statement")


@query("""SELECT 20000 + n_nationkey AS oid, 0 AS part, 'CREATE SEQUENCE public."' || n_name || '" AS bigint INCREMENT BY ' || (n_regionkey + 1) || ' MINVALUE 1 MAXVALUE 9223372036854775807 START WITH ' || (n_nationkey + 1) || ' CACHE 1' || CASE WHEN n_regionkey = 2 THEN ' CYCLE' ELSE '' END || ';' AS statement FROM nation
UNION ALL SELECT 20000 + n_nationkey, 1, 'SELECT setval(''public."' || n_name || '"'', ' || (CAST(n_nationkey AS BIGINT) * 1000000007) || ', ' || CASE WHEN n_nationkey = 0 THEN 'false' ELSE 'true' END || ');' FROM nation""")
def cluster_sequence_ddl(spark, folder):
    """CREATE SEQUENCE and setval from pg_class, pg_sequence and the sequences' own files."""
    from pagewright.sources import schema

    nation, out = table(spark, folder, "nation"), Folder(spark)
    oid = (F.col("n_nationkey") + 20_000).cast("bigint")
    out.put("pg_class", nation.select(oid.alias("oid"), F.col("n_name").alias("relname"), oid.alias("relfilenode"), F.lit(2200).alias("relnamespace"), F.lit("S").alias("relkind")))
    out.rows("pg_namespace", [{"oid": 2200, "nspname": "public"}])
    out.put("pg_sequence", nation.select(oid.alias("seqrelid"), F.lit(20).alias("seqtypid"), (F.col("n_nationkey") + 1).alias("seqstart"), (F.col("n_regionkey") + 1).alias("seqincrement"), F.lit(2**63 - 1).alias("seqmax"), F.lit(1).alias("seqmin"), F.lit(1).alias("seqcache"), (F.col("n_regionkey") == 2).alias("seqcycle")))
    for r in nation.collect():  # one file for each of 25 sequences
        state = spark.createDataFrame([(r.n_nationkey * 1_000_000_007, 0, r.n_nationkey > 0)], "last_value bigint, log_cnt bigint, is_called boolean")
        out.table(20_000 + r.n_nationkey, state, "last_value int8, log_cnt int8, is_called bool", parts=1)
    cluster = out.cluster()
    rows = schema.sequence_statements(cluster, cluster.sequence_states())
    return rows.select("oid", F.element_at(F.split("name", " "), -1).cast("int").alias("part"), "statement")


# ---- rows ----


def _documents_cluster(spark, folder):
    """documents as a table whose long texts lie out of line, in pieces of 1996 bytes, plain, as PGLZ or as LZ4 by turns. The
    id of an out-of-line value has four bytes and doc_id eight: values are numbered."""
    from pagewright.sources.pagewriter import lz4_compress, pglz_compress, pointer

    out = Folder(spark)
    out.rows("pg_namespace", [{"oid": 2200, "nspname": "public"}, {"oid": 99, "nspname": "pg_toast"}])
    out.rows("pg_class", [{"oid": 16400, "relname": "documents", "relnamespace": 2200, "relfilenode": 16401, "relkind": "r", "reltoastrelid": 16402, "relnatts": 3}, {"oid": 16402, "relname": "pg_toast_16400", "relnamespace": 99, "relfilenode": 16403, "relkind": "t", "reltoastrelid": 0, "relnatts": 3}])
    out.rows("pg_attribute", [{"attrelid": 16400, "attname": n, "attnum": i, "atttypid": t, "attlen": size, "attalign": a, "atttypmod": -1} for i, (n, t, size, a) in enumerate((("doc_id", 20, 8, "d"), ("text", 25, -1, "i"), ("lang", 25, -1, "i")), 1)])

    def stored(batches):
        import pandas as pd

        for batch in batches:
            texts, framed, chunks = [], [], []
            for i, t in zip(batch["number"].tolist(), batch["text"]):
                raw = None if t is None else t.encode()
                if raw is None or len(raw) <= 2000:
                    texts.append(raw)
                    framed.append(False)
                    chunks.append(None)
                    continue
                method = i % 3  # 0 PGLZ, 1 LZ4, 2 plain
                packed = (pglz_compress, lz4_compress)[method](raw) if method < 2 else raw
                kept = struct.pack("<I", len(raw) | method << 30) + packed if method < 2 and len(packed) + 4 < len(raw) else raw
                texts.append(bytes(pointer(i, len(raw) + 4, len(kept), method if kept is not raw else 0, 16402)))
                framed.append(True)
                chunks.append([kept[k : k + 1996] for k in range(0, len(kept), 1996)])
            yield pd.DataFrame({"number": batch["number"], "doc_id": batch["doc_id"], "text": texts, "text__framed": framed, "lang": batch["lang"], "chunks": chunks})

    docs = with_number(table(spark, folder, "documents").select("doc_id", "text", "lang"), "number")
    made = materialize(docs.mapInPandas(stored, "number bigint, doc_id bigint, text binary, text__framed boolean, lang string, chunks array<binary>"))
    release(docs)
    out.table(16401, made.drop("chunks", "number"), "doc_id int8, text text, lang text", spread=False)
    pieces = made.where("chunks is not null").select(F.col("number").alias("chunk_id"), F.posexplode("chunks").alias("chunk_seq", "chunk_data"))
    out.table(16403, pieces, "chunk_id oid, chunk_seq int4, chunk_data bytea", spread=False)
    release(made)
    return out.cluster()


@query("SELECT doc_id, text, lang FROM documents")
def cluster_read_documents(spark, folder):
    """A table with out-of-line values by name: found in the catalogs, pieces joined, unpacked and put in place."""
    return _documents_cluster(spark, folder).read("public.documents").select("doc_id", "text", "lang")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'fulfilled' ELSE 'partly so' END AS status, CAST(o_custkey AS INTEGER) AS customer,
'{' || CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'fulfilled' ELSE '"partly so"' END || ',open}' AS history FROM orders""")
def cluster_user_types(spark, folder):
    """Columns of an enum, a domain over an integer and an array of the enum, resolved through pg_type and pg_enum."""
    from pagewright.functions.varlena import frame

    out = Folder(spark)
    out.rows("pg_namespace", [{"oid": 2200, "nspname": "public"}])
    out.rows("pg_class", [{"oid": 16400, "relname": "orders", "relnamespace": 2200, "relfilenode": 16400, "relkind": "r", "relnatts": 4}])
    kinds = (("o_orderkey", 20, 8, "d"), ("status", 16500, 4, "i"), ("customer", 16502, 4, "i"), ("history", 16501, -1, "i"))
    out.rows("pg_attribute", [{"attrelid": 16400, "attname": n, "attnum": i, "atttypid": t, "attlen": size, "attalign": a, "atttypmod": -1} for i, (n, t, size, a) in enumerate(kinds, 1)])
    out.rows("pg_type", [{"oid": 16500, "typname": "state", "typlen": 4, "typtype": "e", "typelem": 0, "typbasetype": 0}, {"oid": 16501, "typname": "_state", "typlen": -1, "typtype": "b", "typelem": 16500, "typbasetype": 0}, {"oid": 16502, "typname": "customer_no", "typlen": 4, "typtype": "d", "typelem": 0, "typbasetype": 16503}, {"oid": 16503, "typname": "number", "typlen": 4, "typtype": "d", "typelem": 0, "typbasetype": 23}])
    out.rows("pg_enum", [{"oid": 16600 + i, "enumtypid": 16500, "enumsortorder": float(i), "enumlabel": n} for i, n in enumerate(("open", "fulfilled", "partly so"))])

    def arrays(batches):
        for batch in batches:
            batch["history"] = [frame(struct.pack("<iiIiiII", 1, 0, 16500, 2, 1, s, 16600)) for s in batch["status"]]
            batch["history__framed"] = True
            yield batch

    status = F.when(F.col("o_orderstatus") == "O", 16600).when(F.col("o_orderstatus") == "F", 16601).otherwise(16602).cast("bigint")
    rows = table(spark, folder, "orders").select("o_orderkey", status.alias("status"), F.col("o_custkey").cast("int").alias("customer"))
    out.table(16400, rows.mapInPandas(arrays, "o_orderkey bigint, status bigint, customer int, history binary, history__framed boolean"), "o_orderkey int8, status oid, customer int4, history bytea")
    return out.cluster().read("orders")


_LATEST = "l AS (SELECT xid, arg_max(status, (seen_ts, status)) status FROM clog_status WHERE xid IS NOT NULL GROUP BY xid)"
_NEXT = "(SELECT max(xid) - (max(xid) - min(xid)) // 10 FROM clog_status)"


def _commit_log(spark, folder, out):
    """pg_xact and pg_control made from clog_status: the last tenth of xids lies beyond the control file's next one."""
    from pagewright.sources.clog import XIDS_PER_SEGMENT
    from pagewright.sources.pagewriter import clog_segment

    log = visibility.clog_latest(table(spark, folder, "clog_status"))
    root = out.root

    def write(key, rows):
        import pandas as pd

        number = int(rows["segment"].iloc[0])
        with open(f"{root}/pg_xact/{number:04X}", "wb") as f:
            f.write(clog_segment({int(x) % XIDS_PER_SEGMENT: int(s) for x, s in zip(rows["xid"], rows["status"])}))
        return pd.DataFrame({"segment": [number]})

    # a segment holds the statuses of 2^20 xids
    log.withColumn("segment", F.floor(F.col("xid") / XIDS_PER_SEGMENT)).groupBy("segment").applyInPandas(write, "segment bigint").collect()
    following = table(spark, folder, "clog_status").agg((F.max("xid") - F.floor((F.max("xid") - F.min("xid")) / 10)).cast("bigint")).first()[0] or 3
    with open(f"{root}/global/pg_control", "wb") as f:
        f.write(struct.pack("<QIIIxxxxqQQ", 1, 1300, 202307071, 1, 0, 0, 0).ljust(64, b"\0") + struct.pack("<Q", following) + bytes(64))


@query(f"WITH {_LATEST} SELECT xid, CAST(status AS INTEGER) AS status FROM l WHERE xid >= 3 AND xid < {_NEXT} AND status <> 0")
def cluster_commit_log(spark, folder):
    """Statuses read from commit-log segments up to the control file's next xid."""
    out = Folder(spark)
    _commit_log(spark, folder, out)
    return out.cluster().commit_log().where("status <> 0").select("xid", "status")


@query(f"""WITH {_LATEST}, h AS (SELECT feed_seq, coalesce(t_xmin, 0) x, coalesce(t_xmax, 0) y, coalesce(t_infomask, 0) m FROM heap_tuple),
s AS (SELECT feed_seq, x, y, m, CASE WHEN x < {_NEXT} THEN coalesce(i.status, CASE WHEN x <= (SELECT max(xid) FROM l) THEN 0 END) END i, CASE WHEN y < {_NEXT} THEN coalesce(o.status, 0) END o FROM h LEFT JOIN l i ON i.xid = x LEFT JOIN l o ON o.xid = y)
SELECT feed_seq, CASE WHEN m & 512 <> 0 AND m & 256 = 0 THEN 'aborted' WHEN m & 768 = 0 AND x >= 3 AND coalesce(i, 1) IN (0, 2) THEN 'aborted' WHEN m & 2176 <> 0 THEN 'live' WHEN m & 5120 <> 0 THEN 'deleted' WHEN y = 0 THEN 'live' WHEN y < 3 OR o IN (1, 3) THEN 'deleted' WHEN o = 2 THEN 'live' ELSE 'suspected' END AS state FROM s
WHERE state <> 'aborted'""")
def cluster_clog_rows(spark, folder):
    """Tuples of a heap file judged by hint bits and by the statuses of commit-log files, up to the next xid."""
    out = Folder(spark)
    _commit_log(spark, folder, out)
    out.rows("pg_namespace", [{"oid": 2200, "nspname": "public"}])
    out.rows("pg_class", [{"oid": 16400, "relname": "feed", "relnamespace": 2200, "relfilenode": 16400, "relkind": "r", "relnatts": 1}])
    out.rows("pg_attribute", [{"attrelid": 16400, "attname": "feed_seq", "attnum": 1, "atttypid": 20, "attlen": 8, "attalign": "d", "atttypmod": -1}])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rows = table(spark, folder, "heap_tuple").select("feed_seq", n("t_xmin").alias("_xmin"), n("t_xmax").alias("_xmax"), n("t_infomask").alias("_infomask"))
    out.table(16400, rows, "feed_seq int8")
    cluster = out.cluster()
    return cluster.read("feed", "all", clog=cluster.commit_log()).select("feed_seq", F.col("_state").alias("state"))


@query("""SELECT CASE p_partkey % 5 WHEN 0 THEN 'zero page' WHEN 1 THEN 'bad header' WHEN 2 THEN 'other page size' ELSE 'ok' END AS state, count(*) AS n_pages, CAST(count(*) FILTER (p_partkey % 5 > 2) AS BIGINT) AS n_tuples FROM part GROUP BY 1
UNION ALL SELECT 'segment behind a gap', 1, 0 UNION ALL SELECT 'segment not full', 3, 0""")
def heap_page_states(spark, folder):
    """Pages of four segments, three of five of them damaged, and a fifth segment behind a gap."""
    from pagewright.sources.heap import register
    from pagewright.sources.layout import parse_columns
    from pagewright.sources.pagewriter import make_page, make_tuple

    out = Folder(spark)
    path, layout = f"{out.root}/base/16384/16400", parse_columns("p_partkey int8")

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        with open(f"{path}.{number}" if number else path, "wb") as f:
            for batch in batches:
                for key in batch["p_partkey"].tolist():
                    page = bytearray(make_page([make_tuple(layout, [key])]))
                    if key % 5 == 0:
                        page = bytearray(len(page))
                    elif key % 5 == 1:
                        page[12:14] = b"\xff\xff"
                    elif key % 5 == 2:
                        page[18:20] = struct.pack("<H", 16384 | 4)
                    f.write(page)
        yield pd.DataFrame({"n": [number]})

    table(spark, folder, "part").select(F.col("p_partkey").cast("bigint")).repartition(4).mapInPandas(write, "n int").collect()
    with open(f"{path}.6", "wb") as f:
        f.write(make_page([make_tuple(layout, [0])]))
    register(spark)
    rows = spark.read.format("pgpages").option("pageSize", "8192").load(path)
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_tuples").cast("bigint").alias("n_tuples"))


@query("SELECT 'public.events_' || event_type AS leaf, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events")
def cluster_leaf_counts(spark, folder):
    """Rows of a partitioned table over two levels, by leaf and in all."""
    out = Folder(spark)
    events = table(spark, folder, "events").select("event_id", "event_type")
    kinds = sorted(r.event_type for r in events.select("event_type").distinct().collect())  # a few
    out.rows("pg_namespace", [{"oid": 2200, "nspname": "public"}])
    one = {"relnamespace": 2200, "relnatts": 1}
    out.rows("pg_class", [{"oid": 16400, "relname": "events", "relfilenode": 0, "relkind": "p", **one}, {"oid": 16401, "relname": "events_mid", "relfilenode": 0, "relkind": "p", **one}, *[{"oid": 16410 + i, "relname": f"events_{k}", "relfilenode": 16410 + i, "relkind": "r", **one} for i, k in enumerate(kinds)]])
    out.rows("pg_inherits", [{"inhrelid": 16401, "inhparent": 16400, "inhseqno": 1}, *[{"inhrelid": 16410 + i, "inhparent": 16401 if i % 2 else 16400, "inhseqno": 1} for i, _ in enumerate(kinds)]])
    for i, k in enumerate(kinds):
        out.table(16410 + i, events.where(F.col("event_type") == k).select("event_id"), "event_id int8")
    return out.cluster().leaf_counts("events")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'infinity' WHEN 'P' THEN '-infinity' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def heap_infinite_dates(spark, folder):
    """Dates with both infinities, read as text."""
    from pagewright.sources.heap import register

    out = Folder(spark)
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date"))
    day = F.when(F.col("o_orderstatus") == "F", 2**31 - 1).when(F.col("o_orderstatus") == "P", -(2**31)).otherwise(days)
    out.table(16400, table(spark, folder, "orders").select("o_orderkey", day.cast("int").alias("day")), "o_orderkey int8, day date")
    register(spark)
    return spark.read.format("pgheap").options(columns="o_orderkey int8, day date", temporal="text").load(f"{out.root}/base/16384/16400").select("o_orderkey", "day")


@query("""WITH d AS (SELECT doc_id, lower(hex(encode(text))) h, octet_length(encode(text)) n FROM documents WHERE length(text) > 0)
SELECT doc_id AS loid, -1 AS page, 'SELECT lo_create(' || doc_id || ');' AS statement FROM d UNION ALL SELECT doc_id, CAST(k * 4 AS INTEGER), 'SELECT lo_put(' || doc_id || ', ' || (k * 8192) || ', ''\\x' || substr(h, CAST(k AS BIGINT) * 16384 + 1, 16384) || ''');' FROM d, range((n + 8191) // 8192) r(k)""")
def cluster_large_object_script(spark, folder):
    """Statements that restore large objects from the pages in pg_largeobject, four pages each. An oid has four bytes and
    doc_id eight: objects are stored under numbers, their statements name doc_id."""
    out = Folder(spark)
    raw = with_number(table(spark, folder, "documents").where("length(text) > 0").select("doc_id", F.encode("text", "UTF-8").alias("raw")), "loid")
    pages = raw.select("loid", "raw", F.explode(F.sequence(F.lit(0), (F.ceil(F.length("raw") / 2048) - 1).cast("int"))).alias("pageno"))
    out.put("pg_largeobject", pages.select("loid", "pageno", F.expr("substring(raw, pageno * 2048 + 1, 2048)").alias("data")), spread=False)
    ids = materialize(raw.select("loid", "doc_id"))
    release(raw)
    stored = out.cluster().catalog("pg_largeobject").select("loid", "pageno", "data").join(ids, "loid")
    return toast.page_statements(stored, group=4, label="doc_id").select(F.col("doc_id").alias("loid"), "page", "statement")


@query("""SELECT 20000 + n_nationkey AS oid, 'CREATE OR REPLACE FUNCTION public.f_' || n_nationkey || '(integer, text' || CASE WHEN n_regionkey = 1 THEN '[]' ELSE '' END || ') RETURNS ' || CASE WHEN n_regionkey = 2 THEN 'SETOF ' ELSE '' END || 'bigint LANGUAGE plpgsql '
 || CASE n_regionkey WHEN 0 THEN 'IMMUTABLE' WHEN 1 THEN 'STABLE' ELSE 'VOLATILE' END || CASE WHEN n_regionkey = 3 THEN ' STRICT' ELSE '' END || CASE WHEN n_regionkey = 4 THEN ' SECURITY DEFINER' ELSE '' END || ' AS $$begin return ''' || n_name || '''; end$$;' AS statement FROM nation""")
def cluster_function_ddl(spark, folder):
    """CREATE FUNCTION from pg_proc and pg_language, one for each nation."""
    from pagewright.sources import schema

    out, region = Folder(spark), F.col("n_regionkey")
    out.rows("pg_namespace", [{"oid": 2200, "nspname": "public"}])
    out.rows("pg_language", [{"oid": 13000, "lanname": "plpgsql", "lanowner": 10}])
    rows = table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 20_000).cast("bigint").alias("oid"), F.concat(F.lit("f_"), F.col("n_nationkey").cast("string")).alias("proname"), F.lit(2200).alias("pronamespace"), F.lit(13000).alias("prolang"), F.lit("f").alias("prokind"),
        F.when(region == 0, "i").when(region == 1, "s").otherwise("v").alias("provolatile"), (region == 3).alias("proisstrict"), (region == 4).alias("prosecdef"), (region == 2).alias("proretset"), F.lit(20).alias("prorettype"),
        F.array(F.lit(23), F.when(region == 1, 1009).otherwise(25)).alias("proargtypes"), F.concat(F.lit("begin return '"), "n_name", F.lit("'; end")).alias("prosrc"),
    )
    out.put("pg_proc", rows)
    return schema.function_statements(out.cluster()).select("oid", "statement")


_EVENTS = "concat_ws(' OR ', CASE WHEN n_nationkey % 2 = 0 THEN 'INSERT' END, CASE WHEN n_nationkey % 3 = 0 THEN 'DELETE' END, 'UPDATE OF id')"


@query(f"""SELECT n_name AS name, 'CREATE TRIGGER "' || n_name || '" ' || CASE WHEN n_regionkey = 0 THEN 'BEFORE' ELSE 'AFTER' END || ' ' || {_EVENTS} || ' ON public.t FOR EACH ' || CASE WHEN n_regionkey = 1 THEN 'STATEMENT' ELSE 'ROW' END || ' EXECUTE FUNCTION public.f(''' || n_name || ''', ''x'');' AS statement FROM nation""")
def cluster_trigger_ddl(spark, folder):
    """CREATE TRIGGER from pg_trigger, pg_proc and pg_attribute; internal triggers are left out."""
    from pagewright.sources import schema

    out, key, region = Folder(spark), F.col("n_nationkey"), F.col("n_regionkey")
    out.rows("pg_namespace", [{"oid": 2200, "nspname": "public"}])
    out.rows("pg_class", [{"oid": 16400, "relname": "t", "relnamespace": 2200, "relfilenode": 16400, "relkind": "r"}])
    out.rows("pg_attribute", [{"attrelid": 16400, "attname": "id", "attnum": 1, "atttypid": 23, "attlen": 4, "attalign": "i", "atttypmod": -1}])
    out.rows("pg_proc", [{"oid": 16500, "proname": "f", "pronamespace": 2200, "prokind": "f", "provolatile": "v"}])
    bits = F.when(region == 1, 0).otherwise(1) + F.when(region == 0, 2).otherwise(0) + F.when(key % 2 == 0, 4).otherwise(0) + F.when(key % 3 == 0, 8).otherwise(0) + 16
    made = lambda internal: table(spark, folder, "nation").select((key + (20_000 + 100 * internal)).cast("bigint").alias("oid"), F.lit(16400).alias("tgrelid"), F.col("n_name").alias("tgname"), F.lit(16500).alias("tgfoid"), bits.alias("tgtype"), F.lit(bool(internal)).alias("tgisinternal"), F.array(F.lit(1)).alias("tgattr"), F.lit(2).alias("tgnargs"), F.concat(F.encode("n_name", "UTF-8"), F.lit(b"\0x\0")).alias("tgargs"))
    out.put("pg_trigger", made(0).unionByName(made(1)))
    return schema.trigger_statements(out.cluster()).select(F.regexp_extract("name", r"([^.]*)$", 1).alias("name"), "statement")


_BASE = "CASE ltrim(bt.typname, '_') WHEN 'int4' THEN 'integer' WHEN 'varchar' THEN 'character varying' WHEN 'bpchar' THEN 'character' WHEN 'timestamp' THEN 'timestamp without time zone' WHEN 'timestamptz' THEN 'timestamp with time zone' WHEN 'time' THEN 'time without time zone' WHEN 'timetz' THEN 'time with time zone' WHEN 'bool' THEN 'boolean' WHEN 'float8' THEN 'double precision' WHEN 'float4' THEN 'real' WHEN 'int8' THEN 'bigint' WHEN 'int2' THEN 'smallint' WHEN 'varbit' THEN 'bit varying' ELSE ltrim(bt.typname, '_') END || CASE WHEN starts_with(bt.typname, '_') THEN '[]' ELSE '' END"


@query(f"WITH {_CT} SELECT ct.oid, 'CREATE DOMAIN public.' || {_q('ct.typname')} || ' AS ' || coalesce({_BASE}, CASE WHEN starts_with(u.typname, '_') THEN {_q('substr(u.typname, 2)')} || '[]' ELSE {_q('u.typname')} END, '\"oid ' || coalesce(ct.base, 0) || '\"') || CASE WHEN ct.notnull THEN ' NOT NULL' ELSE '' END || ';' AS statement FROM ct LEFT JOIN builtin_type bt ON bt.oid = ct.base LEFT JOIN ct u ON u.oid = ct.base WHERE ct.typtype = 'd' AND ct.oid >= 16384")
def cluster_domain_ddl(spark, folder):
    """CREATE DOMAIN from pg_type."""
    from pagewright.sources import schema

    return schema.type_statements(_cluster(spark, folder, "pg_type")).where(F.col("step") == schema.DOMAIN).select("oid", "statement")
