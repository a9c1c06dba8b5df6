"""Queries of the catalog, visibility, format and report operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators import catalog, encoding_vote, formatting, report, toast, visibility
from pagewright.operators.changefeed import with_status
from pagewright.operators.orphan_catalog import current_types

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scans, projections, counts ----


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_project(spark, folder):
    wanted = {"o_totalprice", "o_orderkey", "o_orderstatus"}
    df = table(spark, folder, "orders")
    return df.select(*[c for c in df.columns if c in wanted])  # table order, whatever order was asked for


@query("SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 100")
def scan_limit_ordered(spark, folder):
    return table(spark, folder, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").limit(100)


@query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, folder):
    return table(spark, folder, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def partition_totals(spark, folder):
    return table(spark, folder, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor((rn - 1) / 4096) AS BIGINT) AS segment, count(*) AS n, min(rn) AS first_row, max(rn) AS last_row FROM (SELECT row_number() OVER (ORDER BY feed_seq) rn FROM heap_tuple) GROUP BY 1")
def segment_locate(spark, folder):
    # row positions without a global window: feed_seq runs from 1 without gaps in the feed, else positions come per range
    df = table(spark, folder, "heap_tuple").select("feed_seq")
    from pagewright.plans.position import with_position

    placed = with_position(df, ["feed_seq"], "rn")
    return placed.groupBy(F.floor((F.col("rn") - 1) / 4096).cast("bigint").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_row"), F.max("rn").alias("last_row"))


# ---- visibility ----

_LATEST = "SELECT * FROM (SELECT xid, arg_max(status, (seen_ts, status)) status FROM clog_status WHERE xid IS NOT NULL GROUP BY xid)"
_STATE = "CASE WHEN t_infomask & 512 <> 0 AND t_infomask & 256 = 0 THEN 'aborted' WHEN t_infomask & 2176 <> 0 THEN 'live' WHEN t_infomask & 5120 <> 0 THEN 'deleted' WHEN t_xmax = 0 THEN 'live' ELSE 'suspected' END"
_STATE_LOG = """CASE WHEN t_infomask & 512 <> 0 AND t_infomask & 256 = 0 THEN 'aborted' WHEN t_infomask & 768 = 0 AND t_xmin >= 3 AND coalesce(i.status, 1) IN (0, 2) THEN 'aborted'
 WHEN t_infomask & 2176 <> 0 THEN 'live' WHEN t_infomask & 5120 <> 0 THEN 'deleted' WHEN t_xmax = 0 THEN 'live' WHEN t_xmax < 3 OR o.status IN (1, 3) THEN 'deleted' WHEN o.status = 2 THEN 'live' ELSE 'suspected' END"""


def _states(spark, folder):
    return table(spark, folder, "heap_tuple").withColumn("state", visibility.visibility(F.col("t_infomask"), F.col("t_xmax")))


@query(f"SELECT feed_seq, rel_oid, row_id FROM (SELECT *, {_STATE} s FROM heap_tuple) WHERE s IN ('live', 'suspected')")
def mvcc_live(spark, folder):
    return _states(spark, folder).where(visibility.admitted(F.col("state"))).select("feed_seq", "rel_oid", "row_id")


@query(f"SELECT feed_seq, s AS state FROM (SELECT *, {_STATE} s FROM heap_tuple) WHERE s IN ('deleted', 'suspected')")
def mvcc_deleted(spark, folder):
    return _states(spark, folder).where(visibility.admitted(F.col("state"), "deleted")).select("feed_seq", "state")


@query(f"SELECT feed_seq, CASE s WHEN 'deleted' THEN 'DELETED' WHEN 'suspected' THEN 'SUSPECTED_DELETED' ELSE '' END AS mark FROM (SELECT *, {_STATE} s FROM heap_tuple) WHERE s <> 'aborted'")
def deleted_markers(spark, folder):
    return _states(spark, folder).where(visibility.admitted(F.col("state"), "all")).select("feed_seq", visibility.deleted_mark(F.col("state")).alias("mark"))


@query(f"SELECT feed_seq, rel_oid, s AS state, CASE s WHEN 'deleted' THEN 'DELETED' WHEN 'suspected' THEN 'SUSPECTED_DELETED' ELSE '' END AS mark, val_text FROM (SELECT *, {_STATE} s FROM heap_tuple) WHERE s <> 'aborted'")
def mvcc_all_marked(spark, folder):
    rows = _states(spark, folder).where(visibility.admitted(F.col("state"), "all"))
    return rows.select("feed_seq", "rel_oid", "state", visibility.deleted_mark(F.col("state")).alias("mark"), "val_text")


@query("SELECT rel_oid, row_id, page_no, item_no, feed_seq FROM heap_tuple QUALIFY row_number() OVER (PARTITION BY rel_oid, row_id ORDER BY t_ctid = (page_no << 16) + item_no DESC, feed_seq DESC) = 1")
def chain_end_version(spark, folder):
    """Of each row the image at the end of its update chain (its ctid is its own place), then the one that came last."""
    at_end = (F.col("t_ctid") == F.shiftleft("page_no", 16) + F.col("item_no")).cast("int")
    rows = table(spark, folder, "heap_tuple")
    best = rows.groupBy("rel_oid", "row_id").agg(F.max_by(F.struct("page_no", "item_no", "feed_seq"), F.struct(F.coalesce(at_end, F.lit(-1)), "feed_seq")).alias("r"))
    return best.select("rel_oid", "row_id", "r.page_no", "r.item_no", "r.feed_seq")


@query(f"WITH l AS ({_LATEST}) SELECT feed_seq, {_STATE_LOG} AS state FROM heap_tuple h LEFT JOIN l i ON i.xid = h.t_xmin LEFT JOIN l o ON o.xid = h.t_xmax")
def mvcc_clog_recheck(spark, folder):
    from pagewright.plans.skew import hot_hashes

    log = visibility.clog_latest(table(spark, folder, "clog_status"))
    rows = table(spark, folder, "heap_tuple").select("feed_seq", "t_xmin", "t_xmax", "t_infomask")
    mask = F.col("t_infomask")
    unknown = visibility.insert_known(mask, F.col("t_xmin")).isNull()
    uncertain = visibility.delete_certain(mask, F.col("t_xmax")) == visibility.XMAX_OPEN
    rows = with_status(rows, F.col("t_xmin"), unknown, log, "in_status", hot_hashes(rows.where(unknown), ["t_xmin"]))
    rows = with_status(rows, F.col("t_xmax"), uncertain, log, "out_status", hot_hashes(rows.where(uncertain), ["t_xmax"]))
    return rows.select("feed_seq", visibility.visibility(mask, F.col("t_xmax"), F.col("in_status"), F.col("out_status"), F.col("t_xmin")).alias("state"))


@query(f"WITH l AS ({_LATEST}) SELECT status, count(*) AS n, min(xid) AS first_xid, max(xid) AS last_xid FROM l GROUP BY status")
def clog_statistics(spark, folder):
    log = visibility.clog_latest(table(spark, folder, "clog_status"))
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("xid").alias("first_xid"), F.max("xid").alias("last_xid"))


@query(f"WITH l AS ({_LATEST}), b AS (SELECT xid // 4 AS byte_no, CAST(sum(CAST(status AS BIGINT) << CAST(2 * (xid % 4) AS INTEGER)) AS BIGINT) AS packed FROM l GROUP BY 1) SELECT byte_no * 4 + k AS xid, CAST((packed >> CAST(2 * k AS INTEGER)) & 3 AS BIGINT) AS status FROM b, range(4) r(k)")
def clog_decode(spark, folder):
    """Statuses packed into bytes of four, as the commit log holds them, and unpacked by shifts."""
    log = visibility.clog_latest(table(spark, folder, "clog_status"))
    packed = log.groupBy(F.floor(F.col("xid") / 4).cast("bigint").alias("byte_no")).agg(F.sum(F.expr("shiftleft(cast(status as bigint), cast(2 * (xid % 4) as int))")).alias("packed"))
    each = packed.select("byte_no", "packed", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    return each.select((F.col("byte_no") * 4 + F.col("k")).alias("xid"), F.expr("shiftright(packed, 2 * k) & 3L").alias("status"))


@query("SELECT CAST(count(*) FILTER (t_infomask & 768 = 0) AS BIGINT) AS no_xmin_hint, CAST(count(*) FILTER (t_xmax <> 0 AND t_infomask & 7296 = 0) AS BIGINT) AS no_xmax_hint, count(*) AS n FROM heap_tuple")
def hint_statistics(spark, folder):
    mask = F.col("t_infomask")
    return table(spark, folder, "heap_tuple").agg(
        F.count_if(~visibility.has(mask, 0x300)).alias("no_xmin_hint"),
        F.count_if((F.col("t_xmax") != 0) & ~visibility.has(mask, 0x1C80)).alias("no_xmax_hint"),
        F.count(F.lit(1)).alias("n"),
    )


def _le(offset: int, size: int) -> str:
    parts = " || ".join(f"substr(hex(raw), {2 * (offset + i) + 1}, 2)" for i in reversed(range(size)))
    return f"CAST(('0x' || {parts}) AS BIGINT)"


@query(f"SELECT feed_seq, {_le(0, 4)} AS xmin, {_le(4, 4)} AS xmax, {_le(18, 2)} & 2047 AS natts, {_le(20, 2)} AS infomask, {_le(22, 1)} AS hoff FROM heap_tuple WHERE octet_length(raw) >= 23")
def heap_header_decode(spark, folder):
    raw = F.col("raw")
    rows = table(spark, folder, "heap_tuple").where(F.length(raw) >= 23)
    return rows.select("feed_seq", X.u32(raw, 0).alias("xmin"), X.u32(raw, 4).alias("xmax"), X.u16(raw, 18).bitwiseAND(F.lit(2047)).alias("natts"), X.u16(raw, 20).alias("infomask"), X.u8(raw, 22).alias("hoff"))


@query(f"SELECT feed_seq, {_le(22, 1)} >= 23 AND {_le(22, 1)} % 8 = 0 AND {_le(22, 1)} <= octet_length(raw) AND {_le(18, 2)} & 2047 BETWEEN 1 AND 1600 AS sane FROM heap_tuple WHERE octet_length(raw) >= 23")
def tuple_sanity(spark, folder):
    raw = F.col("raw")
    hoff, natts = X.u8(raw, 22), X.u16(raw, 18).bitwiseAND(F.lit(2047))
    sane = (hoff >= 23) & (hoff % 8 == 0) & (hoff <= F.length(raw)) & natts.between(1, 1600)
    return table(spark, folder, "heap_tuple").where(F.length(raw) >= 23).select("feed_seq", sane.alias("sane"))


@query("SELECT p_partkey, (v & 32767) AS off, (v >> 15) & 3 AS flags, v >> 17 AS len FROM (SELECT p_partkey, (p_partkey * 37 % 8192) | (1 << 15) | ((p_partkey * 11 % 2000) << 17) v FROM part)")
def itemid_decode(spark, folder):
    packed = F.expr("(p_partkey * 37 % 8192) | shiftleft(1L, 15) | shiftleft(p_partkey * 11 % 2000, 17)")
    rows = table(spark, folder, "part").select("p_partkey", packed.alias("v"))
    return rows.select("p_partkey", F.expr("v & 32767L").alias("off"), F.expr("shiftright(v, 15) & 3L").alias("flags"), F.expr("shiftright(v, 17)").alias("len"))


@query("SELECT rel_oid, max(natts) AS max_natts, count(*) AS n FROM heap_tuple GROUP BY rel_oid")
def max_natts(spark, folder):
    return table(spark, folder, "heap_tuple").groupBy("rel_oid").agg(F.max("natts").alias("max_natts"), F.count(F.lit(1)).alias("n"))


@query("SELECT rel_oid, count(*) AS n_bad, list_slice(list_sort(list(DISTINCT page_no)), 1, 1000) AS pages FROM heap_tuple WHERE raw IS NULL GROUP BY rel_oid")
def bad_pages_capped(spark, folder):
    """Bad images per relation with the first 1000 page numbers; the list is kept short before it is collected."""
    bad = table(spark, folder, "heap_tuple").where("raw is null").groupBy("rel_oid", "page_no").agg(F.count(F.lit(1)).alias("k"))
    # pages are distinct now; a relation's list is taken from ranks within buckets of pages, so no list exceeds the cap by much
    w = Window.partitionBy("rel_oid", F.col("page_no") % 64).orderBy("page_no")
    ranked = bad.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("rel_oid").agg(F.sum("k").alias("n_bad"), F.slice(F.sort_array(F.collect_list(F.when(F.col("rank") <= 1000, F.col("page_no")))), 1, 1000).alias("pages"))


# ---- catalog ----

_CM = "cm AS (SELECT * FROM table_meta WHERE oid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY oid ORDER BY t_xmin DESC, row_no DESC) = 1)"
_CT = "ct AS (SELECT * FROM type_def WHERE oid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY oid ORDER BY t_xmin DESC, row_no DESC) = 1)"
_CC = "cc AS (SELECT * FROM attr_row WHERE attnum BETWEEN 1 AND relnatts QUALIFY row_number() OVER (PARTITION BY attrelid, attnum ORDER BY snap_no DESC, coalesce(attisdropped, false), t_xmin DESC, attname DESC) = 1)"
_PK = "pk AS (SELECT ind_rel_id, ind_index_rel_id, list_slice(ind_key, 1, CASE WHEN coalesce(ind_nkeyatts, 0) > 0 THEN ind_nkeyatts ELSE len(ind_key) END) keys FROM index_row WHERE ind_is_primary AND ind_rel_id <> 0 QUALIFY row_number() OVER (PARTITION BY ind_rel_id ORDER BY len(keys) DESC, ind_index_rel_id) = 1)"


@query(f"WITH {_CC} SELECT attrelid, attnum, attname, atttypid, attisdropped FROM cc")
def latest_column_version(spark, folder):
    return catalog.current_columns(table(spark, folder, "attr_row")).select("attrelid", "attnum", "attname", "atttypid", "attisdropped")


@query(f"WITH {_CM} SELECT oid, schema_name, relname, relkind, row_no FROM cm")
def latest_class_version(spark, folder):
    return catalog.current_relations(table(spark, folder, "table_meta")).select("oid", "schema_name", "relname", "relkind", "row_no")


@query(f"WITH {_PK} SELECT ind_rel_id, ind_index_rel_id, array_to_string(keys, ',') AS keys FROM pk")
def widest_primary_key(spark, folder):
    return catalog.primary_keys(table(spark, folder, "index_row")).select("ind_rel_id", "ind_index_rel_id", F.array_join("ind_key", ",").alias("keys"))


@query(f"WITH {_CC} SELECT attrelid, string_agg(attname, ',' ORDER BY attnum) AS names, count(*) AS n_columns FROM cc WHERE NOT coalesce(attisdropped, false) GROUP BY attrelid")
def column_lists(spark, folder):
    return catalog.column_lists(catalog.current_columns(table(spark, folder, "attr_row"))).select("attrelid", F.array_join("names", ",").alias("names"), "n_columns")


@query(f"""WITH {_CM}, {_CC}, {_PK}, l AS (SELECT attrelid, string_agg(attname, ',' ORDER BY attnum) names, count(*) n FROM cc WHERE NOT coalesce(attisdropped, false) GROUP BY attrelid),
k AS (SELECT u.ind_rel_id, string_agg(cc.attname, ',' ORDER BY u.pos) cols FROM (SELECT ind_rel_id, unnest(keys) a, generate_subscripts(keys, 1) pos FROM pk) u JOIN cc ON cc.attrelid = u.ind_rel_id AND cc.attnum = u.a GROUP BY u.ind_rel_id)
SELECT c.oid, coalesce(c.schema_name, 'public') AS schema_name, c.relname, l.n AS n_columns, l.names AS columns, k.cols AS pk_columns, t.relfilenode AS toast_relfilenode
FROM cm c JOIN l ON l.attrelid = c.oid LEFT JOIN k ON k.ind_rel_id = c.oid LEFT JOIN cm t ON t.oid = c.toast_rel_id""")
def catalog_join_chain(spark, folder):
    return catalog.describe(table(spark, folder, "table_meta"), table(spark, folder, "attr_row"), table(spark, folder, "index_row"))


@query(f"WITH {_CM} SELECT relname, oid, coalesce(schema_name, 'public') AS schema_name FROM cm WHERE relname IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relname ORDER BY coalesce(schema_name, 'public') <> 'public', coalesce(schema_name, 'public'), oid) = 1")
def name_resolution_public_first(spark, folder):
    return catalog.resolve_name(catalog.current_relations(table(spark, folder, "table_meta")))


@query(f"WITH {_CM} SELECT c.oid, t.oid AS toast_oid, t.relfilenode AS toast_relfilenode FROM cm c LEFT JOIN cm t ON t.oid = c.toast_rel_id AND t.relkind = 't'")
def self_join_toast_lookup(spark, folder):
    cur = catalog.current_relations(table(spark, folder, "table_meta"))
    t = cur.where("relkind = 't'").select(F.col("oid").alias("toast_oid"), F.col("relfilenode").alias("toast_relfilenode"))
    return cur.join(t, cur["toast_rel_id"] == t["toast_oid"], "left").select("oid", "toast_oid", "toast_relfilenode")


@query(f"WITH {_CM} SELECT con_oid, conname, EXISTS (SELECT 1 FROM cm WHERE oid = conrelid) AS has_table FROM (SELECT DISTINCT con_oid, conname, conrelid FROM constr_row WHERE contype = 'f')")
def semi_anti_members(spark, folder):
    rows = table(spark, folder, "constr_row").where("contype = 'f'").select("con_oid", "conname", "conrelid").distinct()
    known = catalog.current_relations(table(spark, folder, "table_meta")).select(F.col("oid").alias("conrelid"))
    inside = rows.join(known, "conrelid", "left_semi").withColumn("has_table", F.lit(True))
    outside = rows.join(known, "conrelid", "left_anti").withColumn("has_table", F.lit(False))
    return inside.unionByName(outside).select("con_oid", "conname", "has_table")


@query("SELECT DISTINCT ind_index_rel_id, ind_rel_id FROM index_row i WHERE NOT EXISTS (SELECT 1 FROM constr_row c WHERE c.contype IN ('p', 'u') AND c.conrelid = i.ind_rel_id AND array_to_string(c.conkey, ',') = array_to_string(i.ind_key, ','))")
def plain_indexes(spark, folder):
    return catalog.plain_indexes(table(spark, folder, "index_row"), table(spark, folder, "constr_row")).select("ind_index_rel_id", "ind_rel_id").distinct()


@query(f"""WITH RECURSIVE {_CM}, kids AS (SELECT oid, part_parent FROM cm WHERE part_parent IS NOT NULL AND part_parent <> 0),
u AS (SELECT oid, oid cur, 0 depth FROM cm UNION ALL SELECT u.oid, p.oid, depth + 1 FROM u JOIN cm c ON c.oid = u.cur JOIN cm p ON p.oid = c.part_parent WHERE depth < 40),
d AS (SELECT oid root, oid cur, [oid] seen FROM cm WHERE relkind = 'p' AND oid NOT IN (SELECT oid FROM u WHERE depth = 40) UNION ALL SELECT root, k.oid, list_append(seen, k.oid) FROM d JOIN kids k ON k.part_parent = d.cur WHERE NOT list_contains(seen, k.oid))
SELECT DISTINCT root AS parent_oid, cur AS leaf_oid FROM d WHERE cur <> root AND cur NOT IN (SELECT part_parent FROM kids) AND cur IN (SELECT oid FROM cm WHERE relkind = 'r')""")
def partition_leaves(spark, folder):
    """Leaf tables of every partitioned table, from the intervals of the heavy-path forest."""
    from pagewright.operators import hierarchy
    from pagewright.plans.lineage import materialize

    cur = catalog.current_relations(table(spark, folder, "table_meta")).select("oid", "relkind", F.when(F.col("part_parent") != 0, F.col("part_parent")).alias("parent"))
    forest = materialize(hierarchy.heavy_paths(cur.select(F.col("oid").alias("id"), "parent")))
    pairs = hierarchy.descendants(forest.where("not on_circle"), cur.where("relkind = 'p'").select(F.col("oid").alias("id")))
    leaves = cur.where("relkind = 'r'").select(F.col("oid").alias("descendant")).join(cur.select(F.col("parent").alias("descendant")), "descendant", "left_anti")
    return pairs.join(leaves, "descendant").select(F.col("id").alias("parent_oid"), F.col("descendant").alias("leaf_oid"))


@query(f"""WITH RECURSIVE {_CM}, d AS (SELECT oid, oid cur, 0 depth FROM cm UNION ALL SELECT d.oid, p.oid, depth + 1 FROM d JOIN cm c ON c.oid = d.cur JOIN cm p ON p.oid = c.part_parent WHERE depth < 40)
SELECT oid, CAST(max(depth) AS BIGINT) AS depth FROM d GROUP BY oid HAVING max(depth) < 40""")
def topological_depth(spark, folder):
    """Parents before children: depth in the partition forest, relations at circles left out."""
    from pagewright.operators import hierarchy

    cur = catalog.current_relations(table(spark, folder, "table_meta")).select(F.col("oid").alias("id"), F.when(F.col("part_parent") != 0, F.col("part_parent")).alias("parent"))
    return hierarchy.heavy_paths(cur).where("not on_circle").select(F.col("id").alias("oid"), "depth")


_CHAIN = f"""WITH RECURSIVE {_CT}, n AS (SELECT oid, typname, coalesce(nullif(base, 0), nullif(elem, 0)) up FROM ct UNION ALL SELECT oid, typname, coalesce(nullif(base, 0), nullif(elem, 0)) FROM builtin_type),
w AS (SELECT oid, oid cur, [oid] seen, false again FROM n UNION ALL SELECT w.oid, p.oid, list_append(seen, p.oid), list_contains(seen, p.oid) FROM w JOIN n c ON c.oid = w.cur JOIN n p ON p.oid = c.up WHERE NOT again),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY oid ORDER BY len(seen) DESC) = 1)"""


@query(_CHAIN + " SELECT l.oid, l.cur AS ultimate_oid, n.typname AS ultimate_name FROM l JOIN n ON n.oid = l.cur WHERE NOT again")
def type_closure(spark, folder):
    """The type at the end of each chain of domains and arrays."""
    from pagewright.operators import hierarchy
    from pagewright.plans.skew import skew_join

    both = current_types(table(spark, folder, "type_def")).select("oid", "typname", "base", "elem").unionByName(table(spark, folder, "builtin_type").select("oid", "typname", "base", "elem"))
    up = F.coalesce(F.when(F.col("base") != 0, F.col("base")), F.when(F.col("elem") != 0, F.col("elem")))
    forest = hierarchy.heavy_paths(both.select(F.col("oid").alias("id"), up.alias("parent"))).where("not on_circle")
    names = both.select(F.col("oid").alias("ultimate_oid"), F.col("typname").alias("ultimate_name"))
    return skew_join(forest.select(F.col("id").alias("oid"), F.col("root").alias("ultimate_oid")), names, ["ultimate_oid"]).select("oid", "ultimate_oid", "ultimate_name")


@query(f"WITH {_CC}, {_CT} SELECT cc.attrelid, cc.attnum, coalesce(b.typname, ct.typname, 'oid ' || cc.atttypid) AS type_name FROM cc LEFT JOIN builtin_type b ON b.oid = atttypid LEFT JOIN ct ON ct.oid = atttypid")
def type_map_names(spark, folder):
    cols = catalog.current_columns(table(spark, folder, "attr_row"))
    built = table(spark, folder, "builtin_type").select(F.col("oid").alias("atttypid"), F.col("typname").alias("b"))  # a fixed table
    user = current_types(table(spark, folder, "type_def")).select(F.col("oid").alias("atttypid"), F.col("typname").alias("u"))
    rows = cols.join(F.broadcast(built), "atttypid", "left").join(user, "atttypid", "left")
    return rows.select("attrelid", "attnum", F.coalesce("b", "u", F.concat(F.lit("oid "), F.col("atttypid").cast("string"))).alias("type_name"))


@query(f"WITH {_CM} SELECT oid, CASE WHEN schema_name IN ('information_schema', 'pg_catalog', 'pg_toast', 'sys', 'sys_catalog', 'xlog_record_read') OR schema_name LIKE 'pg\\_temp\\_%' ESCAPE '\\' OR schema_name LIKE 'pg\\_toast\\_temp\\_%' ESCAPE '\\' THEN 'system schema' WHEN drop_ts IS NOT NULL THEN 'dropped' WHEN relkind = 'p' THEN 'partition parent' WHEN relkind <> 'r' THEN 'not a table' WHEN coalesce(relfilenode, 0) = 0 THEN 'no storage' END AS reason FROM cm")
def table_selection(spark, folder):
    return catalog.current_relations(table(spark, folder, "table_meta")).select("oid", catalog.skip_reason().alias("reason"))


@query("WITH s AS (" + SQL["table_selection"] + ") SELECT reason, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY reason")
def skip_reason_histogram(spark, folder):
    return table_selection(spark, folder).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT schema_name, table_name, contype FROM constr_row WHERE NOT validated")
def distinct_skips(spark, folder):
    return table(spark, folder, "constr_row").where("not validated").select("schema_name", "table_name", "contype").dropDuplicates()


@query(f"WITH {_CM} SELECT DISTINCT table_name FROM constr_row WHERE table_name IS NOT NULL EXCEPT SELECT relname FROM cm")
def requested_minus_found(spark, folder):
    asked = table(spark, folder, "constr_row").where("table_name is not null").select("table_name").distinct()
    there = catalog.current_relations(table(spark, folder, "table_meta")).select(F.col("relname").alias("table_name"))
    return asked.join(there, "table_name", "left_anti")


@query(f"WITH {_CM} SELECT relkind, CASE relkind WHEN 'r' THEN 'table' WHEN 'p' THEN 'partitioned table' WHEN 't' THEN 'toast table' WHEN 'c' THEN 'composite type' ELSE 'kind ' || relkind END AS kind_name, count(*) AS n, sum(CAST(relpages AS BIGINT))::BIGINT AS pages FROM cm GROUP BY 1, 2")
def relation_kinds(spark, folder):
    cur = catalog.current_relations(table(spark, folder, "table_meta"))
    return cur.groupBy("relkind", catalog.relkind_name(F.col("relkind")).alias("kind_name")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("relpages").cast("bigint")).alias("pages"))


@query(f"WITH {_CM} SELECT oid, relpages FROM cm WHERE relkind = 'r' ORDER BY relpages DESC, oid LIMIT 5")
def largest_files(spark, folder):
    return catalog.current_relations(table(spark, folder, "table_meta")).where("relkind = 'r'").select("oid", "relpages").orderBy(F.desc("relpages"), "oid").limit(5)


@query(f"""WITH {_CM}, {_CC}, k AS (SELECT DISTINCT con_oid, conname, conrelid, confrelid, conkey, confkey FROM constr_row WHERE contype = 'f'),
a AS (SELECT con_oid, string_agg(coalesce(attname, '?'), ',' ORDER BY pos) cols FROM (SELECT con_oid, conrelid r, unnest(conkey) n, generate_subscripts(conkey, 1) pos FROM k) LEFT JOIN cc ON attrelid = r AND attnum = n GROUP BY con_oid),
b AS (SELECT con_oid, string_agg(coalesce(attname, '?'), ',' ORDER BY pos) cols FROM (SELECT con_oid, confrelid r, unnest(confkey) n, generate_subscripts(confkey, 1) pos FROM k) LEFT JOIN cc ON attrelid = r AND attnum = n GROUP BY con_oid)
SELECT k.con_oid, k.conname, x.relname AS table_name, a.cols AS columns, y.relname AS target_name, b.cols AS target_columns FROM k LEFT JOIN a ON a.con_oid = k.con_oid LEFT JOIN b ON b.con_oid = k.con_oid LEFT JOIN cm x ON x.oid = k.conrelid LEFT JOIN cm y ON y.oid = k.confrelid""")
def foreign_key_columns(spark, folder):
    from pagewright.operators.objects import foreign_keys

    return foreign_keys(table(spark, folder, "constr_row"), catalog.current_columns(table(spark, folder, "attr_row")), catalog.current_relations(table(spark, folder, "table_meta")))


# ---- formats ----


def _csv(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '\\N' WHEN contains({c}, ',') OR contains({c}, '\"') OR contains({c}, chr(10)) OR contains({c}, chr(13)) OR {c} IN ('\\N', '\\.') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


def _copy(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for char, letter in ((8, "b"), (9, "t"), (10, "n"), (11, "v"), (12, "f"), (13, "r")):
        out = f"replace({out}, chr({char}), '\\{letter}')"
    return out


@query(f"SELECT doc_id, concat_ws(',', CAST(doc_id AS VARCHAR), {_csv('text')}, {_csv('lang')}, {_csv('source')}) AS line FROM documents")
def csv_lines(spark, folder):
    df = table(spark, folder, "documents")
    return df.select("doc_id", formatting.csv_line(df, ["doc_id", "text", "lang", "source"]).alias("line"))


@query(f"SELECT doc_id, concat_ws(chr(9), CAST(doc_id AS VARCHAR), coalesce({_copy('text')}, '\\N'), coalesce({_copy('lang')}, '\\N')) AS line FROM documents")
def copy_text_lines(spark, folder):
    df = table(spark, folder, "documents")
    return df.select("doc_id", formatting.copy_line(df, ["doc_id", "text", "lang"]).alias("line"))


def _lit(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'NULL' WHEN regexp_matches({c}, '[\\\\\\x08-\\x0d]') THEN 'E''' || replace({_copy(c)}, '''', '''''') || '''' ELSE '''' || replace({c}, '''', '''''') || '''' END"


@query(f"SELECT doc_id, 'INSERT INTO \"documents\" (\"doc_id\", \"text\", \"lang\") VALUES (' || CAST(doc_id AS VARCHAR) || ', ' || {_lit('text')} || ', ' || {_lit('lang')} || ');' AS line FROM documents")
def insert_statements(spark, folder):
    df = table(spark, folder, "documents")
    return df.select("doc_id", formatting.insert_line(df, "documents", ["doc_id", "text", "lang"]).alias("line"))


@query("""WITH p AS (SELECT c_custkey, '(' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ')' v, c_custkey % 97 = 0 alone, row_number() OVER (ORDER BY c_custkey) pos FROM customer),
q AS (SELECT *, coalesce(max(CASE WHEN alone THEN pos END) OVER (ORDER BY pos), 0) start FROM p), g AS (SELECT *, CASE WHEN alone THEN -1 ELSE (pos - start - 1) // 50 END part FROM q)
SELECT min(pos) AS first_pos, count(*) AS n_rows, 'INSERT INTO "customer" ("c_custkey", "c_name", "c_nationkey") VALUES ' || string_agg(v, ', ' ORDER BY pos) || ';' AS statement FROM g GROUP BY start, part""")
def insert_batches(spark, folder):
    df = table(spark, folder, "customer")
    return formatting.insert_batches(df, "customer", ["c_custkey", "c_name", "c_nationkey"], ["c_custkey"], 50, F.col("c_custkey") % 97 == 0)


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' WHEN text = '' THEN 'convert_from(''\\x'', ''UTF8'')' ELSE 'value' END AS kind FROM documents")
def oracle_empty_strings(spark, folder):
    made = formatting.text_literal(F.col("text"), oracle_empty=True)
    return table(spark, folder, "documents").select("doc_id", F.when(F.col("text").isNull() | (F.col("text") == ""), made).otherwise("value").alias("kind"))


@query("SELECT doc_id, md5(text) AS checksum FROM documents")
def row_checksums(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5("text").alias("checksum"))


@query(f"WITH {_CM} SELECT oid, CASE WHEN schema_name IS NULL THEN '' ELSE '\"' || replace(schema_name, '\"', '\"\"') || '\".' END || '\"' || replace(relname, '\"', '\"\"') || '\"' AS name FROM cm")
def quoted_names(spark, folder):
    return catalog.current_relations(table(spark, folder, "table_meta")).select("oid", formatting.quoted_name(F.col("schema_name"), F.col("relname")).alias("name"))


# ---- text forms ----


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, CASE WHEN cents < 0 THEN '-' ELSE '' END || '$' || format('{:,}', abs(cents) // 100) || '.' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') AS money FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END cents FROM lineitem)")
def money_text(spark, folder):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, folder, "lineitem").withColumn("cents", cents).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", X.money_text(F.col("cents")).alias("money"))


@query("SELECT event_id, lpad(CAST(us // 3600000000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(us // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(us // 1000000 % 60 AS VARCHAR), 2, '0') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(us % 1000000 AS VARCHAR), 6, '0'), '0') END AS hms FROM (SELECT event_id, event_id * 7919003 % 86400000001 us FROM events)")
def hms_text(spark, folder):
    return table(spark, folder, "events").select("event_id", X.hms_text(F.col("event_id") * 7919003 % F.lit(86_400_000_001)).alias("hms"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def pg_date_text(spark, folder):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date"))
    return table(spark, folder, "orders").select("o_orderkey", X.date_text(days).alias("day"))


@query("SELECT event_id, make_timestamp(946684800000000 + (epoch_us(ts) - 946684800000000)) AS at FROM events")
def timestamp_from_micros(spark, folder):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 946_684_800_000_000
    return table(spark, folder, "events").select("event_id", X.timestamp_value(micros).alias("at"))


@query("SELECT DISTINCT page_lsn, upper(printf('%x', page_lsn >> 32)) || '/' || upper(printf('%x', page_lsn & 4294967295)) AS lsn FROM heap_tuple WHERE page_lsn IS NOT NULL")
def lsn_text(spark, folder):
    return table(spark, folder, "heap_tuple").where("page_lsn is not null").select("page_lsn").distinct().select("page_lsn", X.lsn_text(F.col("page_lsn")).alias("lsn"))


@query("SELECT con_oid, '{' || array_to_string(CAST(conkey AS VARCHAR[]), ',') || '}' AS keys FROM (SELECT DISTINCT con_oid, conkey FROM constr_row WHERE conkey IS NOT NULL)")
def array_literal(spark, folder):
    rows = table(spark, folder, "constr_row").where("conkey is not null").select("con_oid", "conkey").distinct()
    return rows.select("con_oid", X.array_literal(F.transform("conkey", lambda x: x.cast("string"))).alias("keys"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = '' OR regexp_matches({c}, '[(),\"\\\\\\s]') THEN '\"' || replace(replace({c}, '\\', '\\\\'), '\"', '\"\"') || '\"' ELSE {c} END"


@query(f"SELECT p_partkey, '(' || {_field('p_name')} || ',' || {_field('p_brand')} || ',' || CAST(p_size AS VARCHAR) || ')' AS record FROM part")
def record_literal(spark, folder):
    return table(spark, folder, "part").select("p_partkey", X.record_literal([F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")]).alias("record"))


@query("SELECT user_id, '[' || min(event_id) || ',' || max(event_id) || CASE WHEN min(event_id) = max(event_id) THEN ']' ELSE ')' END AS span FROM events GROUP BY user_id")
def range_literal(spark, folder):
    spans = table(spark, folder, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return spans.select("user_id", X.range_literal(F.col("a").cast("string"), F.col("b").cast("string"), F.lit(True), F.col("a") == F.col("b"), F.lit(False)).alias("span"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT p_partkey, lpad(bin(p_size), 8, '0') AS bits FROM part")
def bit_text(spark, folder):
    return table(spark, folder, "part").select("p_partkey", X.bit_text(F.col("p_size"), 8).alias("bits"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def charset_roundtrip(spark, folder):
    """Texts through UTF-8 bytes and back: sizes of those that come back the same."""
    raw = F.encode("text", "UTF-8")
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.where(F.is_valid_utf8(raw) & (F.decode(raw, "UTF-8") == F.col("text"))).select("doc_id", F.length(raw).cast("bigint").alias("n_bytes"), F.length("text").cast("bigint").alias("n_chars"))


# ---- out-of-line values and large objects ----

_PIECES = "p AS (SELECT doc_id, CAST(k AS INTEGER) seq, substr(text, CAST(k AS BIGINT) * 1996 + 1, 1996) data FROM documents, range((length(text) + 1995) // 1996) r(k) WHERE text IS NOT NULL)"


def _pieces(spark, folder):
    rows = table(spark, folder, "documents").where(F.length("text") > 0)
    n = F.ceil(F.length("text") / 1996).cast("int")
    cut = rows.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return cut.select("doc_id", "seq", F.length("text").alias("size"), F.expr("substring(text, seq * 1996 + 1, 1996)").alias("data"))


@query("SELECT doc_id, text AS value, CAST((length(text) + 1995) // 1996 AS BIGINT) AS n_chunks FROM documents WHERE length(text) > 0")
def toast_reassemble(spark, folder):
    return toast.reassemble(_pieces(spark, folder), "doc_id", "seq", "data", "size").select("doc_id", "value", "n_chunks")


@query("SELECT doc_id, CASE WHEN n > 1 AND doc_id % 3 = 0 THEN 'gap' ELSE 'ok' END AS state FROM (SELECT doc_id, (length(text) + 1995) // 1996 n FROM documents WHERE length(text) > 0)")
def toast_gap_check(spark, folder):
    """The first of several pieces is missing for every third text."""
    pieces = _pieces(spark, folder)
    several = F.max("seq").over(Window.partitionBy("doc_id")) > 0
    pieces = pieces.withColumn("several", several).where(~((F.col("doc_id") % 3 == 0) & F.col("several") & (F.col("seq") == 0)))
    return toast.reassemble(pieces, "doc_id", "seq", "data", "size").select("doc_id", "state")


@query("SELECT doc_id, CASE WHEN (length(text) + 1995) // 1996 > 1 THEN 'short' ELSE 'ok' END AS state FROM documents WHERE length(text) > 0")
def toast_short_check(spark, folder):
    """The last of several pieces is missing for every text."""
    pieces = _pieces(spark, folder)
    last = F.max("seq").over(Window.partitionBy("doc_id"))
    pieces = pieces.withColumn("last", last).where((F.col("last") == 0) | (F.col("seq") < F.col("last")))
    return toast.reassemble(pieces, "doc_id", "seq", "data", "size").select("doc_id", "state")


@query("SELECT doc_id, b AS size, CAST(greatest((b + 511) // 512 - 2, 0) AS BIGINT) AS n_holes FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) b FROM documents WHERE length(text) > 0)")
def large_object_holes(spark, folder):
    """Pages of 512 bytes of which only the first and the last are there."""
    rows = table(spark, folder, "documents").where(F.length("text") > 0).select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    top = (F.ceil(F.length("raw") / 512) - 1).cast("int")
    pages = rows.select("doc_id", "raw", F.explode(F.array_distinct(F.array(F.lit(0), top))).alias("pageno")).select("doc_id", "pageno", F.expr("substring(raw, pageno * 512 + 1, 512)").alias("data"))
    return toast.large_objects(pages, 512, "doc_id").select("doc_id", "size", "n_holes")


@query("SELECT coalesce(d.doc_id, o.o_orderkey) AS id, CASE WHEN o.o_orderkey IS NULL THEN 'data only' WHEN d.doc_id IS NULL THEN 'empty' ELSE 'both' END AS presence FROM (SELECT doc_id FROM documents) d FULL JOIN orders o ON o.o_orderkey = d.doc_id")
def large_object_full_outer(spark, folder):
    data = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    meta = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return toast.with_owners(data, meta, "id")


@query("SELECT doc_id, CAST(k AS INTEGER) AS step, CASE WHEN k < 0 THEN 'SELECT lo_create(' || doc_id || ');' ELSE 'SELECT lo_put(' || doc_id || ', ' || CAST(k * 4096 AS VARCHAR) || ', ''\\x' || substr(lower(hex(encode(text))), CAST(k AS BIGINT) * 8192 + 1, 8192) || ''');' END AS statement FROM documents, range(-1, (octet_length(encode(text)) + 4095) // 4096) r(k) WHERE text IS NOT NULL")
def large_object_sql(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return toast.large_object_sql(rows, "doc_id", "raw", 4096)


@query("SELECT toast_rel_id, count(*) AS n, count(*) FILTER (compressed) AS n_compressed, sum(raw_size)::BIGINT AS raw_size, sum(ext_size)::BIGINT AS ext_size FROM (SELECT DISTINCT * FROM toast_pointer) GROUP BY toast_rel_id")
def toast_usage(spark, folder):
    once = table(spark, folder, "toast_pointer").distinct()
    return once.groupBy("toast_rel_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("compressed").alias("n_compressed"), F.sum("raw_size").alias("raw_size"), F.sum("ext_size").alias("ext_size"))


# ---- encodings and reports ----


_UTF8 = "(?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9ABCEF][89AB].[89AB].|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[1-3](?:[89AB].){3}|F48.(?:[89AB].){2})*"


@query(f"""WITH b AS (SELECT rel_oid, page_no, substr(hex(raw), 2 * ({_le(22, 1)} + 5) + 1) h FROM heap_tuple WHERE octet_length(raw) > 24),
v AS (SELECT rel_oid, page_no, count(*) FILTER (regexp_matches(h, '^(?:..)*[89A-F]')) hi, count(*) FILTER (regexp_matches(h, '^(?:..)*[89A-F]') AND regexp_full_match(h, '{_UTF8}')) good FROM b GROUP BY ALL),
p AS (SELECT rel_oid, page_no, CASE WHEN hi = 0 THEN NULL WHEN good = hi THEN 'utf8' WHEN good = 0 THEN 'other' END vote FROM v),
s AS (SELECT rel_oid, max(page_no) - min(page_no) + 1 span, min(page_no) low FROM p GROUP BY 1),
c AS (SELECT p.rel_oid, count(vote) n, count(*) FILTER (vote = 'utf8') u FROM p JOIN s USING (rel_oid) WHERE (page_no - low) % greatest(CAST(ceil(span / 16.0) AS BIGINT), 1) = 0 GROUP BY 1)
SELECT rel_oid, n AS n_votes, CASE WHEN greatest(u, n - u) >= 2 AND greatest(u, n - u) * 3 >= n * 2 AND greatest(u, n - u) * 2 <> n THEN CASE WHEN u = greatest(u, n - u) THEN 'utf8' ELSE 'other' END END AS winner FROM c""")
def encoding_vote_by_pages(spark, folder):
    votes = encoding_vote.page_votes(table(spark, folder, "heap_tuple"), "rel_oid", "page_no", "raw")
    return encoding_vote.winners(votes, "rel_oid", "page_no")


def _entries(spark, folder):
    """Report entries: what the feed delivered of each relation against what the catalog tells of it."""
    actual = table(spark, folder, "heap_tuple").groupBy(F.col("rel_oid").alias("oid")).agg(F.count_distinct("row_id").alias("rows"), F.count_distinct("page_no").alias("pages"), F.count_if(F.col("raw").isNull()).alias("bad_blocks"))
    known = catalog.current_relations(table(spark, folder, "table_meta")).select("oid", "relpages", F.col("reltuples").cast("double").alias("reltuples"))
    lost = table(spark, folder, "toast_pointer").select("ptr_id", F.col("rel_oid").alias("oid"), "toast_rel_id").distinct()
    lost = lost.where("toast_rel_id <> 0").join(known.select(F.col("oid").alias("toast_rel_id")), "toast_rel_id", "left_anti").groupBy("oid").agg(F.count(F.lit(1)).alias("toast_missing"))
    rows = actual.join(known, "oid").join(lost, "oid", "left").withColumn("toast_missing", F.coalesce("toast_missing", F.lit(0)))
    rows = rows.withColumn("rows_state", report.rows_state(F.col("rows"), F.col("reltuples"))).withColumn("pages_state", report.pages_state(F.col("pages"), F.col("relpages")))
    return rows.withColumn("severity", report.severity())


_ENTRIES = f"""{_CM}, a AS (SELECT rel_oid oid, count(DISTINCT row_id) "rows", count(DISTINCT page_no) pages, count(*) FILTER (raw IS NULL) bad_blocks FROM heap_tuple GROUP BY 1),
lost AS (SELECT rel_oid oid, count(*) toast_missing FROM (SELECT DISTINCT ptr_id, rel_oid, toast_rel_id FROM toast_pointer) WHERE toast_rel_id <> 0 AND toast_rel_id NOT IN (SELECT oid FROM cm) GROUP BY 1),
e0 AS (SELECT a.*, cm.relpages, CAST(cm.reltuples AS DOUBLE) reltuples, coalesce(l.toast_missing, 0) toast_missing FROM a JOIN cm ON cm.oid = a.oid LEFT JOIN lost l ON l.oid = a.oid),
e1 AS (SELECT *, CASE WHEN reltuples IS NULL OR reltuples < 0 THEN 'unknown' WHEN abs("rows" - reltuples) <= 0.1 * reltuples THEN 'match' WHEN "rows" < reltuples THEN 'short' ELSE 'over' END rows_state, CASE WHEN relpages IS NULL OR relpages < 0 THEN 'unknown' WHEN pages < relpages THEN 'short' ELSE 'match' END pages_state FROM e0),
e AS (SELECT *, CASE WHEN pages_state = 'short' OR toast_missing > 0 THEN 2 WHEN bad_blocks > 0 OR rows_state IN ('short', 'over') THEN 1 ELSE 0 END severity FROM e1)"""


@query(f'WITH {_ENTRIES} SELECT oid, "rows", rows_state, pages_state, toast_missing, severity FROM e')
def rows_pages_check(spark, folder):
    return _entries(spark, folder).select("oid", "rows", "rows_state", "pages_state", "toast_missing", "severity")


@query(f"WITH {_ENTRIES} SELECT count(*) AS n_tables, sum(\"rows\")::BIGINT AS n_rows, count(*) FILTER (rows_state = 'short') AS n_short, count(*) FILTER (pages_state = 'short') AS n_short_pages, count(*) FILTER (toast_missing > 0) AS n_toast_missing, CASE max(severity) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS verdict FROM e")
def report_summary(spark, folder):
    return report.summary(_entries(spark, folder))


@query(f"WITH {_ENTRIES}, r AS (SELECT 'fewer pages than the catalog tells' reason FROM e WHERE pages_state = 'short' UNION ALL SELECT 'out-of-line values missing' FROM e WHERE toast_missing > 0 UNION ALL SELECT 'bad blocks' FROM e WHERE bad_blocks > 0 UNION ALL SELECT 'rows differ from the estimate' FROM e WHERE rows_state IN ('short', 'over')) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def verdict_fold(spark, folder):
    return report.reasons(_entries(spark, folder))


@query(f"WITH {_CC}, {_CT}, n AS (SELECT oid, typname, category FROM builtin_type UNION ALL SELECT oid, typname, category FROM ct) SELECT atttypid, CASE WHEN n.typname IS NULL THEN 'unresolved' WHEN n.category = 'U' THEN 'fallback' ELSE 'exact' END AS coverage, count(*) AS n_columns FROM cc LEFT JOIN n ON n.oid = atttypid GROUP BY 1, 2")
def type_coverage(spark, folder):
    cols = catalog.current_columns(table(spark, folder, "attr_row")).groupBy("atttypid").agg(F.count(F.lit(1)).alias("n_columns"))
    types = table(spark, folder, "builtin_type").select("oid", "typname", "category").unionByName(current_types(table(spark, folder, "type_def")).select("oid", "typname", "category"))
    rows = cols.join(types.withColumnRenamed("oid", "atttypid"), "atttypid", "left")
    return rows.select("atttypid", report.coverage_class(F.col("typname"), F.col("category")).alias("coverage"), "n_columns")


@query(f"WITH {_ENTRIES} SELECT CAST(to_json({{'n_tables': count(*), 'n_rows': sum(\"rows\")::BIGINT, 'bad_blocks': sum(bad_blocks)::BIGINT, 'n_ok': count(*) FILTER (severity = 0), 'n_warn': count(*) FILTER (severity = 1), 'n_fail': count(*) FILTER (severity = 2)}}) AS VARCHAR) AS report FROM e")
def report_json(spark, folder):
    """The report as one JSON document per run of the feed: totals and the worst tables."""
    entries = _entries(spark, folder)
    levels = [F.count_if(F.col("severity") == n).alias(name) for n, name in ((0, "n_ok"), (1, "n_warn"), (2, "n_fail"))]
    return entries.agg(F.count(F.lit(1)).alias("n_tables"), F.sum("rows").alias("n_rows"), F.sum("bad_blocks").alias("bad_blocks"), *levels).select(F.to_json(F.struct("*")).alias("report"))


# ---- heap files ----


def _heap_scan(spark, df, layout: str, **options):
    """Rows written as heap files into the shared folder and scanned again."""
    import uuid

    from pagewright.plans.lineage import remove_at_exit, shared_root
    from pagewright.sources.heap import register
    from pagewright.sources.pagewriter import write_heap

    register(spark)
    folder = f"{shared_root(spark)}/heap-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    write_heap(df, folder, layout).agg(F.sum("n_pages")).collect()  # one number
    reader = spark.read.format("pgheap").option("columns", layout)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(f"{folder}/*".removeprefix("file://"))


_ORDERS = "o_orderkey int8, o_custkey int8, o_orderstatus text, o_totalprice float8, o_orderdate timestamp, o_orderpriority text"


def _dirty_orders(spark, folder):
    """Orders with tuple headers: every tenth one deleted, every 23rd aborted, every 17th with an unknown delete."""
    key = F.col("o_orderkey")
    mask = F.when(key % 10 == 0, 0x500).when(key % 23 == 0, 0xA00).when(key % 17 == 0, 0x100).otherwise(0x900)
    return table(spark, folder, "orders").withColumn("_xmin", F.lit(700).cast("bigint")).withColumn("_xmax", F.when((key % 10 == 0) | (key % 17 == 0), 900).otherwise(0).cast("bigint")).withColumn("_infomask", mask)


@query("SELECT * FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 23 <> 0")
def heap_roundtrip_orders(spark, folder):
    rows = _heap_scan(spark, _dirty_orders(spark, folder), _ORDERS)
    live = rows.where(visibility.admitted(visibility.visibility(F.col("_infomask"), F.col("_xmax"))))
    return live.select(*[c for c in rows.columns if not c.startswith("_")])


@query("SELECT o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 23 <> 0 GROUP BY 1")
def heap_status_totals(spark, folder):
    rows = _heap_scan(spark, _dirty_orders(spark, folder), _ORDERS, select="o_orderstatus,o_totalprice")
    live = rows.where(visibility.admitted(visibility.visibility(F.col("_infomask"), F.col("_xmax"))))
    return live.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT event_id, ts, user_id, event_type FROM events")
def heap_roundtrip_events_ts(spark, folder):
    rows = _heap_scan(spark, table(spark, folder, "events"), "event_id int8, ts timestamp, user_id int8, event_type text")
    return rows.select("event_id", "ts", "user_id", "event_type")


@query("SELECT doc_id, text FROM documents")
def heap_carved_documents(spark, folder):
    """Whole texts up to a page through the fallback scan, longer ones through pieces and reassembly."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.when(F.length("text") > 1000, F.sequence(F.lit(0), (F.ceil(F.length("text") / 1000) - 1).cast("int"))).otherwise(F.array(F.lit(0)))).alias("seq"), "text")
    pieces = rows.select("doc_id", "seq", F.expr("substring(text, seq * 1000 + 1, 1000)").alias("data")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scanned = _heap_scan(spark, pieces, "doc_id int8, seq int4, data text", scanMode="carve")
    whole = toast.reassemble(scanned.where("data is not null").select("doc_id", "seq", "data"), "doc_id", "seq", "data")
    return scanned.select("doc_id").distinct().join(whole, "doc_id", "left").select("doc_id", F.col("value").alias("text"))
