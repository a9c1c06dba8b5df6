"""The queries of the core once more, as SQL for an independent engine."""

from __future__ import annotations

from pagewright.plans import registry

_CURRENT_META = "cm AS (SELECT oid, arg_max(struct_pack(p := part_parent, d := drop_ts, t := toast_rel_id, s := seen_ts), (t_xmin, row_no)) r, min(seen_ts) first_ts FROM table_meta WHERE oid IS NOT NULL GROUP BY oid)"
_CURRENT_TYPE = "ct AS (SELECT * FROM type_def WHERE oid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY oid ORDER BY t_xmin DESC, row_no DESC) = 1)"

_COLUMNS = """
w AS (SELECT * FROM attr_row WHERE attnum BETWEEN 1 AND relnatts
      QUALIFY row_number() OVER (PARTITION BY attrelid, snap_no, attnum ORDER BY coalesce(attisdropped, false), t_xmin DESC, attname DESC, atttypid DESC, atttypmod DESC) = 1),
s AS (SELECT *, lag(snap_no) OVER o prev_no, lag(ver) OVER o prev_ver FROM (SELECT attrelid, snap_no, max(pg_version) ver FROM attr_row GROUP BY ALL) WINDOW o AS (PARTITION BY attrelid ORDER BY snap_no)),
c AS (SELECT attrelid, snap_no, attnum, attname, atttypid, atttypmod FROM w WHERE NOT coalesce(attisdropped, false))"""

_P1_FOUND = f"""
WITH {_COLUMNS},
n AS (SELECT c.*, s.prev_no, s.ver IS NOT DISTINCT FROM s.prev_ver by_num FROM c JOIN s USING (attrelid, snap_no) WHERE prev_no IS NOT NULL),
o AS (SELECT c.* REPLACE (s.snap_no AS snap_no), s.ver IS NOT DISTINCT FROM s.prev_ver by_num FROM c JOIN s ON s.attrelid = c.attrelid AND s.prev_no = c.snap_no),
j AS (SELECT coalesce(n.attrelid, o.attrelid) attrelid, coalesce(n.snap_no, o.snap_no) snap_no, coalesce(n.attnum, o.attnum) attnum, n.attrelid IS NULL gone, o.attrelid IS NULL came,
      n.attname IS DISTINCT FROM o.attname other_name, n.atttypid IS DISTINCT FROM o.atttypid OR n.atttypmod IS DISTINCT FROM o.atttypmod other_type
      FROM n FULL JOIN o ON n.attrelid = o.attrelid AND n.snap_no = o.snap_no AND CASE WHEN n.by_num THEN n.attnum = o.attnum ELSE n.attname = o.attname END)
SELECT attrelid, snap_no, attnum, 'added' AS change_kind FROM j WHERE came
UNION ALL SELECT attrelid, snap_no, attnum, 'removed' FROM j WHERE gone
UNION ALL SELECT attrelid, snap_no, attnum, 'renamed' FROM j WHERE NOT came AND NOT gone AND other_name
UNION ALL SELECT attrelid, snap_no, attnum, 'retyped' FROM j WHERE NOT came AND NOT gone AND other_type"""

_P1_LIFESPANS = f"""
WITH {_COLUMNS},
x AS (SELECT s.*, lead(snap_no) OVER o next_no, lead(ver) OVER o next_ver FROM s WINDOW o AS (PARTITION BY attrelid ORDER BY snap_no)),
y AS (SELECT c.*, x.prev_no, x.next_no, x.ver IS NOT DISTINCT FROM x.prev_ver by_num, x.ver IS NOT DISTINCT FROM x.next_ver next_by_num FROM c JOIN x USING (attrelid, snap_no))
SELECT attrelid, snap_no, attnum, attname, atttypid, atttypmod,
  NOT EXISTS (SELECT 1 FROM c p WHERE p.attrelid = y.attrelid AND p.snap_no = y.prev_no AND p.attname = y.attname AND p.atttypid = y.atttypid AND p.atttypmod = y.atttypmod AND (NOT y.by_num OR p.attnum = y.attnum)) AS starts,
  NOT EXISTS (SELECT 1 FROM c p WHERE p.attrelid = y.attrelid AND p.snap_no = y.next_no AND p.attname = y.attname AND p.atttypid = y.atttypid AND p.atttypmod = y.atttypmod AND (NOT y.next_by_num OR p.attnum = y.attnum)) AS ends
FROM y"""

_FORESTS = f"""
{_CURRENT_META}, {_CURRENT_TYPE},
n0 AS (SELECT 'part' forest, oid, nullif(r.p, 0) up FROM cm
       UNION ALL SELECT 'type', oid, coalesce(nullif(base, 0), nullif(elem, 0)) FROM (SELECT oid, base, elem FROM ct UNION ALL SELECT oid, base, elem FROM builtin_type)),
n AS (SELECT a.forest, a.oid, b.oid up FROM n0 a LEFT JOIN n0 b ON a.forest = b.forest AND a.up = b.oid),
walk AS (SELECT forest, oid, oid cur, 0 d, [oid] seen, false again FROM n
         UNION ALL SELECT w.forest, w.oid, n.up, w.d + 1, list_append(w.seen, n.up), list_contains(w.seen, n.up) FROM walk w JOIN n ON n.forest = w.forest AND n.oid = w.cur WHERE n.up IS NOT NULL AND NOT w.again),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY forest, oid ORDER BY d DESC) = 1)"""

_P2_FOUND = f"""
WITH RECURSIVE {_FORESTS}
SELECT forest, oid AS node_id, CASE WHEN again THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id, CAST(CASE WHEN again THEN -1 ELSE d END AS INTEGER) AS node_depth
FROM last WHERE d > 0"""

_P2_HIERARCHY = f"""
WITH RECURSIVE {_FORESTS},
below AS (SELECT w.forest, w.cur oid, count(*) n FROM walk w JOIN last l ON l.forest = w.forest AND l.oid = w.oid WHERE NOT l.again GROUP BY ALL)
SELECT l.forest, l.oid AS node_id, CASE WHEN again THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id, CAST(CASE WHEN again THEN -1 ELSE d END AS INTEGER) AS node_depth,
  CASE WHEN NOT again THEN array_to_string(list_reverse(seen), '/') END AS path, CASE WHEN NOT again THEN b.n - 1 END AS n_descendants
FROM last l LEFT JOIN below b ON b.forest = l.forest AND b.oid = l.oid"""

_TUPLES = """
log AS (SELECT xid, arg_max(status, (seen_ts, status)) status FROM clog_status WHERE xid IS NOT NULL GROUP BY xid),
im AS (SELECT * FROM heap_tuple QUALIFY row_number() OVER (PARTITION BY rel_oid, page_no, item_no ORDER BY page_lsn DESC) = 1),
held AS (SELECT im.*, o.status out_status FROM im LEFT JOIN log i ON i.xid = t_xmin LEFT JOIN log o ON o.xid = t_xmax
         WHERE CASE WHEN t_infomask & 256 <> 0 THEN true WHEN t_infomask & 512 <> 0 THEN false WHEN t_xmin < 3 THEN true ELSE coalesce(i.status, 1) IN (1, 3) END),
top AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY rel_oid, row_id ORDER BY t_xmin DESC, page_no DESC, item_no DESC) = 1),
cur AS (SELECT * FROM top WHERE NOT CASE WHEN t_infomask & 2176 <> 0 THEN false WHEN t_infomask & 5120 <> 0 THEN true WHEN coalesce(t_xmax, 0) = 0 THEN false ELSE t_xmax < 3 OR coalesce(out_status, 0) IN (1, 3) END)"""

_REFERENCES = f"""
{_CURRENT_META}, {_CURRENT_TYPE},
refs AS (SELECT DISTINCT * FROM (SELECT 'constr_row' ref_table, con_oid ref_id, confrelid target, seen_ts FROM constr_row UNION ALL SELECT 'index_row', ind_index_rel_id, ind_rel_id, seen_ts FROM index_row
         UNION ALL SELECT 'toast_pointer', ptr_id, toast_rel_id, seen_ts FROM toast_pointer UNION ALL SELECT 'type_def', oid, typrelid, seen_ts FROM ct) WHERE target <> 0),
orphan AS (SELECT ref_table, ref_id, r.seen_ts, 'missing' reason FROM refs r WHERE target NOT IN (SELECT oid FROM cm)
           UNION ALL SELECT ref_table, ref_id, f.seen_ts, 'deleted' FROM refs f JOIN cm ON oid = target WHERE cm.r.d <= f.seen_ts
           UNION ALL SELECT ref_table, ref_id, f.seen_ts, 'late' FROM refs f JOIN cm ON oid = target WHERE first_ts > f.seen_ts)"""

SQL: dict[str, str] = {
    "p1_found": _P1_FOUND,
    "p1_lifespans": _P1_LIFESPANS,
    "p2_found": _P2_FOUND,
    "p2_hierarchy": _P2_HIERARCHY,
    "p3_found": f"WITH {_TUPLES} SELECT rel_oid, page_no, item_no FROM cur",
    "p3_rows": f"WITH {_TUPLES} SELECT rel_oid, page_no, item_no, row_id, t_xmin, val_text FROM cur",
    "p5_found": f"WITH {_REFERENCES} SELECT DISTINCT ref_table, ref_id, reason FROM orphan",
    "p5_report": f"WITH {_REFERENCES} SELECT ref_table, date_trunc('month', seen_ts) AS period, reason, count(*) AS n FROM orphan GROUP BY ALL",
}
SQL["p2_descendants"] = f"""WITH RECURSIVE {_FORESTS}
SELECT w.forest, w.cur AS node_id, w.oid AS descendant_id FROM walk w JOIN last l ON l.forest = w.forest AND l.oid = w.oid WHERE NOT l.again AND w.cur <> w.oid"""
SQL["p5_inherited"] = f"""WITH RECURSIVE {_REFERENCES},
direct AS (SELECT DISTINCT ref_table tbl, ref_id id, reason FROM orphan UNION SELECT 'table_meta', oid, 'missing' FROM cm WHERE cm.r.p <> 0 AND cm.r.p NOT IN (SELECT oid FROM cm)),
links AS (SELECT 'table_meta' tbl, oid id, 'table_meta' ptbl, cm.r.p pid FROM cm UNION SELECT 'constr_row', con_oid, 'table_meta', confrelid FROM constr_row UNION SELECT 'constr_row', con_oid, 'table_meta', conrelid FROM constr_row
  UNION SELECT 'index_row', ind_index_rel_id, 'table_meta', ind_rel_id FROM index_row UNION SELECT 'toast_pointer', ptr_id, 'table_meta', rel_oid FROM toast_pointer
  UNION SELECT 'type_def', oid, 'table_meta', typrelid FROM ct UNION SELECT 'type_def', oid, 'type_def', base FROM ct UNION SELECT 'type_def', oid, 'type_def', elem FROM ct),
lv AS (SELECT DISTINCT tbl, id, 0 lvl FROM direct UNION SELECT l.tbl, l.id, lvl + 1 FROM lv JOIN links l ON l.ptbl = lv.tbl AND l.pid = lv.id AND l.pid <> 0 WHERE lvl < 40),
low AS (SELECT tbl, id, min(lvl) lvl FROM lv GROUP BY ALL)
SELECT tbl AS "table", 0 AS level, reason, count(*) AS n FROM direct GROUP BY ALL UNION ALL SELECT tbl, lvl, 'inherited', count(*) FROM low WHERE lvl > 0 GROUP BY ALL"""
_LEVELS = SQL["p5_inherited"].rpartition("SELECT tbl AS")[0]
SQL["p5_by_level"] = f"""{_LEVELS.rstrip()},
born AS (SELECT tbl, id, min(seen_ts) seen_ts FROM (SELECT 'constr_row' tbl, con_oid id, seen_ts FROM constr_row UNION ALL SELECT 'index_row', ind_index_rel_id, seen_ts FROM index_row UNION ALL SELECT 'toast_pointer', ptr_id, seen_ts FROM toast_pointer
  UNION ALL SELECT 'type_def', oid, seen_ts FROM ct UNION ALL SELECT 'table_meta', oid, arg_max(seen_ts, (t_xmin, row_no)) FROM table_meta WHERE oid IS NOT NULL GROUP BY oid) GROUP BY ALL),
every AS (SELECT tbl, id, 0 AS level, reason FROM direct UNION ALL SELECT tbl, id, lvl, 'inherited' FROM low WHERE lvl > 0)
SELECT e.tbl AS ref_table, date_trunc('month', seen_ts) AS period, reason, level, count(*) AS n FROM every e LEFT JOIN born b ON b.tbl = e.tbl AND b.id = e.id GROUP BY ALL"""
SQL |= registry.SQL
