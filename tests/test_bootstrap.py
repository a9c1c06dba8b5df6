"""A small cluster written file by file, found and read without a server."""

import os
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewright.sources.bootstrap import CATALOG_OIDS, Cluster, catalog_layout, export_meta, find_by_content, load_meta
from pagewright.sources.layout import parse_columns
from pagewright.sources.pagewriter import make_pages

VERSION = 16


def put(folder, number, layout, rows):
    columns = parse_columns(layout)
    full = [([r.get(c.name, 0 if c.length > 0 and c.kind not in ("char", "name", "bool") else b"\0" if c.kind == "char" else bytes(64) if c.kind == "name" else False if c.kind == "bool" else None) for c in columns], r.get("_", {})) for r in rows]
    (folder / str(number)).write_bytes(b"".join(make_pages(columns, full)))


def name(text):
    return text.encode().ljust(64, b"\0")


@pytest.fixture(scope="module")
def cluster(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    db = root / "base" / "16384"
    db.mkdir(parents=True)
    (root / "global").mkdir()
    (root / "PG_VERSION").write_text("16\n")
    (root / "base" / "1").mkdir()
    rel = lambda oid, n, ns, node, kind=b"r", toast=0, **x: {"oid": oid, "relname": name(n), "relnamespace": ns, "relfilenode": node, "relkind": kind, "reltoastrelid": toast, "relnatts": 3, "relpages": 1, "reltuples": 2.0, **x}
    put(db, 1259, catalog_layout("pg_class", VERSION), [rel(1259, "pg_class", 11, 1259), rel(1249, "pg_attribute", 11, 1249), rel(16400, "t", 2200, 99, _={"xmax": 800, "infomask": 0x500}), rel(16400, "t", 2200, 16401, toast=16403), rel(16403, "pg_toast_16400", 99, 16404, b"t"), rel(16410, "t", 2300, 16410)])
    put(db, 2615, catalog_layout("pg_namespace", VERSION), [{"oid": 11, "nspname": name("pg_catalog")}, {"oid": 2200, "nspname": name("public")}, {"oid": 2300, "nspname": name("ops")}])
    att = lambda n, num, typ, length, align, **x: {"attrelid": 16400, "attname": name(n), "attnum": num, "atttypid": typ, "attlen": length, "attalign": align, "atttypmod": -1, **x}
    put(db, 1249, catalog_layout("pg_attribute", VERSION), [att("id", 1, 23, 4, b"i", attnotnull=True), att("gone", 2, 0, 4, b"i", attisdropped=True), att("v", 3, 25, -1, b"i"), att("ctid", -1, 27, 6, b"s"), {**att("id", 1, 23, 4, b"i"), "attrelid": 16410}])
    put(db, 16401, "id int4, gone int4, v text", [{"id": 1, "v": "a"}, {"id": 2, "v": "b", "_": {"xmax": 900, "infomask": 0x500}}, {"id": 3, "v": "c", "_": {"xmax": 901, "infomask": 0x100}}, {"id": 4, "v": "d", "_": {"infomask": 0xA00}}])
    put(db, 16404, "chunk_id oid, chunk_seq int4, chunk_data bytea", [{"chunk_id": 7, "chunk_seq": 1, "chunk_data": b"def"}, {"chunk_id": 7, "chunk_seq": 0, "chunk_data": b"abc"}, {"chunk_id": 8, "chunk_seq": 1, "chunk_data": b"x"}])
    put(db, 2613, catalog_layout("pg_largeobject", VERSION), [{"loid": 5, "pageno": 0, "data": b"ab"}, {"loid": 5, "pageno": 2, "data": b"z"}])
    put(db, 2995, catalog_layout("pg_largeobject_metadata", VERSION), [{"oid": 5, "lomowner": 10}, {"oid": 6, "lomowner": 10}])
    put(root / "global", 1260, catalog_layout("pg_authid", VERSION), [{"oid": 10, "rolname": name("boss"), "rolsuper": True}])
    return Cluster(spark, str(root))


def test_discovery(cluster):
    assert cluster.database == 16384
    found = {(r.schema_name, r.relname, r.oid, r.relfilenode, r.toast_filenode) for r in cluster.tables().collect()}
    assert found == {("public", "t", 16400, 16401, 16404), ("ops", "t", 16410, 16410, None)}
    assert cluster.find("t")["oid"] == 16400 and cluster.find("ops.t")["oid"] == 16410
    with pytest.raises(LookupError):
        cluster.find("nothing")


def test_rows(cluster):
    assert [(r.id, r.v) for r in cluster.read("t").orderBy("id").collect()] == [(1, "a"), (3, "c")]
    assert {(r.id, r._state) for r in cluster.read("t", "all").collect()} == {(1, "live"), (2, "deleted"), (3, "suspected")}
    assert {r.id for r in cluster.read("t", "deleted").collect()} == {2, 3} and cluster.count("t") == 2
    log = cluster.spark.createDataFrame([(901, 1), (100, 1)], "xid bigint, status int")
    assert {r.id for r in cluster.read("t", clog=log).collect()} == {1}
    assert cluster.read("t", select=["v"]).columns == ["v"]
    assert cluster.ddl("t") == ["CREATE TABLE public.t (\n    id integer NOT NULL,\n    v text\n);"]


def test_toast_roles_and_large_objects(cluster):
    assert {r.chunk_id: (r.value, r.state) for r in cluster.toast_values("t").collect()} == {7: (bytearray(b"abcdef"), "ok"), 8: (None, "gap")}
    assert [r.rolname for r in cluster.roles().where("rolsuper").collect()] == ["boss"]
    objects = {r.loid: (r.size, r.presence) for r in cluster.large_objects().collect()}
    assert objects == {5: (4097, "both"), 6: (None, "empty")} and cluster.large_objects([6]).count() == 1


def test_catalog_file_by_content(cluster):
    folder = os.path.join(cluster.root, "base", "16384")
    os.rename(os.path.join(folder, "1259"), os.path.join(folder, "4444"))
    try:
        assert find_by_content(folder, ("pg_class", "pg_attribute")) == os.path.join(folder, "4444")
        assert cluster.tables().count() == 2
    finally:
        os.rename(os.path.join(folder, "4444"), os.path.join(folder, "1259"))


def test_meta_round_trip(cluster, tmp_path):
    export_meta(cluster).write.text(str(tmp_path / "meta"))
    rows = {r.relname: r for r in load_meta(cluster.spark, str(tmp_path / "meta")).where(F.col("schema_name") == "public").collect()}
    assert rows["t"].relfilenode == 16401 and [c.attname for c in rows["t"].columns] == ["id", "gone", "v"]


@pytest.mark.parametrize("version", range(12, 19))
def test_layouts(version):
    for name in ("pg_class", "pg_attribute", "pg_type", "pg_index", *(n for n in ("pg_enum", "pg_inherits") if n in CATALOG_OIDS)):
        assert parse_columns(catalog_layout(name, version))


def test_pieces_without_their_last_are_short(spark):
    from pagewright.operators.toast import reassemble

    rows = [(1, 0, b"ab", 5), (1, 1, b"cd", 5), (2, 0, b"ab", 3), (2, 1, b"c", 3), (3, 0, b"a", None), (4, 1, b"a", 2)]
    got = reassemble(spark.createDataFrame(rows, "id int, seq int, data binary, size bigint"), "id", "seq", "data", "size").collect()
    assert {r.id: (r.state, r.value) for r in got} == {1: ("short", None), 2: ("ok", b"abc"), 3: ("ok", b"a"), 4: ("gap", None)}


def test_out_of_line_values_are_read(spark, cluster):
    """Whole, compressed, short, missing and in-line values of one column."""
    folder = os.path.join(cluster.root, "base", "16384")
    pointer = lambda raw, ext, value, method=0: bytearray(b"\x01\x12" + struct.pack("<IIII", raw + 4, ext | method << 30, value, 16403))
    packed = struct.pack("<I", 24) + b"\x00abcdefgh\x01\x0d\x08"
    old = {n: open(os.path.join(folder, n), "rb").read() for n in ("16401", "16404")}
    try:
        put(Path(folder), 16401, "id int4, gone int4, v text", [{"id": 1, "v": "a"}, {"id": 2, "v": pointer(6, 6, 7)}, {"id": 3, "v": pointer(24, len(packed), 9)}, {"id": 4, "v": pointer(9, 9, 7)}, {"id": 5, "v": pointer(5, 5, 55)}, {"id": 6, "v": None}])
        chunks = [(7, 1, b"def"), (7, 0, b"abc"), (9, 0, packed)]
        put(Path(folder), 16404, "chunk_id oid, chunk_seq int4, chunk_data bytea", [{"chunk_id": i, "chunk_seq": n, "chunk_data": d} for i, n, d in chunks])
        rows = {r.id: (r.v, r._toast_state) for r in cluster.read("t", toast_state=True).collect()}
        assert rows == {1: ("a", None), 2: ("abcdef", None), 3: ("abcdefgh" * 3, None), 4: (None, {"v": "short"}), 5: (None, {"v": "missing"}), 6: (None, None)}
        assert cluster.read("t").columns == ["id", "v"]
    finally:
        for n, data in old.items():
            Path(folder, n).write_bytes(data)
