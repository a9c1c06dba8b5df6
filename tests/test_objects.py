import pytest

from pagewright.ddl import scripts as S
from pagewright.functions import containers as B
from pagewright.functions import decode as D
from pagewright.operators import objects as O


def test_roles_and_enums(spark):
    roles = spark.createDataFrame([(10, "pg_boss"), (20000, "a"), (20001, "b"), (3, "x")], "oid bigint, rolname string")
    members = spark.createDataFrame([(20000, 20001, False), (20000, 20001, True), (20000, 10, True), (20000, 3, True), (99, 20001, True)], "roleid bigint, member bigint, admin_option boolean")
    assert [tuple(r) for r in O.role_grants(members, roles).collect()] == [("a", "b", True)]
    enums = spark.createDataFrame([(1, 2.0, "ok"), (1, 1.0, "sad"), (1, 1.5, "meh")], "enumtypid bigint, enumsortorder float, enumlabel string")
    assert O.enum_labels(enums).first().labels == ["sad", "meh", "ok"]


def test_sequences_views_and_signatures(spark):
    rel = spark.createDataFrame([(1, "public", "s", "S"), (2, "public", "t", "r"), (3, "public", "v", "v"), (4, "public", "free", "S")], "oid bigint, schema_name string, relname string, relkind string")
    defs = spark.createDataFrame([(1, 5), (4, 1)], "seqrelid bigint, seqincrement bigint")
    deps = spark.createDataFrame([(1, 2, 1, "a"), (3, 2, 0, "n"), (3, 2, 1, "n"), (3, 3, 0, "n")], "objid bigint, refobjid bigint, refobjsubid int, deptype string")
    states = spark.createDataFrame([(1, 77, True)], "oid bigint, last_value bigint, is_called boolean")
    cols = spark.createDataFrame([(2, 1, "id")], "attrelid bigint, attnum int, attname string")
    rows = {r.relname: r for r in O.sequences(rel, defs, deps, states, cols).collect()}
    assert (rows["s"].owner_table, rows["s"].owner_column, rows["s"].last_value, rows["s"].seqincrement) == ("t", "id", 77, 5) and rows["free"].owner_table is None
    assert O.view_dependencies(rel.where("relkind = 'v'"), deps, rel).first().needs == ["public.t"]
    functions = spark.createDataFrame([(1, "f", [23, 99]), (2, "g", [])], "oid bigint, proname string, proargtypes array<bigint>")
    types = spark.createDataFrame([(23, "int4")], "oid bigint, typname string")
    assert {r.oid: r.signature for r in O.signatures(functions, types).collect()} == {1: "f(int4, 99)", 2: "g()"}
    fields = spark.createDataFrame([(9, 2, "b", 25, False), (9, 1, "a", 23, False), (9, 3, "c", 23, True)], "attrelid bigint, attnum int, attname string, atttypid bigint, attisdropped boolean")
    assert [tuple(f) for f in O.composite_fields(fields).first().fields] == [("a", 23), ("b", 25)]


def test_literals_taken_apart():
    assert B.parse_array('{a,"b c",NULL,"NULL",{x,"q\\""}}') == ["a", "b c", None, "NULL", ["x", 'q"']] and B.parse_array("[0:1]={1,2}") == ["1", "2"] and B.parse_array("{}") == []
    assert B.parse_record('(a,"b ""c""",,"")') == ["a", 'b "c"', None, ""] and B.parse_record("()") == [None]
    for bad in ("{", "{a", "{a}x", "a", "{a,,"):
        with pytest.raises(B.Malformed):
            B.parse_array(bad)
    with pytest.raises(B.Malformed):
        B.parse_record('(a,"b)')
    assert B.at_risk([[65, None], [200]]) and not B.at_risk([65, None]) and B.char_array([[65, None], [200, 0]]).startswith("ARRAY[['A'") and "\\310" in B.char_array([200]) and B.char_array([]) == "'{}'::\"char\"[]"
    assert B.char_record(["1", "'a'"], "t") == "ROW(1, 'a')::t"


@pytest.mark.parametrize("kind,raw,want", [("int16", (-5).to_bytes(16, "little", signed=True), "-5"), ("blob", b"a\\\x00", "a\\\\\\000"), ("binary", b"\xab", "0xAB"), ("mysqltime", (-90_000_000_000).to_bytes(8, "little", signed=True), "-25:00:00")])
def test_other_engine_types(kind, raw, want):
    assert D.decode(kind, raw) == want


def test_small_helpers():
    assert S.mask_secret("abcdefghij") == "ab******ij" and S.mask_secret("abc") == "***"
    assert S.compatibility("#database_mode = pg\ndatabase_mode = 'Oracle'") == "oracle" and S.compatibility("", ["TINYINT"]) == "mysql" and S.compatibility("") == "pg"
    assert S.timezone_hint([("a", "timestamptz"), ("b", "int4")], None) == "no time zone is known for: a" and S.timezone_hint([("a", "timestamptz")], "UTC") == ""
    assert S.last_segment_full(1 << 30) and not S.last_segment_full(8192) and S.progress_line(50, 100, 10, 5.0) == "50% of 100 pages, 10 rows, 5 s, 5 s left"
