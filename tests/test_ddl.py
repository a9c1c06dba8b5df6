import pytest

from pagewright.ddl import nodetree as N
from pagewright.ddl import objects as O
from pagewright.ddl import scripts as S


def const(oid, data, length, null="false"):
    return f"{{CONST :consttype {oid} :consttypmod -1 :constcollid 0 :constlen {length} :constbyval true :constisnull {null} :location 1 :constvalue {len(data)} [ {' '.join(map(str, data))} ]}}"


INT5 = const(23, [5, 0, 0, 0, 0, 0, 0, 0], 4)
TEXT = const(25, [(4 + 2) << 2, 0, 0, 0, 97, 39], -1)
VAR1, VAR2 = ("{VAR :varno 1 :varattno %d :vartype 23}" % i for i in (1, 2))


@pytest.mark.parametrize("tree,want", [
    (INT5, "5"), (TEXT, "'a'''::text"), (const(23, [251, 255, 255, 255, 255, 255, 255, 255], 4), "(-5)"), (const(16, [1, 0, 0, 0], 1), "true"), (const(1082, [0] * 8, 4), "'2000-01-01'::date"),
    (f"{{OPEXPR :opno 521 :args ({VAR1} {INT5})}}", "id > 5"),
    (f"{{BOOLEXPR :boolop and :args ({{OPEXPR :opno 521 :args ({VAR1} {INT5})}} {{NULLTEST :arg {VAR2} :nulltesttype 1}})}}", '(id > 5) AND ("Name" IS NOT NULL)'),
    (f"{{BOOLEXPR :boolop not :args ({{NULLTEST :arg {VAR1} :nulltesttype 0}})}}", "NOT (id IS NULL)"),
    (f"{{OPEXPR :opno 514 :args ({{OPEXPR :opno 551 :args ({VAR1} {INT5})}} {INT5})}}", "(id + 5) * 5"),
    (f"{{SCALARARRAYOPEXPR :opno 96 :useOr true :args ({VAR1} {{ARRAYEXPR :elements ({INT5} {INT5})}})}}", "id = ANY (ARRAY[5, 5])"),
    (f"{{FUNCEXPR :funcid 870 :funcformat 0 :args ({VAR2})}}", 'lower("Name")'), (f"{{FUNCEXPR :funcid 1574 :funcformat 0 :args ({const(2205, [7, 0, 0, 0], 4)})}}", "nextval('s.q'::regclass)"),
    (f"{{RELABELTYPE :arg {VAR2} :resulttype 25 :resulttypmod -1 :relabelformat 1}}", '"Name"::text'), ("{COERCETODOMAINVALUE :typeId 23}", "VALUE"),
    ("{WINDOWFUNC :x 1}", ""), ("{OPEXPR :opno 999999 :args ()}", ""), ("{broken", ""), ("", ""), ("}" * 50, ""), ("{" * 3000, ""), ("(" * 3000, ""),
])
def test_deparse(tree, want):
    assert N.Deparser(["id", "Name"], sequences={7: "s.q"}).text(tree) == want


def test_lists_and_bounds():
    assert N.Deparser(["id"]).list(f"({VAR1} {INT5})") == ["id", "5"]
    assert N.partition_bound("{PARTITIONBOUNDSPEC :strategy r :is_default true}") == "DEFAULT"
    assert N.partition_bound(f"{{PARTITIONBOUNDSPEC :strategy l :is_default false :listdatums ({INT5} {TEXT})}}") == "FOR VALUES IN (5, 'a''')"
    assert N.partition_bound("{PARTITIONBOUNDSPEC :strategy h :is_default false :modulus 4 :remainder 1}") == "FOR VALUES WITH (modulus 4, remainder 1)"
    range_ = f"{{PARTITIONBOUNDSPEC :strategy r :is_default false :lowerdatums ({{PARTITIONRANGEDATUM :kind -1 :value <>}}) :upperdatums ({{PARTITIONRANGEDATUM :kind 0 :value {INT5}}})}}"
    assert N.partition_bound(range_) == "FOR VALUES FROM (MINVALUE) TO (5)" and N.partition_bound("junk") == ""


def test_types():
    assert N.type_text(1043, 14) == "character varying(10)" and N.type_text(1700, (10 << 16 | 2) + 4) == "numeric(10,2)" and N.type_text(1700, (5 << 16 | 0x7FD) + 4) == "numeric(5,-3)"
    assert N.type_text(1007) == "integer[]" and N.type_text(1114, 3) == "timestamp(3) without time zone" and N.type_text(77777, -1, {77777: "Mood"}) == '"Mood"'


def test_tables():
    t = O.Table('quo"ted', 's"ch', [O.Column("id", "integer", True), O.Column("m", "mood", default="'ok'::mood"), O.Column("gone", "int", dropped=True), O.Column("g", "int", generated="id + 1"), O.Column("i", "int", identity="a", comment="it's")], ["id"], checks={"c1": "id > 0", "c2": ""}, comment="t")
    text = "\n".join(O.table_sql(t))
    assert 'CREATE TABLE "s""ch"."quo""ted" (' in text and "PRIMARY KEY (id)" in text and "gone" not in text and "GENERATED ALWAYS AS (id + 1) STORED" in text and "AS IDENTITY" in text and "-- CHECK c2" in text and "IS 'it''s'" in text
    assert "PRIMARY KEY" not in "\n".join(O.table_sql(t, ["created"])) and O.covers(["id", "created"], ["created"])
    assert O.table_sql(O.Table("c", None, partition_of="p", bound="DEFAULT", unlogged=True)) == ["CREATE UNLOGGED TABLE c PARTITION OF p DEFAULT;"]
    assert O.partition_clause("h", ["id"]) == "HASH (id)"


def test_other_objects():
    assert O.index_sql("i", "t", ["a", "lower(b)"], True, include=["c"], where="a > 0") == "CREATE UNIQUE INDEX i ON t USING btree (a, lower(b)) INCLUDE (c) WHERE a > 0;"
    assert O.foreign_key_sql("f", "t", ["a"], "u", ["b"], "c", "a", False) == "ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES u (b) ON DELETE CASCADE NOT VALID;"
    assert O.exclude_sql("e", "t", [("r", "&&")]).endswith("EXCLUDE USING gist (r WITH &&);")
    assert O.enum_sql("mood", ["sad", "it's"]) == "CREATE TYPE mood AS ENUM ('sad', 'it''s');" and O.domain_sql("d", "int", True, "0", {"c": "VALUE > 0"}) == "CREATE DOMAIN d AS int DEFAULT 0 NOT NULL CONSTRAINT c CHECK (VALUE > 0);"
    assert O.composite_sql("c", [("a", "int")]) == "CREATE TYPE c AS (a int);"
    assert O.sequence_sql("s", last=5)[-1] == "SELECT setval('s', 5, true);"
    assert O.trigger_sql("g", "t", "f", 1 | 2 | 4 | 16, ["a"]) == "CREATE TRIGGER g BEFORE INSERT OR UPDATE OF a ON t FOR EACH ROW EXECUTE FUNCTION f();"
    assert "VARIADIC xs int[]" in O.function_sql("f", [O.Argument("int", "a"), O.Argument("int[]", "xs", "v")], "int", "sql", "SELECT '$$'") and "$body1$" in O.function_sql("f", [], "int", "sql", "$$")
    assert O.view_sql("v", "", needs=["b", "a", "a"]) == "-- view v depends on: a, b" and O.schema_sql(["public", "pg_temp_3", "b", "a", "a"]) == ["CREATE SCHEMA IF NOT EXISTS a;", "CREATE SCHEMA IF NOT EXISTS b;"]
    order = O.type_order({"a": ["b", "c"], "b": ["c"], "c": ["a"], "d": ["missing"]})
    assert sorted(order) == ["a", "b", "c", "d"] and O.type_order({"x": ["y"], "y": ["z"], "z": []}) == ["z", "y", "x"]


def test_roles():
    out = O.role_sql([O.Role("b", login=True, password="x'y", limit=3), O.Role("pg_read", 3000), O.Role("a")], [("a", "b", True), ("a", "b", True), ("a", "pg_read", False)])
    assert len(out) == 3 and "PASSWORD 'x''y'" in out[1] and out[2] == "GRANT a TO b WITH ADMIN OPTION;"
    assert "PASSWORD" not in "".join(O.role_sql([O.Role("b", password="x")], (), False))


def test_scripts(tmp_path):
    assert "SET timezone = 'UTC';" in S.session_header(timezone="UTC") and S.file_component('a/b:"c') == "a_b__c"
    source = tmp_path / "16400"
    source.write_bytes(b"x")
    (tmp_path / "16400.1").write_bytes(b"y")
    (tmp_path / "link").symlink_to(tmp_path / "16400.1")
    for bad in ("16400", "16400.1", "link"):
        with pytest.raises(ValueError):
            S.guard_output(str(tmp_path / bad), [str(source)])
    S.guard_output(str(tmp_path / "out.sql"), [str(source)])
    script = S.import_script([("b.csv", "t"), ("a.post.sql", "t"), ("z.ddl.sql", "t")], "db", "Asia/Tokyo")
    assert script.index("z.ddl.sql") < script.index("b.csv") < script.index("a.post.sql") and "PGTZ" in script
    assert S.split_names('A, "B,c"."D""e" , x.y') == ["a", 'B,c.D"e', "x.y"] and S.delimiter("\\t") == "\t"
    with pytest.raises(ValueError):
        S.delimiter("ab")
