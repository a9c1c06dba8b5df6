import pytest

from pagewright.cli import parse


def test_options():
    a = parse(["d", "--tables", "t", "--data", "--header", "--delimiter", "\\t"])
    assert a.delimiter == "\t" and a.limit == 0


@pytest.mark.parametrize("argv", [["d", "--sql", "--data"], ["d", "--deleted", "--only-deleted"], ["d", "--header"], ["d", "--tables", "a", "--all-tables"], ["d", "--batch-rows", "5"], ["d", "--delimiter", ";"], ["d", "--limit", "-1"], ["d", "--page-size", "5"], ["d", "--unknown"], []])
def test_what_excludes_each_other(argv):
    with pytest.raises(SystemExit):
        parse(argv)


def test_exports_of_a_folder(spark, cluster_folder, tmp_path, capsys):
    from pagewright.cli import main

    main([cluster_folder, "--tables", "public.t", "--sql", "--deleted"])
    assert capsys.readouterr().out.splitlines()[2:] == ['INSERT INTO "t" ("id", "v") VALUES (1, \'a\');', "-- DELETED ctid=(0,2)", 'INSERT INTO "t" ("id", "v") VALUES (2, \'b\');', "-- SUSPECTED_DELETED ctid=(0,3)", 'INSERT INTO "t" ("id", "v") VALUES (3, \'c\');', 'INSERT INTO "t" ("id", "v") VALUES (5, \'e\');', 'INSERT INTO "t" ("id", "v") VALUES (6, \'f\');']
    main([cluster_folder, "--tables", "public.t", "--sql", "--deleted", "--batch-rows", "2"])
    assert capsys.readouterr().out.splitlines()[2:] == ['INSERT INTO "t" ("id", "v") VALUES (1, \'a\');', "-- DELETED ctid=(0,2)", 'INSERT INTO "t" ("id", "v") VALUES (2, \'b\');', "-- SUSPECTED_DELETED ctid=(0,3)", 'INSERT INTO "t" ("id", "v") VALUES (3, \'c\');', 'INSERT INTO "t" ("id", "v") VALUES (5, \'e\'), (6, \'f\');']
    main([cluster_folder, "--tables", "t", "--data", "--limit", "2"])
    assert capsys.readouterr().out.splitlines() == ["1,a", "3,c"]
    main([cluster_folder, "--tables", "t", "--count"])
    assert capsys.readouterr().out.split() == ["t", "4"]
    out = tmp_path / "out"
    main([cluster_folder, "--tables", "t", "--text", "-o", str(out), "--checksum", "--import-script", str(tmp_path / "load.sh"), "--report", str(tmp_path / "report")])
    assert "\n".join(p.read_text().strip() for p in sorted(out.glob("public.t.txt/part-*"))).splitlines() == ["1\ta", "3\tc", "5\te", "6\tf"]
    assert "\\copy public.t from" in (tmp_path / "load.sh").read_text() and len(spark.read.json(str(out / "checksums.json")).first().md5) == 32
    import json

    report = json.loads(spark.read.text(str(tmp_path / "report")).first().value)
    assert report["n_rows"] == 4 and report["tables"][0]["entry"]["states"] == {"ok": 1}
    with pytest.raises(ValueError):
        main([cluster_folder, "--tables", "t", "--text", "-o", cluster_folder])
    main([cluster_folder, "--full-schema"])
    assert "CREATE TABLE public.t (\n    id integer NOT NULL,\n    v text\n);" in capsys.readouterr().out
    main([cluster_folder, "--list"])
    assert "public\tt\tr" in capsys.readouterr().out


@pytest.fixture(scope="module")
def cluster_folder(spark, tmp_path_factory):
    from pagewright.sources.bootstrap import CATALOG_OIDS, catalog_layout
    from pagewright.sources.layout import parse_columns
    from pagewright.sources.pagewriter import make_pages

    root = tmp_path_factory.mktemp("data")
    for part in ("base/16384", "base/1", "global"):
        (root / part).mkdir(parents=True)
    (root / "PG_VERSION").write_text("16\n")

    def put(number, layout, rows):
        columns = parse_columns(layout)
        zero = lambda c: None if c.length < 0 or c.kind == "timestamptz" else "" if c.kind in ("name", "char") else 0
        (root / "base/16384" / str(number)).write_bytes(b"".join(make_pages(columns, [([r.get(c.name, zero(c)) for c in columns], r.get("_", {})) for r in rows])))

    put(1259, catalog_layout("pg_class", 16), [{"oid": 16400, "relname": "t", "relnamespace": 2200, "relfilenode": 16400, "relkind": "r", "reltuples": 4.0, "relpages": 1}])
    put(2615, catalog_layout("pg_namespace", 16), [{"oid": 2200, "nspname": "public"}])
    put(1249, catalog_layout("pg_attribute", 16), [{"attrelid": 16400, "attname": n, "attnum": i, "atttypid": t, "attlen": size, "attalign": "i", "atttypmod": -1, "attnotnull": i == 1} for i, (n, t, size) in enumerate((("id", 23, 4), ("v", 25, -1)), 1)])
    dead, open_ = {"xmax": 900, "infomask": 0x500}, {"xmax": 901, "infomask": 0x100}
    put(16400, "id int4, v text", [{"id": i, "v": v, "_": m} for i, v, m in ((1, "a", {}), (2, "b", dead), (3, "c", open_), (4, "d", {"infomask": 0xA00}), (5, "e", {}), (6, "f", {}))])
    assert CATALOG_OIDS["pg_class"] == 1259
    return str(root)
