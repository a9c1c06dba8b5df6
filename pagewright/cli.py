"""python -m pagewright.cli: tables, counts, exports and DDL of a data folder from the command line."""

from __future__ import annotations

import argparse
import glob
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright.ddl.scripts import delimiter, guard_output, import_script, output_path, session_header, split_names
from pagewright.operators import formatting
from pagewright.sources.control import relation_path


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    """The command line, with what excludes each other refused."""
    p = argparse.ArgumentParser("pagewright")
    p.add_argument("datadir")
    p.add_argument("--db-oid", type=int)
    p.add_argument("--tables", help="names, separated by commas")
    p.add_argument("--all-tables", action="store_true")
    p.add_argument("--schema")
    what = p.add_mutually_exclusive_group()
    for flag in ("sql", "data", "text", "count", "list", "list-all", "list-db", "roles", "roles-sql", "large-objects", "large-objects-sql", "export-meta", "full-schema", "pages"):
        what.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--ddl", action="store_true")
    p.add_argument("--fields")
    p.add_argument("--limit", type=int, default=0, help="0: all rows")
    seen = p.add_mutually_exclusive_group()
    seen.add_argument("--deleted", action="store_true")
    seen.add_argument("--only-deleted", action="store_true")
    p.add_argument("--clog", action="store_true", help="ask the commit log of the data folder")
    p.add_argument("--batch-rows", type=int, default=1)
    p.add_argument("--no-complete-insert", action="store_true")
    p.add_argument("--header", action="store_true")
    p.add_argument("--delimiter")
    p.add_argument("--encoding", default="auto", help="a codec; auto: by pg_database")
    p.add_argument("--page-size", type=int)
    p.add_argument("--tz")
    p.add_argument("--report", help="write what was found of the chosen tables as a JSON document to this folder")
    p.add_argument("--checksum", action="store_true", help="with --output: write size, crc32 and md5 of each file")
    p.add_argument("--import-script", help="with --output: write a shell script that loads the files")
    p.add_argument("--roles-nopassword", action="store_true")
    p.add_argument("--large-object-oids")
    p.add_argument("--output", "-o")
    a = p.parse_args(argv)
    if a.tables and a.all_tables:
        p.error("--tables and --all-tables exclude each other")
    if a.header and not a.data:
        p.error("--header goes with --data")
    if a.batch_rows > 1 and not a.sql:
        p.error("--batch-rows goes with --sql")
    if a.delimiter:
        if not (a.data or a.text):
            p.error("--delimiter goes with --data or --text")
        a.delimiter = delimiter(a.delimiter)
    if (a.checksum or a.import_script) and not a.output:
        p.error("--checksum and --import-script go with --output")
    if a.limit < 0 or a.batch_rows < 1:
        p.error("--limit and --batch-rows can't be negative")
    if a.page_size not in (None, 8192, 16384, 32768):
        p.error("--page-size is 8192, 16384 or 32768")
    return a


def show(df) -> None:
    """All rows, tabs between the values; a row at a time comes to the driver."""
    print(*df.columns, sep="\t")
    for r in df.toLocalIterator():
        print(*("" if v is None else v for v in r), sep="\t")


def statements(df) -> None:
    for r in df.orderBy("step", "name").select("statement").toLocalIterator():
        print(r.statement)


def main(argv: list[str] | None = None) -> None:
    a = parse(argv)
    from pagewright.operators import export
    from pagewright.operators.toast import page_statements
    from pagewright.sources import schema
    from pagewright.sources.bootstrap import Cluster, export_meta
    from pagewright.sources.control import databases

    spark = SparkSession.builder.appName("pagewright").config("spark.sql.session.timeZone", a.tz or "UTC").getOrCreate()
    if a.list_db:
        print(*databases(a.datadir), sep="\n")
        return
    cluster = Cluster(spark, a.datadir, a.db_oid)
    oids = [int(x) for x in a.large_object_oids.split(",")] if a.large_object_oids else None
    if a.list or a.list_all:
        show(cluster.tables(a.list_all).orderBy("schema_name", "relname"))
    elif a.roles:
        rows = cluster.roles()
        show(rows.drop("rolpassword") if a.roles_nopassword else rows)
    elif a.roles_sql:
        statements(schema.role_statements(cluster, not a.roles_nopassword))
    elif a.full_schema:
        print(session_header(timezone=a.tz), end="")
        statements(schema.database_statements(cluster))
    elif a.large_objects:
        show(cluster.large_objects(oids).drop("value"))
    elif a.large_objects_sql:
        pages = cluster.catalog("pg_largeobject").select("loid", "pageno", "data")
        for r in page_statements(pages.where(F.col("loid").isin(oids)) if oids else pages).orderBy("loid", "page").select("statement").toLocalIterator():
            print(r.statement)
    elif a.export_meta:
        export_meta(cluster).write.text(a.output or "meta.json")
    else:
        tables(a, spark, cluster, export)


def tables(a: argparse.Namespace, spark: SparkSession, cluster, export) -> None:
    """Counts, statements or rows of the chosen tables; a partitioned one stands for its leaves."""
    chosen = cluster.tables()
    if a.schema:
        chosen = chosen.where(F.col("schema_name") == a.schema)
    names = split_names(a.tables) if a.tables else [f"{r.schema_name}.{r.relname}" for r in chosen.where("relkind = 'r'").orderBy("schema_name", "relname").select("schema_name", "relname").collect()]
    parents = {n: cluster.leaves(n) for n in names if cluster.find(n)["relkind"] == "p"}
    names = [leaf for n in names for leaf in ((n,) if a.ddl else parents.get(n, (n,)))]
    mode = "deleted" if a.only_deleted else "all" if a.deleted else "live"
    encoding = cluster.encoding() if a.encoding == "auto" else a.encoding
    options = {"encoding": encoding, "temporal": "text"} | ({"pageSize": str(a.page_size)} if a.page_size else {})
    clog = cluster.commit_log() if a.clog else None
    total, written = 0, []
    if a.sql and not a.output:
        print(session_header(timezone=a.tz), end="")
    for name in names:
        rel = cluster.find(name)
        if a.count:
            n = cluster.count(name)
            total += n
            print(name, n)
            continue
        if a.ddl:
            print("\n".join(cluster.ddl(name)))
            continue
        if a.pages:
            show(cluster.pages(name))
            continue
        rows = cluster.read(name, mode, a.fields.split(",") if a.fields else None, clog, toast_state=True, place=True, **options)
        if a.limit:
            rows = rows.orderBy("_page", "_item").limit(a.limit)
        lost = rows.where(F.col("_toast_state").isNotNull()).count()
        if lost:
            print(f"{name}: {lost} rows with out-of-line values that aren't whole, exported as NULL", file=sys.stderr)
        form = "csv" if a.data else "text" if a.text else "sql"
        out = export.lines(rows, rel["relname"], form, a.delimiter or "", not a.no_complete_insert, a.batch_rows)
        if a.output:
            path = output_path(a.output, rel["schema_name"], rel["relname"], {"csv": "csv", "text": "txt", "sql": "sql"}[form])
            for source in (a.datadir, relation_path(cluster.root, cluster.database, rel["relfilenode"], rel["reltablespace"])):
                guard_output(path, [source])
            if os.path.realpath(path).startswith(os.path.realpath(a.datadir) + os.sep):
                raise ValueError(f"{path} lies inside the data folder")
            out.write.text(path)
            written.append((path, f"{rel['schema_name']}.{rel['relname']}"))
            continue
        if a.header:
            print(formatting.csv_header(export.shown(rows) + (["_state"] if "_state" in rows.columns else []), a.delimiter or ","))
        for r in out.toLocalIterator():
            print(r.value)
    if a.count and len(names) > 1:
        print("total", total)
    if a.report:
        export.report_document(export.entries(cluster, names)).write.mode("overwrite").text(a.report)
    files = [(p, t) for folder, t in written for p in sorted(glob.glob(f"{folder}/part-*"))]
    if a.checksum and files:
        export.checksums(spark, [p for p, _ in files]).orderBy("path").write.mode("overwrite").json(os.path.join(a.output, "checksums.json"))
    if a.import_script and files:
        kind = "" if not (a.data or a.text) else ".csv" if a.data else ".txt"
        with open(a.import_script, "w") as f:
            f.write(import_script([(p, t) for p, t in files], timezone=a.tz, form=kind))


if __name__ == "__main__":
    main()
