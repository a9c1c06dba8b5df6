import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import drift as D
from pagewright.plans import skew

ATTR = "attrelid bigint, snap_no int, attname string, atttypid bigint, attnum int, atttypmod int, attisdropped boolean, relnatts int, t_xmin bigint, pg_version int"


def brute(rows):
    snaps = {}
    for rel, no, name, typ, num, mod, dropped, natts, xmin, ver in rows:
        if rel is None or no is None:
            continue
        s = snaps.setdefault((rel, no), [ver, {}])
        if num is not None and natts is not None and 1 <= num <= natts:
            rank = (not dropped, xmin if xmin is not None else -1)
            if num not in s[1] or rank > s[1][num][0]:
                s[1][num] = (rank, name, typ, mod, bool(dropped))
    out = set()
    for rel in {r for r, _ in snaps}:
        nos = sorted(n for r, n in snaps if r == rel)
        for a, b in zip(nos, nos[1:]):
            (va, ca), (vb, cb) = snaps[rel, a], snaps[rel, b]
            key = (lambda num, c: num) if va == vb else (lambda num, c: c[1])
            old = {key(n, c): (n, c) for n, c in ca.items() if not c[4]}
            new = {key(n, c): (n, c) for n, c in cb.items() if not c[4]}
            for k in old.keys() - new.keys():
                out.add((rel, b, old[k][0], "removed"))
            for k in new.keys() - old.keys():
                out.add((rel, b, new[k][0], "added"))
            for k in old.keys() & new.keys():
                if old[k][1][1] != new[k][1][1]:
                    out.add((rel, b, new[k][0], "renamed"))
                if old[k][1][2:4] != new[k][1][2:4]:
                    out.add((rel, b, new[k][0], "retyped"))
    return out


def history(rng):
    rows, xmin = [], 0
    for rel in (1, 2, 3):
        names = [f"c{i}" for i in range(5)]
        for no in sorted(rng.sample(range(1, 12), 5)):
            ver = rng.choice([12, 13])
            if rng.random() < 0.6:
                names[rng.randrange(len(names))] = f"n{rng.randint(0, 99)}"
            if rng.random() < 0.4:
                rng.shuffle(names)
            for num, name in enumerate(names, 1):
                xmin += 1
                row = (rel, no, name, rng.choice([23, 23, 23, 25]), num, -1, rng.random() < 0.15, len(names), xmin, ver)
                rows += [row, row] if rng.random() < 0.2 else [row]
            rows.append((rel, no, "ctid", 27, -1, -1, False, len(names), 3, ver))
            rows.append((rel, no, "ghost", 23, len(names) + 1, -1, False, len(names), 3, ver))
    rng.shuffle(rows)
    return rows + [(None, 1, "x", 23, 1, -1, False, 1, 1, 12), (1, None, "x", 23, 1, -1, None, 1, None, 12)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [False, True])
def test_changes(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    rows = history(random.Random(seed))
    df = spark.createDataFrame(rows, ATTR).withColumn("before", F.lit(1)).withColumn("was", F.lit("clash")).withColumn("c", F.lit(2))
    got = [tuple(r) for r in D.column_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty(spark):
    assert D.column_changes(spark.createDataFrame([], ATTR)).count() == 0


def test_copy_fields(spark):
    line = "a\\tb\tplain\t\\N\t\t\\\\N\tback\\\\slash\\n"
    got = spark.createDataFrame([(line,), (None,)], "line string").select(D.copy_fields(F.col("line")).alias("v")).collect()
    assert got[0].v == ["a\tb", "plain", None, "", "\\N", "back\\slash\n"] and got[1].v is None


def test_unified(spark):
    attr = [(1, 1, "id", 23, 1, -1, False, 2, 1, 12), (1, 1, "old", 23, 2, -1, False, 2, 1, 12), (1, 2, "id", 23, 1, -1, False, 3, 1, 12), (1, 2, "new", 20, 2, -1, False, 3, 2, 12), (1, 2, "more", 25, 3, -1, False, 3, 2, 12)]
    records = [(10, 1, 1, "f", 12, 2, "5\tx", None), (11, 1, 1, "f", 12, 2, "5\tx", None), (12, 1, 2, "g", 12, 3, "6\t7\t\\N", None), (13, 1, 2, "g", 12, 3, "8", None), (14, 9, 2, "g", 12, 3, "8", None)]
    copy = spark.createDataFrame(records, "rec_id bigint, attrelid bigint, snap_no int, file_name string, pg_version int, natts int, line string, written_ts timestamp_ntz")
    rows = D.unified_rows(spark.createDataFrame(attr, ATTR), copy).collect()
    got = {(r.rec_id, r.attname): (r.value, r.cast_ok) for r in rows}
    assert got == {(10, "id"): ("5", True), (10, "new"): ("x", False), (10, "more"): (None, True), (12, "id"): ("6", True), (12, "new"): ("7", True), (12, "more"): (None, True), (13, "id"): ("8", True), (13, "new"): (None, True), (13, "more"): (None, True)}


def test_footers(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    file = next((tmp_path / "a").glob("part*"))
    (tmp_path / "bad").write_bytes(b"no parquet")
    rows = D.footer_catalogue(spark, [str(file), str(tmp_path / "bad")]).collect()
    assert {(r.position, r.field, r.field_type, r.rows) for r in rows} == {(1, "id", "int64", 3), (None, None, None, None)} or len(rows) == 2


def test_footers_of_a_folder_are_snapshots(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": pa.array([1], pa.int32()), "b": ["x"]}), tmp_path / "f1.parquet")
    pq.write_table(pa.table({"b": ["x"], "a": pa.array([1], pa.int64())}), tmp_path / "f2.parquet")
    pq.write_table(pa.table({"c": ["x"], "b": ["y"]}), tmp_path / "f3.parquet")
    (tmp_path / "f4.parquet").write_bytes(b"no parquet")
    footers = D.footer_catalogue(spark, [f"file://{tmp_path}/f1.parquet", *[str(tmp_path / f"f{i}.parquet") for i in (2, 3, 4)]])
    snaps = D.footer_snapshots(footers.withColumn("path", F.regexp_replace("path", "^file://", "")))
    got = {(r.snap_no, r.attnum, r.change_kind) for r in D.column_changes(snaps).collect()}
    assert got == {(2, 2, "retyped"), (3, 2, "removed"), (3, 1, "added")}


def test_one_relation_as_a_typed_table(spark):
    attr = [(1, 1, "id", 25, 1, -1, False, 2, 1, 12), (1, 1, "at", 25, 2, -1, False, 2, 1, 12), (1, 2, "id", 23, 1, -1, False, 2, 2, 12), (1, 2, "rec_id", 25, 2, -1, False, 2, 2, 12)]
    columns = "attrelid bigint, snap_no int, attname string, atttypid bigint, attnum int, atttypmod int, attisdropped boolean, relnatts int, t_xmin bigint, pg_version int"
    records = [(1, 1, 1, "f", 12, 2, "7\tx", None), (2, 1, 1, "f", 12, 2, "no\t\\N", None), (3, 1, 2, "g", 12, 1, " 9 ", None), (4, 2, 1, "h", 12, 1, "other", None)]
    copy = spark.createDataFrame(records, "rec_id bigint, attrelid bigint, snap_no int, file_name string, pg_version int, natts int, line string, written_ts timestamp")
    table = D.unified_table(spark.createDataFrame(attr, columns), copy, 1)
    assert dict(table.dtypes)["id"] == "int" and table.columns == ["rec_id", "snap_no", "id", "rec_id_2"]
    assert {(r.rec_id, r.id, r.rec_id_2) for r in table.collect()} == {(1, 7, "x"), (2, None, None), (3, 9, None)}
