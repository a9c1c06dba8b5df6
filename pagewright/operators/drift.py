"""Schemas that drift between files: a column lifespan catalogue, the log of changes, one table of the latest columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.hierarchy import resolve
from pagewright.plans.lineage import materialize
from pagewright.plans.skew import previous, skew_join

#: Casts that keep every value, by (from, to) type oid; what isn't here is tried and yields NULL where it fails.
#: Type oids of bool 16, int8 20, int2 21, int4 23, text 25, float4 700, float8 701, bpchar 1042,
#: varchar 1043, date 1082, timestamp 1114, numeric 1700, uuid 2950, jsonb 3802.
TYPE_ALIASES: Mapping[int, str] = {
    16: "boolean",
    20: "bigint",
    21: "smallint",
    23: "int",
    25: "string",
    700: "float",
    701: "double",
    1042: "string",
    1043: "string",
    1082: "date",
    1114: "timestamp_ntz",
    1700: "decimal(38,10)",
    2950: "string",
    3802: "string",
}


def footer_catalogue(spark: SparkSession, paths: Sequence[str], slices: int | None = None) -> DataFrame:
    """Footers of Parquet files, one row per file and top-level field: path, position (from 1), field, field_type, rows.

    The footers are read on the executors, one file per input row; only the paths come from the driver. An unreadable
    file gives one row with NULL field.
    """

    def read(batches):
        import pandas as pd
        import pyarrow.fs as pf
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    store, place = pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)
                    meta = pq.ParquetFile(place, filesystem=store)
                    out += [(path, i + 1, f.name, str(f.type), meta.metadata.num_rows) for i, f in enumerate(meta.schema_arrow)]
                except Exception:
                    out.append((path, None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "position", "field", "field_type", "rows"])

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(slices or max(1, min(len(paths), 512))).mapInPandas(read, "path string, position int, field string, field_type string, rows bigint")


def footer_snapshots(footers: DataFrame) -> DataFrame:
    """footer_catalogue() as rows of catalog snapshots, for lifespans() and column_changes(): a folder is a relation
    (attrelid, a hash of its path; `folder` beside it), a file a snapshot (snap_no by name, `path` beside it).

    Every file counts as a release of its own, so fields are matched by name; field types are told apart by a hash.
    Unreadable files give no rows.
    """
    rows = footers.where("field is not null").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    files = rows.select("folder", "path").distinct()
    files = files.withColumn("snap_no", F.row_number().over(Window.partitionBy("folder").orderBy("path")))  # one row a file
    sizes = rows.groupBy("path").agg(F.max("position").alias("relnatts"))
    rows = rows.join(files, ["folder", "path"]).join(sizes, "path")
    return rows.select(F.xxhash64("folder").alias("attrelid"), "snap_no", F.col("field").alias("attname"), F.xxhash64("field_type").alias("atttypid"), F.col("position").alias("attnum"), F.lit(-1).alias("atttypmod"), F.lit(False).alias("attisdropped"), "relnatts", F.lit(0).cast("bigint").alias("t_xmin"), F.col("snap_no").alias("pg_version"), "folder", "path", "field_type")


def snapshot_columns(attr: DataFrame) -> DataFrame:
    """The columns of each catalog snapshot, dropped ones included: of each (attrelid, snap_no, attnum) with
    1 <= attnum <= relnatts the row that isn't dropped, then with the highest t_xmin, then by name and type.

    NULL attisdropped counts as not dropped, a NULL t_xmin as lowest; rows with a NULL attnum or relnatts don't count.
    Repeated rows fall together, other columns of the input are left alone.
    """
    live = ~F.coalesce(F.col("attisdropped"), F.lit(False))
    rank = F.struct(live.cast("int"), F.coalesce("t_xmin", F.lit(-1)), F.col("attname"), F.col("atttypid"), F.col("atttypmod"))
    return (
        attr.where("attnum between 1 and relnatts")
        .groupBy("attrelid", "snap_no", "attnum")
        .agg(F.max_by(F.struct("attname", "atttypid", "atttypmod", live.alias("live")), rank).alias("c"))
        .select("attrelid", "snap_no", "attnum", "c.attname", "c.atttypid", "c.atttypmod", "c.live")
    )


def snapshots(attr: DataFrame) -> DataFrame:
    """Each (attrelid, snap_no) with its release and those of its neighbours in order of snap_no."""
    each = attr.where("attrelid is not null and snap_no is not null").groupBy("attrelid", "snap_no").agg(F.max("pg_version").alias("ver"))
    here = F.struct("snap_no", "ver")
    each = previous(each, ["attrelid"], [F.col("snap_no")], here, "before", split=True)
    each = each.withColumn("back_", -F.col("snap_no"))
    each = previous(each, ["attrelid"], [F.col("back_")], here, "after", split=True).drop("back_")
    return each


def lifespans(attr: DataFrame) -> DataFrame:
    """The column lifespan catalogue: each live column of each snapshot, with whether its island of equal field and type
    starts or ends there.

    An island goes on from a snapshot to the relation's next one if a column of the same name and type is in both, and
    at the same attnum when both snapshots have the same release. One look-back per field and type serves both cases.
    Columns: attrelid, snap_no, attnum, attname, atttypid, atttypmod, prev_no, by_num (columns are matched by number
    towards the previous snapshot), next_no, next_by_num, starts, ends. A column of the first snapshot starts, one of
    the last ends.
    """
    names = snapshots(attr).select(
        "attrelid",
        "snap_no",
        F.col("before.snap_no").alias("prev_no"),
        F.col("before.ver").eqNullSafe(F.col("ver")).alias("by_num"),
        F.col("after.snap_no").alias("next_no"),
        F.col("after.ver").eqNullSafe(F.col("ver")).alias("next_by_num"),
    )
    live = snapshot_columns(attr).where("live").drop("live").join(names, ["attrelid", "snap_no"])
    field = ["attrelid", "attname", "atttypid", "atttypmod"]
    here = F.struct("snap_no", "attnum")
    live = previous(live, field, [F.col("snap_no"), F.col("attnum")], here, "was", split=True)
    live = live.withColumn("back_", -F.col("snap_no")).withColumn("num_back_", -F.col("attnum"))
    live = previous(live, field, [F.col("back_"), F.col("num_back_")], here, "will", split=True).drop("back_", "num_back_")

    def goes_on(other: str, no: str, by_num: str) -> Column:
        same_place = F.when(F.col(by_num), F.col(f"{other}.attnum") == F.col("attnum")).otherwise(F.col("attname").isNotNull())
        return F.coalesce((F.col(f"{other}.snap_no") == F.col(no)) & same_place, F.lit(False))

    return (
        live.withColumn("starts", ~goes_on("was", "prev_no", "by_num"))
        .withColumn("ends", ~goes_on("will", "next_no", "next_by_num"))
        .drop("was", "will")
    )


def column_changes(attr: DataFrame) -> DataFrame:
    """Each difference between a snapshot and the relation's previous one: attrelid, snap_no, attnum, change_kind.

    Starts and ends of islands at one transition are joined on the attnum (same release) or the attname (another one):
    both sides give `renamed` and/or `retyped`, a start alone `added`, an end alone `removed` (with the earlier attnum).
    An empty input gives no rows; a NULL name matches no name.
    """
    spans = lifespans(attr)
    key = lambda by: F.when(F.col(by), F.concat(F.lit("#"), F.col("attnum").cast("string"))).otherwise(
        F.coalesce(F.concat(F.lit("="), F.col("attname")), F.concat(F.lit("?"), F.col("attnum").cast("string")))
    )
    what = F.struct("attnum", "attname", "atttypid", "atttypmod")
    edge = ["attrelid", "snap_no", "k"]
    starts = spans.where("starts and prev_no is not null").select("attrelid", "snap_no", key("by_num").alias("k"), F.lit(1).alias("side"), what.alias("c"))
    ends = spans.where("ends and next_no is not null").select("attrelid", F.col("next_no").alias("snap_no"), key("next_by_num").alias("k"), F.lit(0).alias("side"), what.alias("c"))
    both = starts.unionByName(ends).groupBy(*edge).agg(F.max(F.when(F.col("side") == 1, F.col("c"))).alias("new"), F.max(F.when(F.col("side") == 0, F.col("c"))).alias("old"))
    kinds = F.filter(
        F.array(
            F.when(F.col("old").isNull(), F.lit("added")),
            F.when(F.col("new").isNull(), F.lit("removed")),
            F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old.attname").eqNullSafe(F.col("new.attname")), F.lit("renamed")),
            F.when(
                F.col("old").isNotNull()
                & F.col("new").isNotNull()
                & ~(F.col("old.atttypid").eqNullSafe(F.col("new.atttypid")) & F.col("old.atttypmod").eqNullSafe(F.col("new.atttypmod"))),
                F.lit("retyped"),
            ),
        ),
        lambda k: k.isNotNull(),
    )
    return both.select("attrelid", "snap_no", F.coalesce("new.attnum", "old.attnum").alias("attnum"), F.explode(kinds).alias("change_kind"))


def copy_fields(line: Column) -> Column:
    """The values of one line of COPY text: split at tabs, `\\N` is NULL, backslash escapes are undone."""
    escapes = [("\\b", "\b"), ("\\f", "\f"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\v", "\x0b")]

    def value(x: Column) -> Column:
        text = F.replace(x, F.lit("\\\\"), F.lit("\x00"))
        for written, meant in escapes:
            text = F.replace(text, F.lit(written), F.lit(meant))
        return F.when(x == "\\N", None).otherwise(F.replace(text, F.lit("\x00"), F.lit("\\")))

    return F.transform(F.split(line, "\t", -1), value)


def field_identities(attr: DataFrame) -> DataFrame:
    """Each live column of each snapshot with the column of its relation's latest snapshot that continues it:
    attrelid, snap_no, attnum, last_attnum, last_name, last_typid (NULL where the column was removed later).

    A column continues the one it is matched with in the next snapshot; the chains of matches are followed upwards by
    pointer doubling, so their length costs rounds in its logarithm.
    """
    spans = materialize(lifespans(attr))
    node = lambda no: F.struct(F.col("attrelid"), F.col(no).alias("snap_no"), F.col("attnum"))
    key = lambda by: F.when(F.col(by), F.concat(F.lit("#"), F.col("attnum").cast("string"))).otherwise(F.concat(F.lit("="), F.col("attname")))
    older = spans.where("next_no is not null").select("attrelid", F.col("next_no").alias("at"), key("next_by_num").alias("k"), node("snap_no").alias("id"))
    newer = spans.where("prev_no is not null").select("attrelid", F.col("snap_no").alias("at"), key("by_num").alias("k"), node("snap_no").alias("parent"))
    links = older.join(newer, ["attrelid", "at", "k"]).select("id", "parent")
    ids = spans.select(node("snap_no").alias("id"))
    tree = resolve(ids.join(links, "id", "left"))
    last = spans.where("next_no is null").select(node("snap_no").alias("root"), F.col("attnum").alias("last_attnum"), F.col("attname").alias("last_name"), F.col("atttypid").alias("last_typid"))
    return tree.join(last, "root", "left").select("id.attrelid", "id.snap_no", "id.attnum", "last_attnum", "last_name", "last_typid")


def unified_rows(attr: DataFrame, records: DataFrame, aliases: Mapping[int, str] = TYPE_ALIASES) -> DataFrame:
    """Every file record in the latest columns of its relation: attrelid, rec_id, snap_no, attnum, attname, atttypid,
    target_type, value (text, NULL where the record has none) and cast_ok; one row per record and latest column.

    Values go to the columns that continue theirs, whatever they are called now; columns that were removed later are
    left out, columns that came later are NULL. cast_ok is false where the text isn't a value of the alias table's type
    (the text is kept). Short lines leave the rest NULL; records repeated under another rec_id count once (lowest
    rec_id); records of unknown snapshots give no rows.
    """
    ids = field_identities(attr)
    cols = ids.groupBy("attrelid", "snap_no").agg(
        F.sort_array(F.collect_list(F.struct("attnum", "last_attnum"))).alias("cols")
    )  # a snapshot has at most relnatts columns
    latest = ids.where("last_attnum is not null").select("attrelid", "last_attnum", "last_name", "last_typid").distinct()
    latest = latest.groupBy("attrelid").agg(F.sort_array(F.collect_list(F.struct("last_attnum", "last_name", "last_typid"))).alias("want"))
    once = records.groupBy("attrelid", "snap_no", "file_name", "pg_version", "natts", "line", "written_ts").agg(F.min("rec_id").alias("rec_id"))
    got = skew_join(skew_join(once, cols, ["attrelid", "snap_no"]), latest, ["attrelid"])
    present = F.filter("cols", lambda c: c["attnum"] <= F.coalesce(F.col("natts"), F.lit(2**31 - 1)))
    placed = F.map_from_entries(
        F.filter(
            F.transform(F.arrays_zip(present.alias("c"), F.col("vals").alias("v")), lambda z: F.struct(z["c"]["last_attnum"], z["v"])),
            lambda e: e["last_attnum"].isNotNull(),
        )
    )
    got = got.withColumn("vals", copy_fields(F.col("line"))).withColumn("at", placed)
    out = got.select("attrelid", "rec_id", "snap_no", F.explode("want").alias("w"), "at")
    kind = F.coalesce(F.element_at(F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]), F.col("w.last_typid").cast("int")), F.lit("string"))
    out = out.select("attrelid", "rec_id", "snap_no", F.col("w.last_attnum").alias("attnum"), F.col("w.last_name").alias("attname"), F.col("w.last_typid").alias("atttypid"), kind.alias("target_type"), F.try_element_at("at", F.col("w.last_attnum")).alias("value"))
    fits = F.lit(True)
    for name in sorted(set(aliases.values()) - {"string"}):
        text = F.trim("value")
        if name == "boolean":
            good = F.lower(text).isin("t", "f", "true", "false")
        elif name == "timestamp_ntz":
            good = F.try_to_timestamp(text).isNotNull()
        else:
            good = text.try_cast(T._parse_datatype_string(name)).isNotNull()
        fits = F.when(F.col("target_type") == name, good).otherwise(fits)
    return out.withColumn("cast_ok", F.col("value").isNull() | F.coalesce(fits, F.lit(False)))


def unified_table(attr: DataFrame, records: DataFrame, attrelid: int, aliases: Mapping[int, str] = TYPE_ALIASES) -> DataFrame:
    """The records of one relation as a table of its latest columns, typed by the alias table: rec_id, snap_no and the
    columns in order of attnum; values that aren't of the type are NULL. A column whose name is taken gets `_` and its number.
    """
    rows = materialize(unified_rows(attr.where(F.col("attrelid") == attrelid), records.where(F.col("attrelid") == attrelid), aliases))
    columns = rows.select("attnum", "attname", "target_type").distinct().orderBy("attnum").collect()  # at most 1600
    taken, made = {"rec_id", "snap_no"}, []
    for c in columns:
        name = c.attname or f"column_{c.attnum}"
        name = f"{name}_{c.attnum}" if name.lower() in taken else name
        taken.add(name.lower())
        text = F.max(F.when(F.col("attnum") == c.attnum, F.col("value")))
        value = F.try_to_timestamp(text).cast("timestamp_ntz") if c.target_type == "timestamp_ntz" else text if c.target_type == "string" else F.trim(text).try_cast(T._parse_datatype_string(c.target_type))
        made.append(value.alias(name))
    return rows.groupBy("rec_id", "snap_no").agg(*made) if made else rows.select("rec_id", "snap_no")
