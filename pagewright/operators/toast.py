"""Out-of-line values and large objects: pieces in, whole values out, with every gap told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.plans.skew import skew_join


def join_bytes(parts: Column) -> Column:
    """An array of binaries as one, in time that grows with its length (by its hexadecimal text)."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def reassemble(chunks: DataFrame, key: str, seq: str, data: str, size: str | None = None) -> DataFrame:
    """Values from their pieces: key, value, n_chunks, state.

    state: `ok`, `gap` (a number from 0 on is missing), `conflict` (two different pieces with one number) or, with `size`,
    `short` (no gap, but the pieces' length differs from the one expected, as when the last piece is missing); the value
    is NULL unless ok. `size` is a column of the chunks with the length of the whole value, in characters or bytes as
    `data` is; where it is NULL the length isn't checked. Exactly repeated pieces count once, rows with a NULL key or number are left out. Only the pieces
    of one value meet in one row.
    """
    pieces = chunks.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    once = pieces.groupBy(key, seq).agg(F.max(data).alias("d_"), F.min(data).alias("d2_"), F.max(F.col(size) if size else F.lit(None)).cast("bigint").alias("size_"))
    whole = once.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("d_").alias("d")))).alias("c_"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.max(seq).alias("top_"),
        F.min(seq).alias("low_"),
        F.sum(F.length("d_").cast("bigint")).alias("length_"),
        F.max("size_").alias("size_"),
        F.max(~F.col("d_").eqNullSafe(F.col("d2_"))).alias("twice_"),
    )
    state = F.when(F.col("twice_"), "conflict").when((F.col("top_") + 1 != F.col("n_chunks")) | (F.col("low_") != 0), "gap").when(F.col("length_") != F.col("size_"), "short").otherwise("ok")
    parts = F.transform("c_", lambda c: c["d"])
    kind = chunks.schema[data].dataType.simpleString()
    joined: Column = F.array_join(parts, "") if kind == "string" else join_bytes(parts)
    return whole.select(key, "n_chunks", state.alias("state"), F.when(state == "ok", joined).alias("value"))


def resolve_pointers(rows: DataFrame, pointer: str, values: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """Rows with their out-of-line values (left join): plus value and toast_state (`missing` where no piece exists, `short`
    where the value's length isn't `size`). Rows without a pointer are spread, pointers that many rows share are salted."""
    values = values.select(F.col(key).alias("to_"), "value", F.col("state").alias("toast_state"))
    none = -1 - F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 31))  # matches nothing
    joined = skew_join(rows.withColumn("to_", F.coalesce(F.col(pointer).cast("bigint"), none)), values, ["to_"], "left").drop("to_")
    if size is not None:
        short = (F.col("toast_state") == "ok") & (F.length("value") != size)
        joined = joined.withColumn("toast_state", F.when(short, "short").otherwise(F.col("toast_state"))).withColumn("value", F.when(F.col("toast_state") == "ok", F.col("value")))
    return joined.withColumn("toast_state", F.when(F.col(pointer).isNotNull(), F.coalesce("toast_state", F.lit("missing"))))


def large_objects(pages: DataFrame, page_size: int, key: str = "loid", pageno: str = "pageno", data: str = "data") -> DataFrame:
    """Large objects from their pages: key, n_pages, n_holes, size, value, state.

    Missing pages before the last and short ones that aren't the last are filled with zero bytes to page_size. Two
    different pages with one number make a `conflict` (value NULL), exact repeats count once.
    """
    pieces = pages.where(F.col(key).isNotNull() & (F.col(pageno) >= 0))
    once = pieces.groupBy(key, pageno).agg(F.max(data).alias("d_"), F.min(data).alias("d2_"))
    whole = once.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(pageno).cast("int").alias("k"), F.col("d_").alias("v")))).alias("m_"),
        F.max(pageno).cast("int").alias("top_"),
        F.count(F.lit(1)).alias("n_pages"),
        F.max(~F.col("d_").eqNullSafe(F.col("d2_"))).alias("twice_"),
    )
    filled = lambda p: F.when(p == F.col("top_"), F.coalesce(F.try_element_at("m_", p), F.lit(b""))).otherwise(F.rpad(F.coalesce(F.try_element_at("m_", p), F.lit(b"")), page_size, F.lit(b"\x00")))
    value = join_bytes(F.transform(F.sequence(F.lit(0), F.col("top_")), filled))
    out = whole.select(key, "n_pages", (F.col("top_") + 1 - F.col("n_pages")).alias("n_holes"), F.when(~F.col("twice_"), value).alias("value"), F.when(F.col("twice_"), "conflict").otherwise("ok").alias("state"))
    return out.withColumn("size", F.length("value"))


def with_owners(data: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Full outer join of objects with data and objects with metadata: plus presence (`both`, `data only`, `empty`)."""
    joined = data.withColumn("d_", F.lit(True)).join(meta.withColumn("m_", F.lit(True)), key, "full_outer")
    presence = F.when(F.col("m_").isNull(), "data only").when(F.col("d_").isNull(), "empty").otherwise("both")
    return joined.withColumn("presence", presence).drop("d_", "m_")


def large_object_sql(objects: DataFrame, key: str, value: str, chunk: int = 16 * 1024 * 1024) -> DataFrame:
    """Statements that restore large objects, in order of (key, step): creation, then one lo_put per chunk of bytes."""
    n = F.greatest(F.ceil(F.length(value) / chunk), F.lit(0)).cast("int")
    steps = F.sequence(F.lit(-1), n - 1)
    rows = objects.select(F.col(key), F.col(value).alias("v_"), F.explode(F.when(n > 0, steps).otherwise(F.array(F.lit(-1)))).alias("step"))
    part = F.lower(F.hex(F.expr(f"substring(v_, step * {chunk} + 1, {chunk})")))
    oid = F.col(key).cast("string")
    make = F.concat(F.lit("SELECT lo_create("), oid, F.lit(");"))
    put = F.concat(F.lit("SELECT lo_put("), oid, F.lit(", "), (F.col("step") * chunk).cast("string"), F.lit(", '\\x"), part, F.lit("');"))
    return rows.select(key, F.col("step").alias("step"), F.when(F.col("step") < 0, make).otherwise(put).alias("statement"))


def page_statements(pages: DataFrame, key: str = "loid", pageno: str = "pageno", data: str = "data", page_size: int = 2048, group: int = 4096, label: str | None = None) -> DataFrame:
    """Statements that restore large objects straight from their pages, no object ever being one row: key, step, statement.

    Step -1 creates the object; step k writes pages k * group on. Pages that lie side by side within a step share an
    lo_put, holes are left to the server, which reads them as zero bytes. Exact repeats count once; of different pages
    with one number the greatest is written. `label` is a column of the pages, one value a key, by which statements name
    the object instead of its key; it comes out as well.
    """
    keys = [key] if label is None else [key, label]
    once = pages.where(F.col(key).isNotNull() & (F.col(pageno) >= 0)).groupBy(*keys, pageno).agg(F.max(data).alias("d_"))
    placed = once.withColumn("step", F.floor(F.col(pageno) / group).cast("int"))
    # an island of pages side by side has one difference between page number and rank; a short page ends it
    w = Window.partitionBy(*keys, "step").orderBy(pageno)
    short = F.lag(F.length("d_") < page_size).over(w)
    starts = F.coalesce(F.col(pageno) - F.lag(pageno).over(w) != 1, F.lit(True)) | F.coalesce(short, F.lit(False))
    placed = placed.withColumn("run_", F.sum(starts.cast("int")).over(w))
    runs = placed.groupBy(*keys, "step", "run_").agg(F.min(pageno).alias("first_"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pageno).alias("p"), F.lower(F.hex("d_")).alias("h")))), lambda c: c["h"]), "").alias("hex_"))
    oid = F.col(label or key).cast("string")
    put = F.concat(F.lit("SELECT lo_put("), oid, F.lit(", "), (F.col("first_").cast("bigint") * page_size).cast("string"), F.lit(", '\\x"), F.col("hex_"), F.lit("');"))
    puts = runs.select(*keys, "step", put.alias("statement"), "first_")
    made = once.select(*keys).distinct().select(*keys, F.lit(-1).alias("step"), F.concat(F.lit("SELECT lo_create("), oid, F.lit(");")).alias("statement"), F.lit(-1).cast(puts.schema["first_"].dataType).alias("first_"))
    return made.unionByName(puts).select(*keys, "step", F.col("first_").alias("page"), "statement")
