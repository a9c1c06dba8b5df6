"""Current tables from change feeds: signed multisets of before- and after-images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.visibility import clog_latest, delete_certain, insert_known, XMAX_OPEN
from pagewright.plans.lineage import materialize
from pagewright.plans.skew import hot_hashes, previous, skew_join


def signed_images(changes: DataFrame, keys: list[str], seq: list[str], image: str, hot: list[int] | None = None) -> DataFrame:
    """The signed images of an ordered change feed: keys, image, sign.

    A change has a place (`keys`, `seq`) and an after-image (`image`, NULL for a delete). Changes that came more than
    once at the same place count once (the greatest image; a delete only if all are deletes). Each change gives plus
    one for its after-image and minus one for its before-image, the after-image of the change before it.
    """
    once = changes.groupBy(*keys, *seq).agg(F.max(image).alias(image))
    held = previous(once, keys, [F.col(c) for c in seq], F.col(image), "before_", split=True, hot=hot)
    signed = F.array(F.struct(F.col(image).alias("image"), F.lit(1).alias("sign")), F.struct(F.col("before_").alias("image"), F.lit(-1).alias("sign")))
    return held.select(*keys, F.inline(signed)).where("image is not null")


def apply_changes(base: DataFrame | None, changes: DataFrame, keys: list[str], seq: list[str], image: str, hot: list[int] | None = None) -> DataFrame:
    """The rows that make up a table after a feed: keys, image, multiplicity.

    `base` (keys, image) counts plus one each and comes before every change of its key, so an update or delete of a base
    row takes it away as its before-image. Multiplicities are summed per image, rows with a positive sum stay. Repeated
    and out-of-order changes make no difference; rows with a NULL in `keys` form a key of their own. `hot` are the
    hashes of hot keys, if the caller knows them.
    """
    if base is not None:
        first = {c: F.lit(None).cast(changes.schema[c].dataType) for c in seq}  # NULL sorts first
        rows = base.select(*keys, *[v.alias(c) for c, v in first.items()], F.col(image))
        changes = rows.unionByName(changes.select(*keys, *seq, image))
    signed = signed_images(changes, keys, seq, image, hot)
    return signed.groupBy(*keys, "image").agg(F.sum("sign").alias("multiplicity")).where("multiplicity > 0").withColumnRenamed("image", image)


def with_status(rows: DataFrame, xid: Column, needed: Column, clog: DataFrame, name: str, hot: list[int] | None = None) -> DataFrame:
    """Add `name`: the commit log's status of `xid` in the rows where it is `needed`; rows that need none aren't matched."""
    asked = rows.withColumn("xid_", F.when(needed, xid))
    log = clog.select(F.col("xid").alias("xid_"), F.col("status").alias(name))
    return skew_join(asked, log, ["xid_"], "left", hot=hot).drop("xid_")


def tuple_images(heap: DataFrame) -> DataFrame:
    """Of each (rel_oid, page_no, item_no) the header of the image with the highest page_lsn; among equal ones the
    greatest header. Rows with a NULL in one of the three are left out; NULL page_lsn is lowest."""
    header = F.struct("row_id", "t_xmin", "t_xmax", F.coalesce("t_infomask", F.lit(0)).alias("mask"))
    return (
        heap.where("rel_oid is not null and page_no is not null and item_no is not null")
        .groupBy("rel_oid", "page_no", "item_no")
        .agg(F.max(F.struct(F.coalesce("page_lsn", F.lit(-1)).alias("lsn"), header.alias("t"))).alias("m"))
        .select("rel_oid", "page_no", "item_no", "m.t.row_id", "m.t.t_xmin", "m.t.t_xmax", "m.t.mask")
    )


def current_tuples(heap: DataFrame, clog: DataFrame) -> DataFrame:
    """The tuples that make up each relation: rel_oid, page_no, item_no, row_id.

    Page images become changes of the row (rel_oid, row_id) in the order of t_xmin: a tuple whose insert holds is one
    with itself as after-image; a tuple that is deleted is another right behind it, without one. The signed images are
    summed and the positive ones stay. So an old version falls to its successor's before-image, the last one to its
    own delete. Two versions with one t_xmin are ordered by page_no, then item_no. Statuses missing from the log leave an
    insert held and a delete open (the tuple stays); NULL t_xmin counts as an unknown status, NULL t_xmax as 0.
    """
    mask = F.col("mask")
    known = insert_known(mask, F.col("t_xmin"))
    certain = delete_certain(mask, F.col("t_xmax"))
    images = materialize(tuple_images(heap).withColumn("t_xmax", F.coalesce("t_xmax", F.lit(0))))
    log = clog_latest(clog)
    hot_in = hot_hashes(images.where(known.isNull()).select(F.col("t_xmin").alias("xid_")), ["xid_"])
    hot_out = hot_hashes(images.where(certain == XMAX_OPEN).select(F.col("t_xmax").alias("xid_")), ["xid_"])
    hot_rows = hot_hashes(images, ["rel_oid", "row_id"], nulls=True)
    rows = with_status(images, F.col("t_xmin"), known.isNull(), log, "in_status", hot_in)
    held = rows.where(F.coalesce(known, ~F.col("in_status").isin(0, 2), F.lit(True))).drop("in_status")
    held = with_status(held, F.col("t_xmax"), certain == XMAX_OPEN, log, "out_status", hot_out)
    gone = F.when(certain == XMAX_OPEN, (F.col("t_xmax") < 3) | F.coalesce(F.col("out_status").isin(1, 3), F.lit(False))).otherwise(certain == 1)
    place = F.struct("page_no", "item_no")
    steps = F.array(
        F.struct(F.lit(0).alias("step"), place.alias("image")),
        F.when(gone, F.struct(F.lit(1).alias("step"), F.lit(None).cast("struct<page_no:bigint,item_no:int>").alias("image"))),
    )
    feed = held.select("rel_oid", "row_id", "t_xmin", "page_no", "item_no", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    feed = feed.select("rel_oid", "row_id", "t_xmin", "page_no", "item_no", "s.step", "s.image")
    rows = apply_changes(None, feed, ["rel_oid", "row_id"], ["t_xmin", "page_no", "item_no", "step"], "image", hot_rows)
    return rows.select("rel_oid", "image.page_no", "image.item_no", "row_id")


def current_rows(heap: DataFrame, clog: DataFrame) -> DataFrame:
    """current_tuples() with the text of each, from its image with the highest page_lsn: ..., t_xmin, val_text."""
    place = ["rel_oid", "page_no", "item_no"]
    live = current_tuples(heap, clog)
    rank = F.struct(F.coalesce("page_lsn", F.lit(-1)), "row_id", "t_xmin", "t_xmax", "val_text")
    text = heap.groupBy(*place).agg(F.max_by(F.struct("t_xmin", "val_text"), rank).alias("v"))
    return live.join(text, place).select(*place, "row_id", "v.t_xmin", "v.val_text")
