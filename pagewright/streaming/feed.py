"""A heap feed followed by Structured Streaming: each micro-batch is folded into a compact table of latest images."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagewright.operators.changefeed import current_tuples

_IMAGE = ["row_id", "t_xmin", "t_xmax", "t_infomask", "page_lsn"]
_PLACE = ["rel_oid", "page_no", "item_no"]


def _version(folder: str) -> int:
    names = [int(n) for n in os.listdir(folder) if n.isdigit() and os.path.exists(f"{folder}/{n}/_SUCCESS")] if os.path.isdir(folder) else []
    return max(names, default=-1)


def latest_images(rows: DataFrame) -> DataFrame:
    """Of each place the image with the highest page_lsn; the result folds with later images to the same end, in any order
    and any number of times."""
    best = F.struct(F.coalesce("page_lsn", F.lit(-1)).alias("l"), *[F.col(c) for c in _IMAGE])
    return rows.where(" and ".join(f"{c} is not null" for c in _PLACE)).groupBy(*_PLACE).agg(F.max(best).alias("b")).select(*_PLACE, *[F.col(f"b.{c}") for c in _IMAGE])


def follow(images: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that keeps `folder` up to date with a stream of tuple images; start it with a checkpoint location.

    Version n of the table holds batches 0 to n. A batch that runs again writes the same version again; the version
    before the last one is kept for readers, older ones are removed.
    """

    def fold(batch: DataFrame, number: int) -> None:
        import shutil

        spark = batch.sparkSession
        base = number - 1
        while base >= 0 and not os.path.exists(f"{folder}/{base}/_SUCCESS"):
            base -= 1
        rows = batch.select(*_PLACE, *_IMAGE)
        if base >= 0:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/{base}"))
        latest_images(rows).write.mode("overwrite").parquet(f"{folder}/{number}")
        for old in range(max(0, number - 8), number - 1):
            shutil.rmtree(f"{folder}/{old}", ignore_errors=True)

    return images.writeStream.foreachBatch(fold)


def current(spark: SparkSession, folder: str, clog: DataFrame) -> DataFrame:
    """The tuples that make up each relation by what has arrived so far."""
    version = _version(folder)
    if version < 0:
        raise FileNotFoundError(f"no version of the images in {folder}")
    return current_tuples(spark.read.parquet(f"{folder}/{version}"), clog)
