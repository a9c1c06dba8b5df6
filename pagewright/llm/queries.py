"""Queries on text corpora: name -> callable(spark, folder), and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import mojibake, packing, tokens, truncation
from pagewright.plans.skew import small


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled(_table(spark, folder, "heap_tuple"), "feed_seq", "val_text").select("feed_seq")


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled(_table(spark, folder, "heap_tuple"), "feed_seq", "val_text")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(_table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(_table(spark, folder, "documents"), _table(spark, folder, "container_spec"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    rows = p7_containers(spark, folder).groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    specs = _table(spark, folder, "container_spec").select("spec_id", "capacity")
    return rows.join(small(specs), "spec_id").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(_table(spark, folder, "documents")).select("doc_id").distinct()


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return truncation.cut_rates(documents, truncation.cut_texts(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (p4_found, p4_restored, p6_ids, p7_containers, p7_fill, p8_found, p8_rates)
}
SQL: dict[str, str] = {}
