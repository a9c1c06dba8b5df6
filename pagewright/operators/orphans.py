"""References to records that do not exist: direct and inherited orphans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.plans.lineage import materialize, release
from pagewright.plans.skew import hot_hashes, skew_join


def targets(tables: DataFrame, key: str, rank: list[str], gone: str, seen: str) -> DataFrame:
    """What is known of each key from its versions: target, gone_ts of the current version, first_ts."""
    return tables.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("target")).agg(F.max_by(gone, F.struct(*rank)).alias("gone_ts"), F.min(seen).alias("first_ts"))


def direct_orphans(references: DataFrame, known: DataFrame) -> DataFrame:
    """References (child_table, child_id, target, seen_ts; others kept) to keys that aren't there: plus reason.

    `missing`: no record has the key; `deleted`: its current version was dropped at or before seen_ts; `late`: it was
    first seen after seen_ts. A reference may have two reasons. NULL and 0 refer to nothing; a NULL seen_ts can only be
    `missing`.
    """
    asked = references.where("target is not null and target <> 0")
    joined = skew_join(asked, known.withColumn("known_", F.lit(True)), ["target"], "left")
    reasons = F.filter(
        F.array(
            F.when(F.col("known_").isNull(), F.lit("missing")),
            F.when(F.col("gone_ts") <= F.col("seen_ts"), F.lit("deleted")),
            F.when(F.col("first_ts") > F.col("seen_ts"), F.lit("late")),
        ),
        lambda r: r.isNotNull(),
    )
    return joined.select(*references.columns, F.explode(reasons).alias("reason"))


def cascade(direct: DataFrame, links: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Direct orphans and those that inherit from them: table, id, level, reason.

    `direct` has (table, id, reason), level 0. `links` (table, id, parent_table, parent_id) are foreign keys among
    records; a record with an orphaned parent is orphaned too, at one level more, with reason `inherited`. Each round
    semi-joins the links with the newest level and leaves out what is known already, so circles end; rounds are as many
    as the longest chain of inheritance. Each level is written once. More than most_rounds levels raise an error.
    """
    level0 = materialize(direct.select("table", "id", F.lit(0).alias("level"), "reason").distinct())
    layers = [level0]
    frontier = level0.select("table", "id").distinct()
    links = links.where("parent_id is not null").select("table", "id", "parent_table", "parent_id").distinct()
    links = materialize(links.join(frontier, ["table", "id"], "left_anti"))  # what is orphaned itself inherits nothing
    hot = hot_hashes(links, ["parent_table", "parent_id"])
    level = 0
    while True:
        parents = frontier.select(F.col("table").alias("parent_table"), F.col("id").alias("parent_id"))
        found = skew_join(links, parents, ["parent_table", "parent_id"], "left_semi", hot).select("table", "id").distinct()
        if layers[1:]:
            known = reduce(DataFrame.unionByName, [x.select("table", "id") for x in layers[1:]])
            found = found.join(known, ["table", "id"], "left_anti")
        found = materialize(found.select("table", "id", F.lit(level + 1).alias("level"), F.lit("inherited").alias("reason")))
        if found.isEmpty():
            break
        level += 1
        if level > most_rounds:
            raise RuntimeError(f"orphans are inherited over more than {most_rounds} levels")
        layers.append(found)
        frontier = found.select("table", "id")
    release(links)
    return reduce(DataFrame.unionByName, layers)


def per_period(orphans: DataFrame, period: str = "month", extra: Sequence[str] = ()) -> DataFrame:
    """Orphan references (child_table, reason, seen_ts) counted per table, reason, further columns and period of seen_ts;
    where seen_ts is NULL the period is."""
    at = F.date_trunc(period, "seen_ts").cast("timestamp_ntz").alias("period")
    return orphans.groupBy(F.col("child_table").alias("ref_table"), at, "reason", *extra).agg(F.count(F.lit(1)).alias("n"))
