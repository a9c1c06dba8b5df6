"""Which encoding a relation's pages are written in, by vote of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that vote for one relation, votes a winner needs, share of the votes it needs.
SAMPLED_PAGES, LEAST_VOTES, LEAST_SHARE = 16, 2, 2 / 3


def page_class(n_high: Column, n_utf8: Column) -> Column:
    """Vote of a page from its texts with high bytes: `utf8` if all are well-formed, `other` if none is, else NULL."""
    return F.when(n_high == 0, None).when(n_utf8 == n_high, "utf8").when(n_utf8 == 0, "other")


def page_votes(tuples: DataFrame, relation: str, page: str, raw: str) -> DataFrame:
    """One row per page with text: relation, page, vote. A text is a tuple's bytes behind its header."""
    body = tuples.where(F.length(raw) > 24).select(relation, page, F.expr(f"substring({raw}, int(conv(hex(substring({raw}, 23, 1)), 16, 10)) + 6)").alias("body_"))
    high = F.hex("body_").rlike("^(?:..)*[89A-F]")
    good = F.is_valid_utf8("body_")
    pages = body.groupBy(relation, page).agg(F.count_if(high).alias("n_high"), F.count_if(high & good).alias("n_utf8"))
    return pages.select(relation, page, page_class(F.col("n_high"), F.col("n_utf8")).alias("vote"))


def winners(votes: DataFrame, relation: str, page: str) -> DataFrame:
    """The encoding of each relation: at most SAMPLED_PAGES pages, spread by stride, vote; a winner needs LEAST_VOTES and
    LEAST_SHARE of the votes, otherwise none is named: relation, n_votes, winner. Sampling is the operator's feature."""
    spans = votes.groupBy(relation).agg((F.max(page) - F.min(page) + 1).alias("span_"), F.min(page).alias("low_"))
    chosen = votes.join(spans, relation).where((F.col(page) - F.col("low_")) % F.greatest(F.ceil(F.col("span_") / SAMPLED_PAGES), F.lit(1)) == 0)
    counts = chosen.groupBy(relation).agg(F.count("vote").alias("n_votes"), F.count_if(F.col("vote") == "utf8").alias("n_utf8"))
    most = F.greatest(F.col("n_utf8"), F.col("n_votes") - F.col("n_utf8"))
    enough = (most >= LEAST_VOTES) & (most * 3 >= F.col("n_votes") * 2)
    return counts.select(relation, "n_votes", F.when(enough & (F.col("n_utf8") == most) & (most * 2 != F.col("n_votes")), "utf8").when(enough & (most * 2 != F.col("n_votes")), "other").alias("winner"))
