"""Files that look encrypted, and probes of how a relation must be scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of pages that look like ciphertext from which a relation is suspected.
CIPHER_SHARE = 0.5


def page_marks(spark, path: str, page_size: int = 8192, sane_share: float = 0.5):
    """One row per page of a relation's main file: page, n_items, n_sane, zero_share, state (`zero`, `good`, `cipher`, `bad`).

    A page whose line pointers lead to few sane tuples and that holds hardly any zero bytes looks like ciphertext.
    """
    from pagewright.sources.heap import segments

    files, base, rows = segments(path.removeprefix("file://")), 0, []
    import os

    for f in files:
        n = -(-os.path.getsize(f) // page_size)
        rows += [(f, base + at, at, min(1024, n - at)) for at in range(0, n, 1024)]
        base += n

    def look(batches):
        import numpy as np
        import pandas as pd

        from pagewright.sources.pages import page_state, standard_tuples

        for batch in batches:
            for file, first, at, count in batch.itertuples(index=False):
                with open(file, "rb") as f:
                    f.seek(at * page_size)
                    raw = f.read(count * page_size)
                n = len(raw) // page_size
                pages = np.frombuffer(raw, dtype=np.uint8, count=n * page_size).reshape(n, page_size)
                state = page_state(pages)
                lower = pages[:, 12].astype(np.int64) | pages[:, 13].astype(np.int64) << 8
                items = np.where(state == 0, (lower - 24) // 4, 0)
                t = standard_tuples(raw, page_size, first)
                natts, hoff = t.head["natts"], t.head["hoff"]
                sane = (natts > 0) & (hoff <= t.size) & (t.head["xmin"] > 0)
                sanes = np.bincount(t.page[sane] - first, minlength=n)[:n]
                zeros = (pages == 0).mean(axis=1)
                name = np.where(state == 1, "zero", np.where((items > 0) & (sanes >= sane_share * items), "good", np.where(zeros < 0.02, "cipher", np.where((items == 0) & (state == 0), "good", "bad"))))
                yield pd.DataFrame({"page": first + np.arange(n), "n_items": items, "n_sane": sanes, "zero_share": zeros, "state": name})

    ranges = spark.createDataFrame(rows, "file string, first bigint, at bigint, count bigint")
    return ranges.repartition(max(1, min(len(rows), 512))).mapInPandas(look, "page bigint, n_items bigint, n_sane bigint, zero_share double, state string")


def suspected(marks: DataFrame) -> DataFrame:
    """One row: pages, pages like ciphertext, bad and zero pages, whether the relation is suspected, how to scan it."""
    counted = marks.agg(F.count(F.lit(1)).alias("n_pages"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("good", "cipher", "bad", "zero")], F.sum("n_sane").alias("n_sane"))
    is_cipher = F.col("n_cipher") >= CIPHER_SHARE * F.greatest(F.col("n_pages") - F.col("n_zero"), F.lit(1))
    return counted.withColumn("suspected_cipher", is_cipher).withColumn("scan_mode", F.when(F.coalesce("n_sane", F.lit(0)) > 0, "standard").otherwise("carve"))
