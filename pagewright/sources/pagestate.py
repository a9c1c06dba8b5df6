"""`pgpages`: the state of each page of a relation's files, and of what is missing of them: the evidence of an export."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagewright.sources.heap import PAGES_AT_ONCE, PageRange, detect_page_size, segment_gaps, segments
from pagewright.sources.pages import HEADER, ITEM, page_state, standard_tuples

# What page_state() tells.
STATES = ("ok", "zero page", "bad header", "other page size")
#: Pages of a full segment, one GiB of 8 KiB pages.
SEGMENT_PAGES = 131_072


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.problems = options.get("problems", "false") == "true"
        paths: list[str] = []
        for part in options["path"].split(","):
            part = part.strip().removeprefix("file://")
            paths += [p for p in sorted(glob.glob(part)) if not re.search(r"(_(fsm|vm|init)|\.\d+)$", p)] if any(c in part for c in "*?[") else [part]
        self.found: list[tuple[str, int | None, str]] = []  # file, page, state of what no page can tell
        self.files: list[tuple[str, list[str]]] = []
        sizes = [s for p in paths for s in segments(p)[:1] if os.path.getsize(s)]
        self.page_size = int(options["pagesize"]) if options.get("pagesize") else detect_page_size(sizes[0]) if sizes else 8192
        for path in paths:
            parts = segments(path)
            if not parts:
                self.found.append((path, None, "missing file"))
            for part in parts:
                if not os.path.getsize(part):
                    self.found.append((part, None, "empty file"))
            for part in parts[:-1]:
                if os.path.getsize(part) != SEGMENT_PAGES * self.page_size:
                    self.found.append((part, None, "segment not full"))
            self.found += [(part, None, "segment behind a gap") for part in segment_gaps(path)]
            self.files.append((path, parts))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = [PageRange("", 0, 0, 0)]
        for _, parts in self.files:
            base = 0
            for file in parts:
                n = -(-os.path.getsize(file) // self.page_size)
                out += [PageRange(file, base + at, at, min(4096, n - at)) for at in range(0, n, 4096)]
                base += n
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, PageRange)
        if not partition.n_pages:
            yield self._batch([f for f, _, _ in self.found], [p for _, p, _ in self.found], [s for _, _, s in self.found], [0] * len(self.found), [0] * len(self.found))
            return
        size = self.page_size
        for done in range(0, partition.n_pages, PAGES_AT_ONCE):
            n, first = min(PAGES_AT_ONCE, partition.n_pages - done), partition.first_page + done
            try:
                with open(partition.file, "rb") as f:
                    f.seek((partition.first_in_file + done) * size)
                    data = f.read(n * size)
            except OSError:
                yield self._batch([partition.file] * n, range(first, first + n), ["unreadable"] * n, [0] * n, [0] * n)
                continue
            whole = len(data) // size
            pages = np.frombuffer(data, dtype=np.uint8, count=whole * size).reshape(whole, size)
            state = page_state(pages)
            lower = pages[:, 12].astype(np.int64) | pages[:, 13].astype(np.int64) << 8
            items = np.where(state == 0, (lower - HEADER) // ITEM, 0)
            kept = np.bincount(standard_tuples(data, size, 0).page, minlength=whole)[:whole] if whole else np.zeros(0, dtype=np.int64)
            shown = np.flatnonzero(state) if self.problems else np.arange(whole)
            states = [STATES[state[i]] for i in shown]
            numbers = [first + int(i) for i in shown]
            items_, kept_ = [int(items[i]) for i in shown], [int(kept[i]) for i in shown]
            if len(data) % size:
                numbers, states, items_, kept_ = [*numbers, first + whole], [*states, "truncated page"], [*items_, 0], [*kept_, 0]
            yield self._batch([partition.file] * len(numbers), numbers, states, items_, kept_)

    @staticmethod
    def _batch(files, pages, states, items, kept) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(files), pa.string()), pa.array(list(pages), pa.int64()), pa.array(list(states), pa.string()), pa.array(list(items), pa.int32()), pa.array(list(kept), pa.int32())], names=["file", "page", "state", "n_items", "n_tuples"])


class PageStateSource(DataSource):
    """Rows: file, page (number in the relation, NULL for what concerns a whole file), state (ok, zero page, bad header, other
    page size, truncated page, unreadable; missing file, empty file, segment not full, segment behind a gap), n_items (line
    pointers), n_tuples (sane tuples). Options: path (as of pgheap), pageSize, problems (true: only pages that aren't ok)."""

    @classmethod
    def name(cls) -> str:
        return "pgpages"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("page", T.LongType()), T.StructField("state", T.StringType()), T.StructField("n_items", T.IntegerType()), T.StructField("n_tuples", T.IntegerType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader({k.lower(): v for k, v in dict(self.options).items()})


def evidence(pages: DataFrame, most: int = 1000) -> DataFrame:
    """One row for a relation's pages: n_pages, n_tuples, n_bad, bad_pages (the first `most` numbers, as the report shows
    them), states (number of each state), complete (no page and no segment is missing or unreadable)."""
    bad = F.col("state") != "ok"
    totals = pages.agg(F.count("page").alias("n_pages"), F.coalesce(F.sum("n_tuples"), F.lit(0)).alias("n_tuples"), F.count_if(bad).alias("n_bad"), (F.count_if(F.col("state").isin("unreadable", "truncated page", "missing file", "segment behind a gap")) == 0).alias("complete"))
    first = pages.where(bad & F.col("page").isNotNull()).select("page").distinct().orderBy("page").limit(most).agg(F.sort_array(F.collect_list("page")).alias("bad_pages"))
    states = pages.groupBy("state").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "n")))).alias("states"))
    one = lambda df: df.withColumn("one_", F.lit(1))
    return one(totals).join(one(first), "one_").join(one(states), "one_").drop("one_")  # one row each
