"""`pgheap`: heap segment files as a Spark data source, without a server."""

from __future__ import annotations

import glob
import os
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from pagewright.sources.layout import ColumnLayout, parse_columns
from pagewright.sources.pages import PAGE_SIZES, Tuples, carved_tuples, decode_columns, page_state, standard_tuples, visible

#: Pages read at once; 1024 pages are 8 MiB.
PAGES_AT_ONCE = 1024

_HEAD = [("_file", T.StringType()), ("_page", T.LongType()), ("_item", T.IntegerType()), ("_xmin", T.LongType()), ("_xmax", T.LongType()), ("_infomask", T.IntegerType()), ("_infomask2", T.IntegerType()), ("_natts", T.IntegerType()), ("_hoff", T.IntegerType()), ("_ctid_page", T.LongType()), ("_ctid_item", T.IntegerType()), ("_quality", T.IntegerType())]

#: Parts of the pointer to an out-of-line value: its id, its raw size, its stored size with the method in the top two bits.
_POINTER = ("__toast", "__toast_raw", "__toast_info")


def segments(path: str) -> list[str]:
    """A relation's segment files in order: the file itself, .1, .2, ... as far as they go without a gap."""
    if re.search(r"_(fsm|vm|init)(\.\d+)?$", path):
        raise ValueError(f"{path} is no main file of a relation")
    out = [path] if os.path.exists(path) else []
    n = 1
    while os.path.exists(f"{path}.{n}"):
        out.append(f"{path}.{n}")
        n += 1
    return out


def segment_gaps(path: str) -> list[str]:
    """Segments behind a missing one: they aren't read, and a report should say so."""
    numbers = sorted(int(m.group(1)) for p in glob.glob(glob.escape(path) + ".*") if (m := re.fullmatch(re.escape(path) + r"\.(\d+)", p)))
    return [f"{path}.{n}" for i, n in enumerate(numbers, 1) if n != i]


def detect_page_size(path: str) -> int:
    """The page size under which most of the first pages have a header in order; 8192 if none has."""
    with open(path, "rb") as f:
        raw = f.read(PAGE_SIZES[-1] * 4)
    best, score = PAGE_SIZES[0], 0.0
    for size in PAGE_SIZES:
        n = len(raw) // size
        if n:
            good = float((page_state(np.frombuffer(raw, dtype=np.uint8, count=n * size).reshape(n, size)) == 0).mean())
            if good > score:
                best, score = size, good
    return best


def _columns(options: dict[str, str]) -> list[ColumnLayout]:
    """The columns of the options; with temporal=text dates and timestamps as text, which has infinities and far years."""
    columns = parse_columns(options["columns"]) if options.get("columns") else []
    if options.get("temporal") == "text":
        columns = [replace(c, text=True) if c.kind in ("date", "timestamp") else c for c in columns]
    return columns


@dataclass
class PageRange(InputPartition):
    file: str
    first_page: int
    first_in_file: int
    n_pages: int


class HeapReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.options, self.wanted = options, schema
        self.columns: list[ColumnLayout] = _columns(options)
        self.mode = options.get("scanmode", "auto")
        if self.mode not in ("auto", "standard", "carve"):
            raise ValueError(f"scanMode {self.mode!r}: use auto, standard or carve")
        self.pages_per_partition = int(options.get("pagesperpartition", 4096))
        self.encoding = options.get("encoding", "utf-8")
        self.visibility = options.get("visibility", "")
        if self.visibility not in ("", "live", "all", "deleted"):
            raise ValueError(f"visibility {self.visibility!r}: use live, all or deleted")
        self.count = options.get("count") == "true"
        self.transform = None
        if options.get("pagetransform"):  # module:function from (page bytes, page number) to page bytes, as a decryptor is
            import importlib

            module, _, name = options["pagetransform"].partition(":")
            self.transform = getattr(importlib.import_module(module), name)
        self.low, self.high = 0, 2**62
        files = []
        for part in options["path"].split(","):
            part = part.strip().removeprefix("file://")
            files += [p for p in sorted(glob.glob(part)) if not re.search(r"(_(fsm|vm|init)|\.\d+)$", p)] if any(c in part for c in "*?[") else [part]
        self.files = [(f, segments(f)) for f in files]
        for f in files:
            if behind := segment_gaps(f):
                warnings.warn(f"a segment of {f} is missing: {len(behind)} behind it aren't read; pgpages lists them", stacklevel=2)
        if not any(s for _, s in self.files):
            raise FileNotFoundError(f"no heap file at {options['path']}")
        first = next(s[0] for _, s in self.files if s)
        self.page_size = int(options["pagesize"]) if options.get("pagesize") else detect_page_size(first)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on _page choose the pages that are read; every filter stays with Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("_page",):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, int(f.value))
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, int(f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for _, parts in self.files:
            base = 0
            for file in parts:
                n = -(-os.path.getsize(file) // self.page_size)
                for at in range(0, n, self.pages_per_partition):
                    count = min(self.pages_per_partition, n - at)
                    if base + at <= self.high and base + at + count > self.low:
                        out.append(PageRange(file, base + at, at, count))
                base += n
        return out or [PageRange("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, PageRange)
        if not partition.n_pages:
            return
        names = [f.name for f in self.wanted.fields]
        for done in range(0, partition.n_pages, PAGES_AT_ONCE):
            n = min(PAGES_AT_ONCE, partition.n_pages - done)
            try:
                with open(partition.file, "rb") as f:
                    f.seek((partition.first_in_file + done) * self.page_size)
                    data = f.read(n * self.page_size)
            except OSError:
                continue  # an unreadable range gives no rows here; pgpages tells of its pages
            t = self._tuples(data, partition.first_page + done)
            if self.count:
                kept = visible(t.head["infomask"], t.head["xmax"], self.visibility) if self.visibility else np.ones(len(t), dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array([int(kept.sum())], pa.int64())], names=["n"])
                continue
            if self.visibility:
                t = t.where(visible(t.head["infomask"], t.head["xmax"], self.visibility))
            if len(t):
                yield self._batch(t, partition.file, names)

    def _tuples(self, data: bytes, first: int) -> Tuples:
        if self.transform is not None:
            size = self.page_size
            data = b"".join(self.transform(data[i : i + size], first + i // size) for i in range(0, len(data), size))
        natts = max(1, len(self.columns)) if self.columns else 1600
        if self.mode == "carve":
            return carved_tuples(data, self.page_size, first, natts)
        t = standard_tuples(data, self.page_size, first, self.count)
        if self.mode == "auto" and not len(t) and any(data):
            return carved_tuples(data, self.page_size, first, natts)
        return t

    def _batch(self, t: Tuples, file: str, names: list[str]) -> pa.RecordBatch:
        wanted = {n for n in names if not n.startswith("_")} - {"raw"}
        wanted |= {n.rpartition("__toast")[0] for n in names if n.endswith(_POINTER)}
        values, quality, pointers = decode_columns(t, self.columns, wanted, self.encoding) if wanted & {c.name for c in self.columns} else ({}, np.zeros(len(t), dtype=np.int32), {})
        h = t.head
        known = {
            "_file": lambda: pa.array([file] * len(t)), "_page": lambda: pa.array(t.page), "_item": lambda: pa.array(t.item.astype(np.int32), mask=t.item == 0), "_xmin": lambda: pa.array(h["xmin"]), "_xmax": lambda: pa.array(h["xmax"]),
            "_infomask": lambda: pa.array(h["infomask"].astype(np.int32)), "_infomask2": lambda: pa.array(h["infomask2"].astype(np.int32)), "_natts": lambda: pa.array(h["natts"].astype(np.int32)), "_hoff": lambda: pa.array(h["hoff"].astype(np.int32)),
            "_ctid_page": lambda: pa.array(h["ctid_page"]), "_ctid_item": lambda: pa.array(h["ctid_item"].astype(np.int32)), "_quality": lambda: pa.array(quality),
            "raw": lambda: pa.array([t.flat[a : a + s].tobytes() for a, s in zip(t.start, t.size)], type=pa.binary()),
        }
        arrays = []
        for field in self.wanted.fields:
            if field.name in known:
                arrays.append(known[field.name]())
            elif field.name.endswith(_POINTER):
                arrays.append(pointers.get("".join(field.name.rsplit("__toast", 1)), pa.nulls(len(t), pa.int64())))
            else:
                arrays.append(values[field.name])
        return pa.RecordBatch.from_arrays(arrays, names=names)


class HeapDataSource(DataSource):
    """Options: path (a relation's main file, a list or a glob), columns (`id int4, v text` or JSON), select (names of the
    columns to decode), pageSize, scanMode (auto, standard, carve), pagesPerPartition, encoding, toast (adds
    `<column>__toast`, the value ids of out-of-line values; full: sizes and method as well), header (false leaves the `_` columns out), visibility (live, all
    or deleted by hint bits, before anything is decoded; without it every tuple comes), temporal (text: dates and timestamps as text, with infinities), pageTransform (`module:function`
    applied to each page's bytes and number).

    Without columns the tuples come as they are, in `raw`; raw=false leaves that out too. count=true gives
    only `n`, the number of tuples that visibility admits of each 1024 pages: their sum is a count.
    """

    @classmethod
    def name(cls) -> str:
        return "pgheap"

    def schema(self) -> T.StructType:
        if self.options.get("count") == "true":
            return T.StructType([T.StructField("n", T.LongType())])
        fields = [T.StructField(n, t) for n, t in _HEAD] if self.options.get("header", "true") == "true" else []
        columns = [c for c in _columns(dict(self.options)) if not c.dropped]
        if not columns:
            return T.StructType([*fields, *([T.StructField("raw", T.BinaryType())] if self.options.get("raw", "true") == "true" else [])])
        if self.options.get("select"):
            asked = {n.strip() for n in self.options["select"].split(",")}
            columns = [c for c in columns if c.name in asked]  # table order; unknown names are left out
            if not columns:
                raise ValueError("none of the selected columns exists")
        fields += [T.StructField(c.name, c.spark_type, True, {"pg_type": c.kind}) for c in columns]
        if self.options.get("toast") in ("true", "full"):
            asked = _POINTER if self.options.get("toast") == "full" else _POINTER[:1]
            fields += [T.StructField(f"{c.name}{suffix}", T.LongType()) for c in columns if c.length == -1 for suffix in asked]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HeapReader({k.lower(): v for k, v in dict(self.options).items()}, schema)


def register(spark) -> None:
    """Make `pgheap` and `pgclog` known to a session."""
    from pagewright.sources.clog import ClogDataSource
    from pagewright.sources.pagestate import PageStateSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # bounds on _page choose the pages read
    spark.dataSource.register(HeapDataSource)
    spark.dataSource.register(ClogDataSource)
    spark.dataSource.register(PageStateSource)
