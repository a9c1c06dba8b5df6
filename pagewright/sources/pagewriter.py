"""Heap files, commit logs and control files made from rows: fixtures for tests and round trips."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from pagewright.functions.varlena import frame
from pagewright.sources.layout import ColumnLayout, parse_columns

_PACK = {"bool": "<?", "int2": "<h", "int4": "<i", "int8": "<q", "oid": "<I", "float4": "<f", "float8": "<d", "date": "<i", "timestamp": "<q", "timestamptz": "<q", "time": "<q", "money": "<q", "xid": "<I", "tinyint": "<b"}


# Element type, its format and lowest index of vectors and arrays.
_ARRAYS = {"int2vector": (21, "h", 0), "oidvector": (26, "I", 0), "_int2": (21, "h", 1), "_oid": (26, "I", 1), "_int4": (23, "i", 1)}


def array_payload(kind: str, values: Sequence[int]) -> bytes:
    """The payload of a one-dimensional array or vector of numbers without NULLs."""
    element, fmt, low = _ARRAYS[kind]
    if low and not len(values):  # an empty vector still has one dimension
        return struct.pack("<iiI", 0, 0, element)
    return struct.pack("<iiIii", 1, 0, element, len(values), low) + struct.pack(f"<{len(values)}{fmt}", *map(int, values))


def encode_value(column: ColumnLayout, value) -> bytes:
    """Bytes of a value as they lie in a tuple; bytes are taken as the payload of any variable-length type."""
    if column.kind == "name" and isinstance(value, str):
        return value.encode()[:63].ljust(64, b"\0")
    if column.kind == "char" and isinstance(value, str):
        return (value.encode() or b"\0")[:1]
    if column.length > 0:
        return value if isinstance(value, bytes) else struct.pack(_PACK[column.kind], value if column.kind in ("bool", "float4", "float8") else int(value))
    if column.kind in _ARRAYS and not isinstance(value, (bytes, str)):
        return frame(array_payload(column.kind, value))
    return frame(value.encode() if isinstance(value, str) else value)


def pointer(value_id: int, raw_size: int, stored_size: int, method: int, table: int) -> bytearray:
    """A pointer to an out-of-line value, framed: raw_size includes four bytes of header; method 0 PGLZ, 1 LZ4."""
    return bytearray(struct.pack("<BBIIII", 1, 18, raw_size, stored_size | method << 30, value_id, table))


def pglz_compress(data: bytes) -> bytes:
    """PGLZ without its header: greedy matches of 3 to 273 bytes at most 4095 back, found by a table of three-byte keys."""
    out, at, seen = bytearray(), 0, {}
    while at < len(data):
        flags, group = 0, bytearray()
        for bit in range(8):
            if at >= len(data):
                break
            key = data[at : at + 3]
            back, size = at - seen.get(key, -1), 0
            if len(key) == 3 and key in seen and back <= 4095:
                while size < 273 and at + size < len(data) and data[at + size] == data[at + size - back]:
                    size += 1
            step = size if size >= 3 else 1
            if size >= 3:
                flags |= 1 << bit
                low = min(size - 3, 15)
                group += bytes((back >> 4 & 0xF0 | low, back & 0xFF))
                if low == 15:
                    group.append(size - 18)
            else:
                group.append(data[at])
            for i in range(at, at + step):
                seen[data[i : i + 3]] = i
            at += step
        out += bytes((flags,)) + group
    return bytes(out)


def lz4_compress(data: bytes) -> bytes:
    """One LZ4 block."""
    import pyarrow as pa

    return pa.compress(data, codec="lz4_raw", asbytes=True)


def make_tuple(columns: Sequence[ColumnLayout], values: Sequence, xmin: int = 100, xmax: int = 0, infomask: int = 0x900, page: int = 0, item: int = 1, infomask2: int = 0) -> bytes:
    """A heap tuple: header, null bitmap where needed, aligned values. A value of type bytearray is already framed."""
    nulls = any(v is None for v in values)
    hoff = -(-(23 + ((len(values) + 7) // 8 if nulls else 0)) // 8) * 8
    bitmap = bytearray((len(values) + 7) // 8)
    body = bytearray()
    for i, (column, value) in enumerate(zip(columns, values)):
        if value is None:
            continue
        bitmap[i // 8] |= 1 << i % 8
        raw = bytes(value) if isinstance(value, bytearray) else encode_value(column, value)
        if column.length > 0 or not raw[0] & 1:
            body += bytes(-(hoff + len(body)) % column.align)
        body += raw
    head = struct.pack("<IIIHHHHHB", xmin, xmax, 0, page >> 16, page & 0xFFFF, item, infomask2 & ~0x7FF | len(values), infomask & ~1 | nulls, hoff)
    return head + (bytes(bitmap) if nulls else b"").ljust(hoff - 23, b"\0") + bytes(body)


def make_page(tuples: Sequence[bytes], page_size: int = 8192) -> bytes:
    """A page with its line pointers."""
    page = bytearray(page_size)
    upper = page_size
    for i, t in enumerate(tuples):
        upper -= -(-len(t) // 8) * 8
        page[upper : upper + len(t)] = t
        struct.pack_into("<I", page, 24 + 4 * i, upper | 1 << 15 | len(t) << 17)
    struct.pack_into("<HHHH", page, 12, 24 + 4 * len(tuples), upper, page_size, page_size | 4)
    return bytes(page)


def make_pages(columns: Sequence[ColumnLayout], rows: Iterable[tuple[Sequence, dict]], page_size: int = 8192) -> Iterable[bytes]:
    """Pages filled one after the other with rows (values, arguments of make_tuple)."""
    page, used, tuples = 0, 24, []
    for values, extra in rows:
        t = make_tuple(columns, values, page=page, item=len(tuples) + 1, **extra)
        need = -(-len(t) // 8) * 8 + 4
        if used + need > page_size and tuples:
            yield make_page(tuples, page_size)
            page, used, tuples = page + 1, 24, []
            t = make_tuple(columns, values, page=page, item=1, **extra)
        tuples.append(t)
        used += need
    if tuples:
        yield make_page(tuples, page_size)


def write_heap(df: DataFrame, folder: str, columns: str, page_size: int = 8192) -> DataFrame:
    """Write a DataFrame as heap files, one for each partition, below a folder all tasks can reach: file, n_pages.

    Columns `_xmin`, `_xmax` and `_infomask` set tuple headers where df has them; the others are taken in the order of
    `columns`. Dates and timestamps count from 2000-01-01.
    """
    layout = parse_columns(columns)
    folder = folder.removeprefix("file://")

    def run(batches):
        import os

        import pandas as pd
        from pyspark import TaskContext

        def rows():
            for batch in batches:
                heads = [batch[c].tolist() if c in batch else None for c in ("_xmin", "_xmax", "_infomask")]
                lists = []
                for c in layout:
                    col = batch[c.name]
                    if c.kind == "timestamp":
                        lists.append([None if pd.isna(v) else int((v - pd.Timestamp("2000-01-01")) // pd.Timedelta(microseconds=1)) for v in col])
                    else:
                        lists.append([None if v is None or v != v else v for v in col.tolist()])
                for i, values in enumerate(zip(*lists)):
                    yield values, {k: int(h[i]) for k, h in zip(("xmin", "xmax", "infomask"), heads) if h}

        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{TaskContext.get().partitionId() + 1}"
        n = 0
        with open(path, "wb") as f:
            for page in make_pages(layout, rows(), page_size):
                f.write(page)
                n += 1
        yield pd.DataFrame({"file": [path], "n_pages": [n]})

    return df.mapInPandas(run, "file string, n_pages bigint")


def write_relation(df: DataFrame, path: str, columns: str, page_size: int = 8192, parts: int = 4, spread: bool = True) -> None:
    """Write a DataFrame as one relation, a segment file for each of `parts` partitions. Columns of the layout that df lacks
    get zeros, empty text or false; `_xmin`, `_xmax`, `_infomask` set tuple headers. A value of a variable-length column
    `c` is taken as framed where `c__framed` is true. Without `spread` rows stay in the order of df's partitions, at most
    `parts` of which are made: nothing is shuffled."""
    layout = parse_columns(columns)
    path = path.removeprefix("file://")
    empty = {"bool": False, "name": "", "char": "", "float4": 0.0, "float8": 0.0}

    def run(batches):
        import os

        import pandas as pd
        from pyspark import TaskContext

        def rows():
            for batch in batches:
                heads = [batch[c].tolist() if c in batch else None for c in ("_xmin", "_xmax", "_infomask")]
                lists = []
                for c in layout:
                    if c.name not in batch:
                        lists.append([empty.get(c.kind, 0) if c.length > 0 and c.kind != "timestamptz" else None] * len(batch))
                        continue
                    values = [None if v is None or (isinstance(v, float) and v != v) else v for v in batch[c.name].tolist()]
                    if f"{c.name}__framed" in batch:
                        values = [bytearray(v) if f else v for v, f in zip(values, batch[f"{c.name}__framed"])]
                    lists.append(values)
                for i, values in enumerate(zip(*lists)):
                    yield values, {k: int(h[i]) for k, h in zip(("xmin", "xmax", "infomask"), heads) if h}

        number = TaskContext.get().partitionId()
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{number}" if number else path, "wb") as f:
            for page in make_pages(layout, rows(), page_size):
                f.write(page)
        yield pd.DataFrame({"part": [number]})

    (df.repartition(parts) if spread else df.coalesce(parts)).mapInPandas(run, "part int").collect()  # as many rows as parts


def clog_segment(statuses: dict[int, int]) -> bytes:
    """One segment of the commit log from statuses by position in it."""
    out = bytearray(262_144)
    for i, s in statuses.items():
        out[i // 4] |= s << 2 * (i % 4)
    return bytes(out)
