"""Pages of heap segments, parsed a range of pages at a time with numpy: no page, tuple or value is looped over in Python
unless its type has no fixed layout. Broken pages, items and values are counted and skipped, never raised."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pagewright.functions.compress import decompress
from pagewright.functions.decode import bytea, decode
from pagewright.sources.layout import ColumnLayout

HEADER, ITEM, TUPLE_HEADER = 24, 4, 23
PAGE_SIZES = (8192, 16384, 32768)
_EPOCH_DAYS, _EPOCH_MICROS = 10_957, 946_684_800_000_000


@dataclass
class Tuples:
    """Headers of the tuples of a range of pages; `start` and `size` point into `flat`."""

    flat: np.ndarray
    page: np.ndarray
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray
    head: dict[str, np.ndarray]
    bad_pages: list[tuple[int, str]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.start)

    def where(self, keep: np.ndarray) -> Tuples:
        if keep.all():
            return self
        return Tuples(self.flat, self.page[keep], self.item[keep], self.start[keep], self.size[keep], {k: v[keep] for k, v in self.head.items()}, self.bad_pages)


def _u16(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return flat[at].astype(np.int64) | flat[at + 1].astype(np.int64) << 8


def _u32(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _u16(flat, at) | _u16(flat, at + 2) << 16


def visible(mask: np.ndarray, xmax: np.ndarray, mode: str) -> np.ndarray:
    """Which tuples a scan mode admits by their hint bits, as the visibility expressions do."""
    aborted = (mask & 0x300) == 0x200
    alive = ((mask & 0x880) != 0) | (((mask & 0x1400) == 0) & (xmax == 0))
    deleted = ((mask & 0x880) == 0) & ((mask & 0x1400) != 0)
    if mode == "live":
        return ~aborted & ~deleted
    return ~aborted & ~alive if mode == "deleted" else ~aborted


def headers(flat: np.ndarray, start: np.ndarray, counting: bool = False) -> dict[str, np.ndarray]:
    if counting:
        # bytes 4 to 7 and 18 to 22, gathered once
        cells = flat[start[:, None] + np.array([4, 5, 6, 7, 18, 19, 20, 21, 22])].astype(np.int64)
        return {"xmax": cells[:, 0] | cells[:, 1] << 8 | cells[:, 2] << 16 | cells[:, 3] << 24, "natts": (cells[:, 4] | cells[:, 5] << 8) & 0x7FF, "infomask": cells[:, 6] | cells[:, 7] << 8, "hoff": cells[:, 8]}
    block = _u16(flat, start + 12) << 16 | _u16(flat, start + 14)
    info2 = _u16(flat, start + 18)
    return {"xmin": _u32(flat, start), "xmax": _u32(flat, start + 4), "ctid_page": block, "ctid_item": _u16(flat, start + 16), "infomask2": info2, "natts": info2 & 0x7FF, "infomask": _u16(flat, start + 20), "hoff": flat[start + 22].astype(np.int64)}


def page_state(pages: np.ndarray) -> np.ndarray:
    """State of each page (rows of bytes): 0 good, 1 all zero, 2 header out of order, 3 other page size."""
    size = pages.shape[1]
    word = lambda at: pages[:, at].astype(np.int64) | pages[:, at + 1].astype(np.int64) << 8
    lower, upper, special, version = word(12), word(14), word(16), word(18)
    state = np.zeros(len(pages), dtype=np.int8)
    state[~((lower >= HEADER) & (lower <= upper) & (upper <= special) & (special <= size))] = 2
    state[(state == 0) & ((version & 0xFF00) != (size & 0xFF00))] = 3
    state[~pages.any(axis=1)] = 1
    return state


def standard_tuples(data: bytes, page_size: int, first_page: int, counting: bool = False) -> Tuples:
    """Tuples found by the line pointers of whole pages; counting reads no more of their headers than visibility needs."""
    n = len(data) // page_size
    flat = np.frombuffer(data, dtype=np.uint8, count=n * page_size)
    pages = flat.reshape(n, page_size)
    state = page_state(pages)
    names = {1: "zero page", 2: "bad header", 3: "other page size"}
    bad = [(first_page + int(i), names[int(state[i])]) for i in np.flatnonzero(state)]
    if len(data) % page_size:
        bad.append((first_page + n, "truncated page"))
    good = np.flatnonzero(state == 0)
    lower = pages[good, 12].astype(np.int64) | pages[good, 13].astype(np.int64) << 8
    counts = (lower - HEADER) // ITEM
    page = np.repeat(good, counts)
    item = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    pointer = _u32(flat, page * page_size + HEADER + ITEM * item) if len(page) else np.zeros(0, dtype=np.int64)
    off, flags, size = pointer & 0x7FFF, pointer >> 15 & 3, pointer >> 17
    fine = (flags == 1) & (size >= TUPLE_HEADER) & (off >= HEADER) & (off + size <= page_size)
    page, item, off, size = page[fine], item[fine], off[fine], size[fine]
    start = page * page_size + off
    head = headers(flat, start, counting)
    sane = (head["hoff"] >= TUPLE_HEADER) & (head["hoff"] % 8 == 0) & (head["hoff"] <= size) & (head["natts"] <= 1664)
    return Tuples(flat, page[sane] + first_page, item[sane] + 1, start[sane], size[sane], {k: v[sane] for k, v in head.items()}, bad)


def carved_tuples(data: bytes, page_size: int, first_page: int, natts: int) -> Tuples:
    """Tuples of pages without usable line pointers: every 8-byte boundary that looks like the header of a tuple with
    1 to natts attributes whose own ctid lies in the file; a tuple ends where the next one begins."""
    n = len(data) // page_size
    flat = np.frombuffer(data, dtype=np.uint8, count=n * page_size)
    at = np.arange(0, max(0, n * page_size - TUPLE_HEADER), 8)
    at = at[(at % page_size >= HEADER) & (at % page_size <= page_size - TUPLE_HEADER - 1)]
    head = headers(flat, at)
    expect = -(-(TUPLE_HEADER + np.where(head["infomask"] & 1, (head["natts"] + 7) // 8, 0)) // 8) * 8
    ok = (head["natts"] >= 1) & (head["natts"] <= natts) & (head["hoff"] == expect) & (head["xmin"] > 0) & (head["ctid_item"] >= 1) & (head["ctid_item"] <= page_size // 28)
    ok &= (head["infomask"] & 0x0F00 != 0) | (head["xmax"] == 0)
    at, head = at[ok], {k: v[ok] for k, v in head.items()}
    page = at // page_size
    end = np.minimum(np.append(at[1:], n * page_size), (page + 1) * page_size)
    return Tuples(flat, page + first_page, np.zeros(len(at), dtype=np.int64), at, end - at, head)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, valid: np.ndarray, text: bool) -> pa.Array:
    """Slices of bytes as one Arrow array, without a loop."""
    size = np.where(valid, size, 0)
    ends = np.cumsum(size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(start - (ends - size), size) + np.arange(total)
    body = flat[index] if total else np.zeros(0, dtype=np.uint8)
    mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    raw = pa.Array.from_buffers(pa.binary(), len(start), [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())], null_count=int((~valid).sum()))
    if not text:
        return raw
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if r is None else _decoded(r) for r in raw.to_pylist()], type=pa.string())


def _decoded(raw: bytes, encoding: str = "utf-8") -> str:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return bytea(raw)


_FIXED = {"int2": "<i2", "int4": "<i4", "int8": "<i8", "oid": "<u4", "xid": "<u4", "float4": "<f4", "float8": "<f8", "tinyint": "i1", "bool": "u1", "date": "<i4", "timestamp": "<i8"}
_ARROW = {"int2": pa.int16(), "int4": pa.int32(), "int8": pa.int64(), "oid": pa.int64(), "xid": pa.int64(), "float4": pa.float32(), "float8": pa.float64(), "tinyint": pa.int8()}
_TEXTS = {"text", "varchar", "bpchar", "json", "xml", "pg_node_tree"}


def _fixed(column: ColumnLayout, flat: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    n = column.length
    safe = np.where(valid, at, 0)
    cells = flat[safe[:, None] + np.arange(n)]
    if column.kind in _FIXED and not column.text:
        values = np.ascontiguousarray(cells).view(_FIXED[column.kind]).reshape(-1)
        if column.kind == "bool":
            return pa.array(values != 0, mask=~valid)
        if column.kind == "date":
            inside = valid & (np.abs(values.astype(np.int64) + 364_878) < 3_652_059 / 2 + 1_461_000)
            return pa.array((values.astype(np.int64) + _EPOCH_DAYS).clip(-2_000_000, 2_932_896).astype(np.int32), mask=~inside).cast(pa.date32())
        if column.kind == "timestamp":
            inside = valid & (np.abs(values) < 9_000_000_000_000_000_000 // 40)
            return pa.array(np.where(inside, values, 0) + _EPOCH_MICROS, mask=~inside).cast(pa.timestamp("us"))
        return pa.array(values.astype(_ARROW[column.kind].to_pandas_dtype()), mask=~valid)
    # each distinct value is decoded once
    whole = np.ascontiguousarray(cells[valid]).view(np.dtype((np.void, n))).reshape(-1)
    distinct, place = np.unique(whole, return_inverse=True)
    index = np.full(len(valid), -1, dtype=np.int32)
    index[valid] = place
    texts = pa.array([decode(column.kind, v.tobytes()) for v in distinct], type=pa.string())
    return pa.DictionaryArray.from_arrays(pa.array(index, mask=~valid), texts).cast(pa.string()) if len(texts) else pa.nulls(len(valid), pa.string())


def decode_columns(t: Tuples, columns: list[ColumnLayout], wanted: set[str], encoding: str = "utf-8") -> tuple[dict[str, pa.Array], np.ndarray, dict[str, pa.Array]]:
    """Values of the wanted columns, a quality mark per tuple, and out-of-line pointers by column: value ids, raw sizes (`_raw`)
    and stored sizes with the method in the top two bits (`_info`).

    All tuples go through the columns side by side: each keeps its own position, moved past alignment and value.
    Attributes beyond a tuple's own number are NULL. Quality bits: 1 a value lies outside its tuple, 2 broken framing or
    compression, 4 an out-of-line value.
    """
    flat, n = t.flat, len(t)
    pos = t.head["hoff"].copy()
    natts, has_null = t.head["natts"], (t.head["infomask"] & 1) == 1
    quality = np.zeros(n, dtype=np.int32)
    broken = np.zeros(n, dtype=bool)
    values: dict[str, pa.Array] = {}
    pointers: dict[str, pa.Array] = {}
    last = max((i for i, c in enumerate(columns) if c.name in wanted), default=-1)
    top = len(flat) - 1
    stored = -1
    for column in columns[: last + 1]:
        if column.virtual:
            values[column.name] = pa.nulls(n, pa.string())
            stored += 1
            continue
        stored += 1
        there = (natts > stored) & ~broken
        bit = flat[np.minimum(t.start + TUPLE_HEADER + stored // 8, top)] >> (stored % 8) & 1
        there &= ~has_null | (bit == 1)
        want = column.name in wanted
        if column.length > 0:
            pos = np.where(there, pos + (-pos % column.align), pos)
            outside = there & (pos + column.length > t.size)
            quality[outside] |= 1
            broken |= outside
            there &= ~outside
            if want:
                values[column.name] = _fixed(column, flat, t.start + pos, there)
            pos = np.where(there, pos + column.length, pos)
            continue
        first = flat[np.minimum(t.start + pos, top)].astype(np.int64)
        short = (first & 1) == 1
        pos = np.where(there & ~short & (first == 0), pos + (-pos % column.align), pos)
        pos = np.where(there & ~short & (first != 0) & (pos % 4 != 0) & (column.align >= 4), pos + (-pos % column.align), pos)
        outside = there & (pos + 1 > t.size)
        first = flat[np.minimum(t.start + pos, top)].astype(np.int64)
        short, external = (first & 1) == 1, first == 1
        long = np.where(short, 0, _u32(flat, np.minimum(t.start + pos, max(0, top - 3))))
        size = np.where(external, 18, np.where(short, first >> 1, long >> 2))
        outside |= there & ((size < np.where(external | short, 1, np.where((first & 3) == 2, 8, 4))) | (pos + size > t.size))
        quality[outside] |= 1
        broken |= outside
        there &= ~outside
        packed = there & ~short & ((first & 3) == 2)
        plain = there & ~external & ~packed
        quality[there & external] |= 4
        if want:
            lead = np.where(short, 1, 4)
            text = column.kind in _TEXTS
            start, length = t.start + pos + lead, size - lead
            if text and not packed.any() and encoding == "utf-8":
                values[column.name] = _gather(flat, start, length, plain, True)
            else:
                raws = _gather(flat, start, length, plain, False).to_pylist()
                for i in np.flatnonzero(packed):
                    a = int(t.start[i] + pos[i])
                    info = int(_u32(flat, np.array([a + 4]))[0])
                    raws[i] = decompress(flat[a + 8 : a + int(size[i])].tobytes(), info & 0x3FFFFFFF, info >> 30)
                    if raws[i] is None:
                        quality[i] |= 2
                if column.kind == "bytea":
                    values[column.name] = pa.array(raws, type=pa.binary())
                elif text:
                    values[column.name] = pa.array([None if r is None else _decoded(r, encoding) for r in raws], type=pa.string())
                else:
                    values[column.name] = pa.array([decode(column.kind, r) for r in raws], type=pa.string())
            if (there & external).any():
                at = np.where(there & external, t.start + pos, 0)
                for offset, suffix in ((10, ""), (2, "_raw"), (6, "_info")):
                    pointers[column.name + suffix] = pa.array(_u32(flat, np.minimum(at + offset, max(0, top - 3))), mask=~(there & external))
        pos = np.where(there, pos + size, pos)
    return values, quality, pointers
