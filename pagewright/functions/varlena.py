"""Framing of variable-length values: short, long, compressed and external."""

from __future__ import annotations

import struct
from typing import NamedTuple

from pagewright.functions.compress import decompress


class External(NamedTuple):
    """Pointer to an out-of-line value."""

    raw_size: int
    ext_size: int
    method: int
    value_id: int
    toast_rel_id: int

    @property
    def compressed(self) -> bool:
        return self.ext_size < self.raw_size - 4


def parse_external(data: bytes) -> External | None:
    """The pointer behind the two framing bytes (01, tag 18): sizes, method in the top two bits, ids."""
    if len(data) < 18 or data[0] != 1 or data[1] != 18:
        return None
    raw_size, info, value_id, rel = struct.unpack_from("<IIII", data, 2)
    return External(raw_size, info & 0x3FFFFFFF, info >> 30, value_id, rel)


def frame_size(data: bytes, at: int = 0) -> int:
    """Bytes of the framed value at a position, framing included; -1 if there is none."""
    if at >= len(data):
        return -1
    first = data[at]
    if first == 1:
        return 18 if at + 1 < len(data) and data[at + 1] == 18 else -1
    if first & 1:
        return first >> 1
    return struct.unpack_from("<I", data, at)[0] >> 2 if at + 4 <= len(data) else -1


def payload(data: bytes, at: int = 0) -> bytes | External | None:
    """What a framed value holds: its bytes, decompressed if need be, a pointer, or None if the framing is broken."""
    size = frame_size(data, at)
    if size < 1 or at + size > len(data):
        return None
    first = data[at]
    if first == 1:
        return parse_external(data[at : at + 18])
    if first & 1:
        return data[at + 1 : at + size]
    if size < 4:
        return None
    if first & 3 == 2:
        if size < 8:
            return None
        info = struct.unpack_from("<I", data, at + 4)[0]
        return decompress(data[at + 8 : at + size], info & 0x3FFFFFFF, info >> 30)
    return data[at + 4 : at + size]


def frame(value: bytes, short: bool = True) -> bytes:
    """A value with its framing, short where it fits."""
    if short and len(value) + 1 < 127:
        return bytes([(len(value) + 1) << 1 | 1]) + value
    return struct.pack("<I", (len(value) + 4) << 2) + value
