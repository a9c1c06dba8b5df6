"""Decompression of inline and out-of-line values: PGLZ and LZ4 blocks."""

from __future__ import annotations


def pglz(data: bytes, raw_size: int) -> bytes | None:
    """A PGLZ stream (without its header); None unless exactly raw_size bytes come out."""
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < raw_size:
        control = data[at]
        at += 1
        for bit in range(8):
            if at >= end or len(out) >= raw_size:
                break
            if not control >> bit & 1:
                out.append(data[at])
                at += 1
                continue
            if at + 1 >= end:
                return None
            length, distance = (data[at] & 15) + 3, (data[at] & 240) << 4 | data[at + 1]
            at += 2
            if length == 18:
                if at >= end:
                    return None
                length += data[at]
                at += 1
            if not 0 < distance <= len(out):
                return None
            length = min(length, raw_size - len(out))
            start = len(out) - distance
            if distance >= length:
                out += out[start : start + length]
            else:  # the match overlaps what it makes
                seed = bytes(out[start:])
                out += (seed * (length // distance + 1))[:length]
    return bytes(out) if len(out) == raw_size else None


def lz4_block(data: bytes, raw_size: int) -> bytes | None:
    """An LZ4 block; None unless exactly raw_size bytes come out."""
    out, at, end = bytearray(), 0, len(data)

    def extended(n: int, at: int) -> tuple[int, int]:
        while at < end:
            n, at = n + data[at], at + 1
            if data[at - 1] != 255:
                return n, at
        return -1, at

    while at < end:
        token = data[at]
        at += 1
        literals = token >> 4
        if literals == 15:
            literals, at = extended(15, at)
        if literals < 0 or at + literals > end:
            return None
        out += data[at : at + literals]
        at += literals
        if at >= end:
            break
        if at + 2 > end:
            return None
        distance = data[at] | data[at + 1] << 8
        at += 2
        length = token & 15
        if length == 15:
            length, at = extended(15, at)
        if length < 0 or not 0 < distance <= len(out):
            return None
        length += 4
        start = len(out) - distance
        seed = bytes(out[start:])
        out += (seed * (length // distance + 1))[:length] if distance < length else seed[:length]
        if len(out) > raw_size:
            return None
    return bytes(out) if len(out) == raw_size else None


def decompress(data: bytes, raw_size: int, method: int) -> bytes | None:
    """method 0: PGLZ, 1: LZ4."""
    return pglz(data, raw_size) if method == 0 else lz4_block(data, raw_size) if method == 1 else None
