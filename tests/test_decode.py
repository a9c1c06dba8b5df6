"""Decoder vectors by type, and that no bytes ever raise."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions import decode as D
from pagewright.functions.compress import lz4_block, pglz
from pagewright.functions.varlena import External, frame, parse_external, payload

p = struct.pack


def num(negative, scale, weight, *groups):
    """numeric in the short header."""
    return p("<H", 0x8000 | negative << 13 | scale << 7 | weight & 0x7F) + p(f"<{len(groups)}H", *groups)


def arr(elem, dims, data, lows=None, nulls=b"", offset=0):
    lows = lows or [1] * len(dims)
    return p("<iiI", len(dims), offset, elem) + p(f"<{len(dims)}i", *dims) + p(f"<{len(dims)}i", *lows) + nulls + data


VECTORS = [
    ("bool", b"\1", "t"), ("bool", b"\0", "f"), ("int2", p("<h", -5), "-5"), ("int4", p("<i", 7), "7"), ("int8", p("<q", -(2**63)), "-9223372036854775808"), ("oid", p("<I", 2**32 - 1), "4294967295"),
    ("tid", p("<HHH", 1, 2, 3), "(65538,3)"), ("money", p("<q", -123456), "-$1,234.56"), ("money", p("<q", -(2**63)), "-$92,233,720,368,547,758.08"),
    ("float8", p("<d", 1e16), "1e+16"), ("float8", p("<d", 0.1), "0.1"), ("float8", p("<d", 123456.0), "123456"), ("float8", p("<d", 1e-5), "1e-05"), ("float8", p("<d", float("inf")), "Infinity"), ("float8", p("<d", float("nan")), "NaN"), ("float4", p("<f", 3.25), "3.25"), ("float4", p("<f", 1e7), "1e+07"),
    ("numeric", num(0, 2, 0, 12, 3400), "12.34"), ("numeric", num(1, 2, 0, 12, 3400), "-12.34"), ("numeric", num(0, 0, 1, 1), "10000"), ("numeric", num(0, 5, -1, 120), "0.01200"), ("numeric", num(0, 10, -2, 5), "0.0000000500"), ("numeric", num(0, 2, 0), "0.00"), ("numeric", p("<H", 0xC000), "NaN"), ("numeric", p("<H", 0xD000), "Infinity"), ("numeric", p("<Hh2H", 0x0003, 1, 12, 3456), "123456.000"),
    ("date", p("<i", 0), "2000-01-01"), ("date", p("<i", 2**31 - 1), "infinity"), ("date", p("<i", -730486), "0002-12-31 BC"), ("time", p("<q", 86400000000), "24:00:00"), ("time", p("<q", 3723000500), "01:02:03.0005"), ("timetz", p("<qi", 0, -19800), "00:00:00+05:30"), ("timestamp", p("<q", -1), "1999-12-31 23:59:59.999999"), ("timestamp", p("<q", -(2**63)), "-infinity"), ("timestamptz", p("<q", 0), "2000-01-01 00:00:00+00"),
    ("interval", p("<qii", 0, 0, 0), "00:00:00"), ("interval", p("<qii", -1000000, 3, 14), "1 year 2 mons 3 days -00:00:01"), ("interval", p("<qii", 1000000, 0, -1), "-1 mons +00:00:01"), ("interval", p("<qii", 0, 1, -13), "-1 years -1 mons +1 day"),
    ("uuid", bytes(range(16)), "00010203-0405-0607-0809-0a0b0c0d0e0f"), ("bytea", b"\xde\xad", "\\xdead"), ("inet", bytes([2, 32, 10, 0, 0, 1]), "10.0.0.1"), ("inet", bytes([2, 24, 10, 0, 0, 1]), "10.0.0.1/24"), ("cidr", bytes([2, 24, 10, 0, 0, 0]), "10.0.0.0/24"), ("inet", bytes([3, 128]) + bytes(15) + b"\1", "::1"), ("inet", bytes([3, 64]) + bytes.fromhex("20010db8000000000001000000000001"), "2001:db8::1:0:0:1/64"), ("inet", bytes([3, 128]) + bytes(10) + b"\xff\xff\1\2\3\4", "::ffff:1.2.3.4"),
    ("macaddr", bytes(range(6)), "00:01:02:03:04:05"), ("varbit", p("<i", 5) + b"\xa8", "10101"), ("pg_lsn", p("<Q", 0x16B3748D0), "1/6B3748D0"), ("int2vector", p("<iiIii", 1, 0, 21, 2, 0) + p("<hh", 1, 2), "1 2"), ("point", p("<dd", 1, -2.5), "(1,-2.5)"), ("box", p("<4d", 1, 2, 3, 4), "(1,2),(3,4)"), ("circle", p("<3d", 0, 0, 2), "<(0,0),2>"), ("line", p("<3d", 1, 2, 3), "{1,2,3}"), ("lseg", p("<4d", 0, 0, 1, 1), "[(0,0),(1,1)]"), ("path", p("<iii", 2, 0, 0) + p("<4d", 0, 0, 1, 1), "[(0,0),(1,1)]"),
    ("_int4", arr(23, [3], p("<3i", 1, 2, 3)), "{1,2,3}"), ("_int4", arr(23, [2, 2], p("<4i", 1, 2, 3, 4)), "{{1,2},{3,4}}"), ("_int4", arr(23, [2], p("<2i", 1, 2), [0]), "[0:1]={1,2}"), ("_int4", p("<iiI", 0, 0, 23), "{}"), ("_int4", arr(23, [3], p("<2i", 1, 3), None, b"\5" + bytes(7), 32), "{1,NULL,3}"), ("_text", arr(25, [2], frame(b"a b") + frame(b"x")), '{"a b",x}'), ("_text", arr(25, [3], frame(b"NULL") + frame(b"") + frame(b'q"')), '{"NULL","","q\\""}'),
    ("int4range", p("<I", 3904) + p("<2i", 1, 10) + b"\2", "[1,10)"), ("int4range", p("<I", 3904) + b"\1", "empty"), ("int4range", p("<I", 3904) + p("<i", 5) + bytes([2 | 16]), "[5,)"), ("int4multirange", p("<II", 4451, 2) + p("<I", 0x80000000 | 8) + b"\2\2" + bytes(2) + p("<4i", 1, 3, 5, 9), "{[1,3),[5,9)}"),
    ("jsonb", p("<II", 0x40000001 | 0x10000000, 0x30000000), "true"), ("jsonb", p("<I", 0x40000000), "[]"), ("jsonb", p("<III", 0x20000001, 0x80000001, 4) + b"k<&>x", '{"k": "<&>x"}'), ("tsvector", p("<iI", 1, 3 << 1 | 1) + b"cat\0" + p("<HH", 1, 3 << 14 | 2), "'cat':2A"),
    ("char", b"\x80", "\\200"), ("name", b"abc" + bytes(61), "abc"), ("aclitem", p("<III", 0, 10, 2 | 2 << 16), "=r*/10"), ("regclass", p("<I", 0), "-"), ("text", "é".encode(), "é"), ("text", b"\xff", "\\xff"),
]


@pytest.mark.parametrize("kind,raw,want", VECTORS)
def test_vector(kind, raw, want):
    assert D.decode(kind, raw) == want


def test_null():
    assert D.decode("int4", None) is None


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(D.TYPES)), st.binary(max_size=80))
def test_never_raises(kind, raw):
    assert isinstance(D.decode(kind, raw), str)


@given(st.integers(-(2**31) + 1, 2**31 - 2))
def test_civil_dates_count_up(days):
    a, b = D._civil(days), D._civil(days + 1)
    assert a < b and 1 <= a[1] <= 12 and 1 <= a[2] <= 31


def test_framing():
    assert payload(frame(b"x" * 10)) == b"x" * 10 and payload(frame(b"x" * 500)) == b"x" * 500 and payload(b"\1") is None and payload(b"") is None
    pointer = b"\x01\x12" + p("<IIII", 5000, 1200 | 1 << 30, 77, 16400)
    assert parse_external(pointer) == External(5000, 1200, 1, 77, 16400) and payload(pointer).compressed


def test_compression():
    assert pglz(b"\x00abcdefgh" + b"\x01" + bytes([0x05, 0x08]), 16) == b"abcdefgh" + b"abcdefgh"
    assert pglz(b"\x02a" + bytes([0x0F, 0x01, 0x02]), 21) == b"a" * 21
    assert pglz(b"\x01\x00\x05", 3) is None and pglz(b"", 1) is None
    assert lz4_block(b"\x40abcd", 4) == b"abcd" and lz4_block(b"\x44abcd\x04\x00", 12) == b"abcdabcdabcd"
    assert lz4_block(b"\xf0", 5) is None and lz4_block(b"\x44abcd\x09\x00", 12) is None


@given(st.binary(max_size=60), st.integers(0, 200))
def test_decompression_never_raises(raw, size):
    for f in (pglz, lz4_block):
        out = f(raw, size)
        assert out is None or len(out) == size
