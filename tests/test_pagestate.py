"""States of pages, missing files, counts without decoding, user types and compressors."""

import json

import pytest

from pagewright.functions.compress import decompress
from pagewright.functions.decode import decode
from pagewright.sources.heap import register
from pagewright.sources.layout import parse_columns
from pagewright.sources.pagestate import evidence
from pagewright.sources.pagewriter import array_payload, lz4_compress, make_page, make_tuple, pglz_compress

LAYOUT = parse_columns("id int4")


def page(*keys, **extra):
    return make_page([make_tuple(LAYOUT, [k], **extra) for k in keys])


def test_pages_and_what_is_missing(spark, tmp_path):
    register(spark)
    path = tmp_path / "16400"
    path.write_bytes(page(1, 2) + bytes(8192) + page(3) + b"cut")
    (tmp_path / "16400.2").write_bytes(page(9))
    (tmp_path / "16401").write_bytes(b"")
    load = lambda where, **o: spark.read.format("pgpages").options(**o).load(str(where))
    got = {(r.page, r.state, r.n_items, r.n_tuples) for r in load(path).collect()}
    assert got == {(0, "ok", 2, 2), (1, "zero page", 0, 0), (2, "ok", 1, 1), (3, "truncated page", 0, 0), (None, "segment behind a gap", 0, 0)}
    assert {r.state for r in load(path, problems="true").collect()} == {"zero page", "truncated page", "segment behind a gap"}
    one = evidence(load(path)).first()
    assert (one.n_pages, one.n_tuples, one.n_bad, one.bad_pages, one.complete) == (4, 3, 3, [1, 3], False) and one.states["ok"] == 2
    assert evidence(load(path), most=1).first().bad_pages == [1]
    assert [r.state for r in load(tmp_path / "16401").collect()] == ["empty file"] and [r.state for r in load(tmp_path / "none").collect()] == ["missing file"]


def test_counts(spark, tmp_path):
    register(spark)
    path = tmp_path / "16400"
    path.write_bytes(page(1, 2) + page(3, xmax=9, infomask=0x500) + page(4, infomask=0xA00) + page(5, xmax=9, infomask=0x100))
    (tmp_path / "16400.3").write_bytes(page(9))
    for mode, n in (("live", 3), ("all", 4), ("deleted", 2)):
        got = spark.read.format("pgheap").options(count="true", visibility=mode).load(str(path)).agg({"n": "sum"}).first()[0]
        assert got == n == spark.read.format("pgheap").options(raw="false", visibility=mode).load(str(path)).count()


@pytest.mark.parametrize("text", [b"", b"a", b"abc" * 5000, bytes(range(256)) * 20, b"x" * 300 + b"y" * 300, "größer 数据 ".encode() * 400])
def test_compressors(text):
    assert decompress(pglz_compress(text), len(text), 0) == text
    if text:
        assert decompress(lz4_compress(text), len(text), 1) == text


def test_user_types():
    mood = {"enum": {"7": "fine", "8": "so so"}}
    spec = json.dumps(mood)
    assert decode(spec, b"\x07\0\0\0") == "fine" and decode(spec, b"\x09\0\0\0") == "9" and decode(spec, None) is None and decode(spec, b"\x07") == "\\x07"
    array = json.dumps({"array": mood})
    assert decode(array, array_payload("_oid", [7, 8])) == '{fine,"so so"}'
    row = json.dumps({"row": ["int4", mood]})
    body = make_tuple(parse_columns("a int4, b oid"), [5, 8])
    assert decode(row, body[0:]) is not None
