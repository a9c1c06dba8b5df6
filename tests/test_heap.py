"""Heap files written page by page and read back, whole and damaged."""

import random
import struct

import pytest

from pagewright.sources import pages as P
from pagewright.sources.clog import XIDS_PER_SEGMENT
from pagewright.sources.control import Control, cluster_root, config_timezone, parse_control, relation_path
from pagewright.sources.heap import detect_page_size, register, segment_gaps, segments
from pagewright.sources.layout import dump_columns, parse_columns
from pagewright.sources.pagewriter import clog_segment, make_page, make_pages, make_tuple

LAYOUT = "id int4, v text, f float8, n numeric, b bool, s int2"


def sample(n, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", "x" * rng.randint(0, 400), "é中"]), rng.random(), None, i % 2 == 0, rng.choice([None, i % 1000])) for i in range(n)]


def write(path, rows, **extra):
    path.write_bytes(b"".join(make_pages(parse_columns(LAYOUT), ((r, extra) for r in rows))))
    return str(path)


@pytest.fixture(scope="module")
def reader(spark):
    register(spark)
    return lambda path, **o: spark.read.format("pgheap").options(columns=LAYOUT, **o).load(path)


def test_round_trip(reader, tmp_path):
    rows = sample(3000)
    df = reader(write(tmp_path / "16400", rows), pagesPerPartition="3")
    got = sorted((r.id, r.v, r.f, r.n, r.b, r.s) for r in df.collect())
    assert got == rows and df.rdd.getNumPartitions() > 5
    assert df.where("_page >= 2 and _page <= 3").select("_page").distinct().count() == 2


def test_same_rows_however_split(reader, tmp_path):
    path = write(tmp_path / "1", sample(500))
    sums = {tuple(reader(path, pagesPerPartition=str(n)).selectExpr("sum(id)", "count(v)", "sum(hash(v))").first()) for n in (1, 2, 7, 4096)}
    assert len(sums) == 1


def test_segments_and_selection(reader, tmp_path):
    a, b = sample(100), [(r[0] + 100, *r[1:]) for r in sample(100)]
    write(tmp_path / "5", a)
    (tmp_path / "5.1").write_bytes(b"".join(make_pages(parse_columns(LAYOUT), ((r, {}) for r in b))))
    (tmp_path / "5.3").write_bytes(b"x")
    assert len(segments(str(tmp_path / "5"))) == 2 and segment_gaps(str(tmp_path / "5")) == [str(tmp_path / "5.3")]
    df = reader(str(tmp_path / "5"), select="f,id,nothing", header="false")
    assert df.columns == ["id", "f"] and df.count() == 200
    with pytest.raises(ValueError):
        segments(str(tmp_path / "5_fsm"))


def test_damage_is_counted_not_raised(reader, tmp_path):
    good = list(make_pages(parse_columns(LAYOUT), ((r, {}) for r in sample(200))))
    bad = bytearray(good[0])
    struct.pack_into("<H", bad, 12, 9000)
    raw = good[0] + bytes(8192) + bytes(bad) + good[1] + good[0][:100]
    t = P.standard_tuples(raw, 8192, 10)
    assert [s for _, s in t.bad_pages] == ["zero page", "bad header", "truncated page"] and [n for n, _ in t.bad_pages] == [11, 12, 14]
    (tmp_path / "9").write_bytes(raw)
    assert reader(str(tmp_path / "9"), pageSize="8192", scanMode="standard").count() == len(P.standard_tuples(good[0] + good[1], 8192, 0))


@pytest.mark.parametrize("seed", range(6))
def test_random_bytes_never_raise(seed):
    rng = random.Random(seed)
    page = bytearray(next(iter(make_pages(parse_columns(LAYOUT), ((r, {}) for r in sample(60, seed))))))
    for _ in range(300):
        page[rng.randrange(24 if seed % 2 else 0, 8192)] = rng.randrange(256)
    for t in (P.standard_tuples(bytes(page), 8192, 0), P.carved_tuples(bytes(page), 8192, 0, 6), P.standard_tuples(rng.randbytes(16384), 8192, 0)):
        values, quality, _ = P.decode_columns(t, parse_columns(LAYOUT), {"id", "v", "f", "n", "b", "s"})
        assert all(len(a) == len(t) for a in values.values()) and len(quality) == len(t)


def test_carving_finds_the_same_rows(reader, tmp_path):
    rows = sample(300)
    data = bytearray(b"".join(make_pages(parse_columns(LAYOUT), ((r, {}) for r in rows))))
    for at in range(0, len(data), 8192):
        struct.pack_into("<H", data, at + 12, 24)  # no line pointers left
    (tmp_path / "7").write_bytes(data)
    got = sorted((r.id, r.v, r.s) for r in reader(str(tmp_path / "7")).collect())
    assert got == [(r[0], r[1], r[5]) for r in rows]


def test_fewer_attributes_than_columns(reader, tmp_path):
    short = parse_columns("id int4, v text")
    (tmp_path / "3").write_bytes(make_page([make_tuple(short, (1, "a")), make_tuple(short, (2, None))]))
    assert [(r.id, r.v, r.f, r.b) for r in reader(str(tmp_path / "3")).orderBy("id").collect()] == [(1, "a", None, None), (2, None, None, None)]


def test_external_and_compressed_values(reader, tmp_path):
    layout = parse_columns("id int4, v text")
    pointer = bytearray(b"\x01\x12" + struct.pack("<IIII", 5000, 4996, 77, 16400))
    packed = bytearray(struct.pack("<II", (8 + 12) << 2 | 2, 16) + b"\x00abcdefgh\x01\x05\x08")
    (tmp_path / "4").write_bytes(make_page([make_tuple(layout, (1, pointer)), make_tuple(layout, (2, packed))]))
    rows = {r.id: r for r in reader(str(tmp_path / "4"), toast="true").collect()}
    assert rows[1].v is None and rows[1].v__toast == 77 and rows[1]._quality & 4 and rows[2].v == "abcdefghabcdefgh"


def test_visibility_in_the_reader(reader, tmp_path):
    """The reader's own filter admits what the column expressions admit, for all flags."""
    import itertools

    from pagewright.operators.visibility import admitted, visibility
    from pyspark.sql import functions as F

    masks = [sum(c) for n in range(7) for c in itertools.combinations((0x100, 0x200, 0x400, 0x800, 0x80, 0x1000), n)]
    layout = parse_columns(LAYOUT)
    rows = [((i, None, 0.5, None, True, 1), {"infomask": m, "xmax": x}) for i, (m, x) in enumerate((m, x) for m in masks for x in (0, 900))]
    (tmp_path / "6").write_bytes(b"".join(make_pages(layout, rows)))
    everything = reader(str(tmp_path / "6")).withColumn("s", visibility(F.col("_infomask"), F.col("_xmax")))
    for mode in ("live", "all", "deleted"):
        want = {r.id for r in everything.where(admitted(F.col("s"), mode)).collect()}
        assert {r.id for r in reader(str(tmp_path / "6"), visibility=mode).collect()} == want and 0 < len(want) < len(rows)


def test_page_size(tmp_path):
    (tmp_path / "p").write_bytes(b"".join(make_page([make_tuple(parse_columns("id int4"), (i,))], 16384) for i in range(4)))
    assert detect_page_size(str(tmp_path / "p")) == 16384


def test_layout_json():
    columns = parse_columns('[{"name": "a", "type": 23}, {"name": "b", "type": "text", "dropped": true}]')
    assert columns == parse_columns(dump_columns(columns)) and columns[0].kind == "int4" and columns[1].dropped


def test_clog(spark, tmp_path):
    register(spark)
    (tmp_path / "0000").write_bytes(clog_segment({100: 1, 101: 2, 102: 0, 103: 3}))
    (tmp_path / "0001").write_bytes(clog_segment({0: 1}))
    rows = spark.read.format("pgclog").option("nextXid", XIDS_PER_SEGMENT + 1).load(str(tmp_path))
    got = {r.xid: r.status for r in rows.where("xid between 100 and 103 or xid >= 1048576").collect()}
    assert got == {100: 1, 101: 2, 102: 0, 103: 3, XIDS_PER_SEGMENT: 1} and rows.agg({"xid": "min"}).first()[0] == 3


def test_control_and_paths(tmp_path):
    raw = struct.pack("<QIIIxxxxqQQ", 5, 1300, 202107181, 6, 99, 0x16B3748D0, 1) + bytes(16) + struct.pack("<Q", 3 << 32 | 777)
    assert parse_control(raw) == Control(5, 1300, 202107181, "in production", 99, "1/6B3748D0", "0/1", 777)
    assert parse_control(b"short") is None
    assert config_timezone("#timezone = 'A'\ntimezone = 'Asia/Tokyo' # x\n TimeZone='UTC'\n") == "UTC" and config_timezone("x = 1") is None
    (tmp_path / "base" / "5").mkdir(parents=True)
    (tmp_path / "PG_VERSION").write_text("16")
    assert cluster_root(str(tmp_path / "base" / "5" / "1259")) == str(tmp_path)
    assert relation_path(str(tmp_path), 5, 1259).endswith("base/5/1259") and relation_path("r", 0, 1260) == "r/global/1260"
