"""The truth table of visibility: all flag combinations, with and without a commit log."""

import itertools

from pyspark.sql import functions as F

from pagewright.operators import visibility as V

FLAGS = (0x100, 0x200, 0x400, 0x800, 0x80, 0x1000)


def expected(mask, xmax, xmin_status=None, xmax_status=None, log=False):
    if mask & 0x200 and not mask & 0x100:
        return "aborted"
    if log and not mask & 0x300 and xmin_status in (0, 2):
        return "aborted"
    if mask & 0x880:
        return "live"
    if mask & 0x1400:
        return "deleted"
    if xmax == 0:
        return "live"
    if log and xmax_status in (1, 3):
        return "deleted"
    if log and xmax_status == 2:
        return "live"
    return "suspected"


def test_truth_table(spark):
    masks = [sum(c) for n in range(7) for c in itertools.combinations(FLAGS, n)]
    rows = [(m, x, a, b) for m in masks for x in (0, 900) for a in (None, 0, 1, 2, 3) for b in (None, 0, 1, 2, 3)]
    df = spark.createDataFrame(rows, "mask int, xmax bigint, a int, b int")
    hints = V.visibility(F.col("mask"), F.col("xmax"))
    log = V.visibility(F.col("mask"), F.col("xmax"), F.col("a"), F.col("b"))
    for r in df.select("*", hints.alias("h"), log.alias("l")).collect():
        assert r.h == expected(r.mask, r.xmax), r
        assert r.l == expected(r.mask, r.xmax, r.a, r.b, True), r


def test_modes(spark):
    df = spark.createDataFrame([(s,) for s in ("live", "deleted", "suspected", "aborted")], "s string")
    admitted = lambda m: {r.s for r in df.where(V.admitted(F.col("s"), m)).collect()}
    assert admitted("live") == {"live", "suspected"}
    assert admitted("all") == {"live", "deleted", "suspected"}
    assert admitted("deleted") == {"deleted", "suspected"}
    marks = {r.s: r.m for r in df.select("s", V.deleted_mark(F.col("s")).alias("m")).collect()}
    assert marks == {"live": "", "deleted": "DELETED", "suspected": "SUSPECTED_DELETED", "aborted": ""}
