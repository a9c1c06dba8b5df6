import random

from tests_feed import CLOG, HEAP, brute, feed

from pagewright.streaming.feed import current, follow


def test_batches_end_where_one_pass_does(spark, tmp_path):
    rng = random.Random(5)
    heap, clog = feed(rng, 120)
    source = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(heap[i::4], HEAP).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(HEAP).option("maxFilesPerTrigger", 1).parquet(source)
    folder = str(tmp_path / "state")
    query = follow(stream, folder).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.rel_oid, r.page_no, r.item_no) for r in current(spark, folder, spark.createDataFrame(clog, CLOG)).collect()}
    assert got == brute(heap, clog)
