import random

from pyspark.sql import functions as F

from glosswork.streaming import inflight

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def plain(rows, within):
    out, last = [], {}
    for i, at, key, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "done":
            last[key] = None
        else:
            if last.get(key) is None or (at - last[key]) * 1000 > within:
                out.append(i)
            last[key] = at
    return sorted(out)


def test_batch_and_restarted_stream(spark, tmp_path):
    """The stream, stopped and restarted from its checkpoint between files, takes up what the batch and a plain loop do; silence and completions free a key."""
    rng = random.Random(3)
    rows = [(i, 1_700_000_000 + i * 7 + rng.randrange(3), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["ask", "ask", "done"])) for i in range(300)]
    rows += [(300, rows[-1][1] + 9999, 1, "ask"), (301, rows[-1][1] + 9999, 1, "ask"), (302, rows[-1][1] + 9999, 7, "done")]
    within = 20_000
    cut = [rows[:100], rows[100:101], rows[101:220], rows[220:]]
    df = lambda some: spark.createDataFrame(some, "event_id long, s long, user_id long, event_type string").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type")

    def taken(events):
        return inflight.taken_up(events, F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("event_type") == "done", within)

    want = plain(rows, within)
    assert sorted(r.event_id for r in taken(df(rows)).collect()) == want and 50 < len(want) < 250
    assert taken(df(rows[:0])).count() == 0
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate(cut):
            df(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = taken(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
            query.awaitTermination(240)
            assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
