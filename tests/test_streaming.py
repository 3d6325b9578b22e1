"""A stream's result is the batch's."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import market
from ledgerlens.sources import tables as T
from ledgerlens.streaming import live


def drained(writer):
    """Runs the stream over what there is, and fails if that does not end."""
    query = writer.trigger(availableNow=True).start()
    ended = query.awaitTermination(90)
    query.stop()
    assert ended, "the stream does not come to an end"


def test_candles(spark, small, tmp_path):
    trades = T.trades(spark, small).withColumn("ts", F.col("ts").cast("timestamp")).select("trade", "token", "price", "amount", "ts")
    trades.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = live.candles(live.follow(spark, str(tmp_path / "in"), trades._jdf.schema().toDDL(), 2), "1 day", "36500 days")
    drained(stream.writeStream.outputMode("complete").format("memory").queryName("candles").option("checkpointLocation", str(tmp_path / "c")))
    got = spark.table("candles").withColumn("start", F.unix_timestamp("start"))
    want = market.candles(T.trades(spark, small), 86_400)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_costs(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((f"ip{rng.randrange(4)}", round(rng.uniform(0, 100), 3), float(rng.randrange(1, 9))) for _ in range(300))
    spark.createDataFrame(rows, "ip string, at double, cost double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.request_costs(live.follow(spark, str(tmp_path / "in"), "ip string, at double, cost double"), 20.0, 1.0, 5.0)
    drained(stream.writeStream.outputMode("append").format("memory").queryName("costs").option("checkpointLocation", str(tmp_path / "c")))
    state, want = {}, []
    for ip, at, more in rows:
        cost, last, until = state.get(ip, (0.0, 0.0, 0.0))
        if at < until:
            want.append((ip, at, False))
            continue
        cost = max(0.0, cost - (at - last) * 1.0)
        ok = cost < 20.0
        state[ip] = (cost + more, at, until) if ok else (0.0, at, at + 5.0)
        want.append((ip, at, ok))
    assert sorted(map(tuple, spark.table("costs").collect())) == sorted(want) and {x[2] for x in want} == {True, False}


def test_costs_forget_idle_addresses_and_leave_out_what_is_too_late(spark, tmp_path):
    """Three files, one a batch: a request 2 hours behind the newest is left out, and an idle address begins anew."""
    batches = [[("a", 5.0, 30.0), ("b", 10.0, 1.0)], [("b", 20_000.0, 1.0)], [("b", 12_000.0, 1.0), ("a", 20_001.0, 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ip string, at double, cost double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.request_costs(live.follow(spark, str(tmp_path / "in"), "ip string, at double, cost double"), 20.0, 0.0, 5.0)
        drained(stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    # the cost of 30 that would have refused a's second request is forgotten
    assert got == [("a", 5.0, True), ("a", 20_001.0, True), ("b", 10.0, True), ("b", 20_000.0, True)]


def test_sink_runs_again_without_doubling_and_rolls_back(spark, tmp_path):
    rows = spark.createDataFrame([(h, h * 10 + i) for h in range(6) for i in range(3)], "height long, tx long")
    write = live.block_sink(str(tmp_path / "out"))
    write(rows, 0)
    write(rows.filter("height >= 4"), 1)
    assert live.canonical(spark, str(tmp_path / "out"), 9).count() == 18 and live.canonical(spark, str(tmp_path / "out"), 3).count() == 12


def test_subscribers_and_snapshots(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "account string, delta long").write.parquet(str(tmp_path / "in"))
    who = spark.createDataFrame([("a", "x"), ("a", "y")], "account string, client string")
    stream = live.fan_out(live.follow(spark, str(tmp_path / "in"), "account string, delta long", 99), who, ["account"])
    drained(stream.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")))
    assert sorted((r.client, r.delta) for r in spark.table("told").collect()) == [("x", 1), ("x", 3), ("y", 1), ("y", 3)]
    came, went = live.arrivals(spark.range(0, 5), spark.range(3, 8), "id")
    assert came.count() == 3 and went.count() == 3
