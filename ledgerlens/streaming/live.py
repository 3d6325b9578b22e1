"""Streams over the ledger: candles, fan-out to subscribers, request costs, and a block sink that can be rolled back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder; the number of files taken at once bounds what a batch holds."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def candles(trades: DataFrame, interval: str, late: str) -> DataFrame:
    """Open, high, low, close, volume and count per token and window; trades that come later than `late` do not count."""
    order = F.struct("ts", "trade")
    return (
        trades.withWatermark("ts", late)
        .groupBy("token", F.window("ts", interval).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("trades"))
        .select("token", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "trades")
    )


def fan_out(changes: DataFrame, subscriptions: DataFrame, on: list[str]) -> DataFrame:
    """Each change once for each subscriber to its keys: a stream joined with a table."""
    return changes.join(subscriptions, on, "inner")


def request_costs(requests: DataFrame, limit: float, decay: float, block: float, late: str = "10 minutes", idle: float = 3600.0) -> DataFrame:
    """ip, at, allowed for requests (ip, at in seconds, cost): a cost that decays, and a block for a time once it reaches the limit.

    Time is that of the requests: one that comes later than `late` behind the newest does not count and gives no row, one
    that comes late within that counts as of the last request of its address. What is kept of an address ends when the
    stream has gone on for `idle` seconds without it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cost, last, until = state.get if state.exists else (0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        allowed = []
        for at, more in zip(rows["at"], rows["cost"], strict=True):
            if at < until:
                allowed.append(False)
                continue
            cost = max(0.0, cost - max(0.0, at - last) * decay)
            last = at
            if cost >= limit:
                cost, until = 0.0, at + block
                allowed.append(False)
            else:
                cost += more
                allowed.append(True)
        state.update((cost, last, until))
        state.setTimeoutTimestamp(max(int((max(last, until) + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"ip": key[0], "at": rows["at"].to_numpy(), "allowed": allowed})

    timed = requests.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("ts", late)
    return timed.groupBy("ip").applyInPandasWithState(run, "ip string, at double, allowed boolean", "cost double, last double, until double", "append", GroupStateTimeout.EventTimeTimeout)


def block_sink(path: str):
    """A foreachBatch function: writes rows by height, so that a batch that runs again replaces what it wrote before."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("height").parquet(path)

    return write


def canonical(spark: SparkSession, path: str, height: int) -> DataFrame:
    """What the sink holds up to a height: rolling back is reading less, and partitions above are pruned."""
    return spark.read.parquet(path).filter(F.col("height") <= height)


def arrivals(before: DataFrame, now: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What a snapshot has that the one before it had not, and the other way round."""
    return now.join(before.select(key), key, "left_anti"), before.join(now.select(key), key, "left_anti")
