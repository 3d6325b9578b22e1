"""Distributed prefix doubling on sampled positions.

Every round sorts position-rank pairs: a position's rank with that of the position 2**j samples further on and
the distance between them. Positions whose pair occurs once leave, the others get the pair's new rank, and a
position is settled when what its rank stands for is as long as a window.

The sampled positions are the anchors of repeats.py, with a rank for the k bytes there. Two neighbours are no
further apart than k as long as windows follow each other, so ranks and distances determine every byte in
between: equal ranks mean equal strings. A rank is two 64-bit hashes of the pair that it names, not its number in an
order: only whether ranks are equal is asked here.

With all positions, a corpus of B bytes would sort 24 B bytes a round; the samples are about a fiftieth of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, meet, release
from ledgerlens.llm.repeats import Repeats, unlist


def by_doubling(spark: SparkSession, repeats: Repeats, texts: DataFrame, name: str) -> DataFrame:
    """The runs of the anchors that occur again, settled if ranks past the threshold cover all their windows."""
    if repeats.k < repeats.n - repeats.k + 1:
        raise ValueError("neighbouring samples must touch")
    rows = repeats.anchors(texts, 2)
    twice = cut(spark, repeats.anchors(texts).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{name}-twice")
    at = F.shiftright("place", 32).cast("int")
    live = meet(rows, twice, ["name"], "left_semi").select(
        "key",
        at.alias("at"),
        F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("number"),
        F.col("name").alias("r1"),
        F.col("name2").alias("r2"),
        (at - F.shiftright("lead", 8)).alias("s"),
        (at - F.col("lead").bitwiseAND(F.lit(255))).alias("e"),
    )
    live = cut(spark, live, f"{name}-ranks")
    release(spark)
    state = live.select("key", "number", "at", (F.col("at") + repeats.k).alias("end"), "r1", "r2")
    step, settled = 1, []
    while not state.filter(F.col("end") - F.col("at") < repeats.n).isEmpty():
        ahead = Window.partitionBy("key").orderBy("number").rangeBetween(step, step)
        pairs = (
            state.withColumn("next", F.first(F.struct("at", "end", "r1", "r2")).over(ahead))
            .filter(F.col("next").isNotNull() & (F.col("end") - F.col("at") < repeats.n) & (F.col("next.at") <= F.col("end")))
            .select(
                "key",
                "number",
                "at",
                F.col("next.end").alias("end"),
                F.xxhash64("r1", F.col("next.at") - F.col("at"), F.col("next.r1")).alias("r1"),
                F.xxhash64(F.lit(step), "r2", F.col("next.at") - F.col("at"), F.col("next.r2")).alias("r2"),
            )
        )
        pairs = cut(spark, pairs, f"{name}-pairs{step}")
        again = cut(spark, pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{name}-classes{step}")
        state = cut(spark, meet(pairs, again, ["r1", "r2"], "left_semi"), f"{name}-ranks{step}")
        settled.append(state.filter(F.col("end") - F.col("at") >= repeats.n).select("key", F.col("at").alias("s"), (F.col("end") - repeats.n).alias("e")))
        release(spark)
        step *= 2
    none = F.lit(None)
    runs = live.select("key", none.cast("struct<s: int, e: int>").alias("done"), F.struct(F.col("r1").alias("name"), "at", "s", "e").alias("run"))
    for rows in settled:
        runs = runs.unionByName(rows.select("key", F.struct("s", "e").alias("done"), none.cast("struct<name: long, at: int, s: int, e: int>").alias("run")))
    lists = runs.groupBy("key").agg(F.collect_list("done").alias("done"), F.collect_list("run").alias("runs"))
    return lists.mapInArrow(_settle, "name long, key long, at int, s int, e int, again boolean").withColumn("first", F.lit(True))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which runs lie within the done windows of their text."""
    for batch in batches:
        done, of = unlist(batch.column(1))
        runs, text = unlist(batch.column(2))
        s, e = (runs.field(x).to_numpy().astype(np.int64) for x in ("s", "e"))
        longest = np.zeros(batch.num_rows, np.int64)
        np.maximum.at(longest, text, e + 1)
        off = np.append(0, np.cumsum(longest + 1))
        edge = np.zeros(int(off[-1]) + 1, np.int64)
        np.add.at(edge, off[of] + done.field("s").to_numpy(), 1)
        np.add.at(edge, off[of] + done.field("e").to_numpy() + 1, -1)
        total = np.append(0, np.cumsum(np.cumsum(edge) > 0))
        again = total[off[text] + e + 1] - total[off[text] + s] == e - s + 1
        yield pa.RecordBatch.from_arrays([runs.field("name"), batch.column(0).take(pa.array(text)), *[runs.field(x) for x in ("at", "s", "e")], pa.array(again)], names=["name", "key", "at", "s", "e", "again"])
