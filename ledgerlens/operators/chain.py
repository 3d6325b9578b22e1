"""Blocks: continuity, reorganisation, positions, Merkle trees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import double_sha256


def blocks(txs: DataFrame) -> DataFrame:
    """height, n_tx, cumulative: the number of transactions up to each block.

    One row per block after the partial count; the running sum runs over segments of blocks and their totals, so it is no
    window over all rows in one task.
    """
    size = 10_000
    counts = txs.groupBy("height").agg(F.count(F.lit(1)).alias("n_tx")).withColumn("segment", F.floor(F.col("height") / size))
    totals = counts.groupBy("segment").agg(F.sum("n_tx").alias("t"))
    base = totals.select("segment", F.coalesce(F.sum("t").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.sum("n_tx").over(Window.partitionBy("segment").orderBy("height").rowsBetween(Window.unboundedPreceding, 0))
    return counts.join(F.broadcast(base), "segment").select("height", "n_tx", (F.col("base") + run).cast("long").alias("cumulative"))


def height_of(numbers: DataFrame, blocks: DataFrame, number: str = "number") -> DataFrame:
    """numbers with the height of the block that holds the transaction of that number: the first whose cumulative count is larger.

    An as-of join by a union in order: each segment of numbers carries the last block edge before it.
    """
    width = 10_000
    edges = blocks.select((F.col("cumulative") - F.col("n_tx")).alias(number), "height").withColumn("probe", F.lit(0))
    asked = numbers.select(number).withColumn("height", F.lit(None).cast("long")).withColumn("probe", F.lit(1))
    both = edges.unionByName(asked).withColumn("segment", F.floor(F.col(number) / width))
    last = edges.withColumn("segment", F.floor(F.col(number) / width)).groupBy("segment").agg(F.max_by("height", number).alias("h"))
    carry = last.select("segment", F.last("h", True).over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    # a segment without an edge of its own takes the edge of the nearest before it
    spans = carry.select("upto", F.col("segment").alias("a"), F.lead("segment").over(Window.orderBy("segment")).alias("b"))
    w = Window.partitionBy("segment").orderBy(number, "probe").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("own", F.last("height", True).over(w)).filter("probe = 1")
    known = within.filter("own is not null").select(number, F.col("own").alias("height"))
    open_ = within.filter("own is null").select(number, "segment")
    before = open_.join(F.broadcast(spans), (F.col("a") < F.col("segment")) & (F.col("b").isNull() | (F.col("b") >= F.col("segment")))).select(number, F.col("upto").alias("height"))
    return known.unionByName(before)


def breaks(blocks: DataFrame) -> DataFrame:
    """Blocks whose previous hash is not the hash of the block before: a self-join on neighbouring heights."""
    before = blocks.select((F.col("height") + 1).alias("height"), F.col("hash").alias("expected"))
    return blocks.join(before, "height").filter(F.col("prev_hash") != F.col("expected")).select("height", "hash", "prev_hash", "expected")


def reorg_point(local: DataFrame, remote: DataFrame) -> DataFrame:
    """height: the first at which two chains differ."""
    return local.alias("a").join(remote.alias("b"), "height").filter(F.col("a.hash") != F.col("b.hash")).agg(F.min("height").alias("height"))


def merkle_levels(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """block, pos, n (of the level), hash: the levels of every block's tree, leaves first; a block that is done keeps its root.

    A level is an aggregate over (block, pair) of the one below, so blocks of any size are spread; the level's size is carried along.
    """
    out = [leaves.select("block", "pos", "hash").join(leaves.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block").select("block", "pos", "n", "hash")]
    for _ in range(levels):
        pair = out[-1].groupBy("block", F.floor(F.col("pos") / 2).alias("pos")).agg(F.min_by("hash", "pos").alias("a"), F.max_by("hash", "pos").alias("b"), F.first("n").alias("n"))
        joint = F.when(F.col("n") == 1, F.col("a")).otherwise(double_sha256(F.concat("a", "b")))
        out.append(pair.select("block", "pos", F.ceil(F.col("n") / 2).alias("n"), joint.alias("hash")))
    return out


def _depth(leaves: DataFrame) -> int:
    return ((leaves.groupBy("block").count().agg(F.max("count")).first()[0] or 1) - 1).bit_length()


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """block, root"""
    return merkle_levels(leaves, _depth(leaves))[-1].select("block", F.col("hash").alias("root"))


def merkle_branch(leaves: DataFrame, asked: DataFrame, star: bool = False) -> DataFrame:
    """block, pos, branch: for each asked (block, pos) the partner hashes from the leaf up.

    star: a partner that is the node itself, doubled at a level's end, is left out as null (the short form of proofs).
    """
    found = asked.select("block", "pos", F.lit(None).cast("struct<k: int, hash: binary>").alias("s"))
    sized = asked.select("block", F.col("pos").alias("asked")).join(leaves.groupBy("block").agg(F.count(F.lit(1)).alias("leaves")), "block")
    for k, level in enumerate(merkle_levels(leaves, _depth(leaves))[:-1]):
        own, n = F.floor(F.col("asked") / (1 << k)), F.ceil(F.col("leaves") / (1 << k))
        to = sized.filter(n > 1).select("block", "asked", own.alias("own"), F.least(own.bitwiseXOR(F.lit(1)), n - 1).alias("pos"))
        hash_ = F.when(F.col("pos") != F.col("own"), F.col("hash")) if star else F.col("hash")
        found = found.unionByName(to.join(level.select("block", "pos", "hash"), ["block", "pos"]).select("block", F.col("asked").alias("pos"), F.struct(F.lit(k).alias("k"), hash_.alias("hash")).alias("s")))
    return found.groupBy("block", "pos").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["hash"]).alias("branch"))


def shared_dir(spark) -> str:
    """The folder that driver and executors share; a temporary one where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.gettempdir()
    return found.rstrip("/")


def depths(parents: DataFrame) -> DataFrame:
    """tx, depth of transactions (tx, parent) whose parents may be among them: rounds over what is new, until nothing is.

    Each round is written to the shared folder, so chains of any length do not grow the plan.
    """
    spark, run = parents.sparkSession, uuid.uuid4().hex

    def cut(rows: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(spark)}/depths-{run}-{name}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    parents = cut(parents.select("tx", "parent"), "parents")
    known = parents.select(F.col("tx").alias("parent"))
    new = cut(parents.join(known, "parent", "left_anti").select("tx", F.lit(0).cast("long").alias("depth")), "0")
    found, step = new, 0
    while not new.isEmpty():
        step += 1
        new = cut(parents.join(new.select(F.col("tx").alias("parent"), "depth"), "parent").select("tx", (F.col("depth") + 1).alias("depth")), str(step))
        found = found.unionByName(new)
    return found


