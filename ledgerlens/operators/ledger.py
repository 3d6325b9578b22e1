"""Balances, outputs, history and statistics of a ledger of outputs.

All state is a view of outputs with the height at which they were made and, where they are spent, spent. As of any
height: made up to it, and not spent up to it. Rolling back is reading at a lower height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions import fixed
from ledgerlens.operators.paging import page


def as_of(outputs: DataFrame, height: int | None = None) -> DataFrame:
    """Outputs that are not spent, at a height or at the end."""
    if height is None:
        return outputs.filter(F.col("spend_height").isNull())
    return outputs.filter((F.col("height") <= height) & (F.col("spend_height").isNull() | (F.col("spend_height") > height)))


def balances(outputs: DataFrame, height: int | None = None) -> DataFrame:
    return as_of(outputs, height).groupBy("account").agg(F.sum("value").cast("long").alias("balance"))


def unspent(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs that no input names."""
    return outputs.join(inputs, ["tx", "vout"], "left_anti")


def resolve_spends(inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs with the output that they spend, and inputs whose output does not exist."""
    return inputs.join(outputs, ["tx", "vout"], "inner"), inputs.join(outputs, ["tx", "vout"], "left_anti")


def rich_list(outputs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(balances(outputs).filter("balance > 0"), [F.desc("balance"), F.asc("account")], limit, min(offset, 10_000))


def _all_labels(spark, bounds, found: DataFrame, *sums: str) -> DataFrame:
    labels = spark.createDataFrame([(i, name) for i, (_, name) in enumerate(bounds)], "place long, bucket string")
    return labels.join(found, "bucket", "left").select("place", "bucket", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in sums])


def balance_distribution(outputs: DataFrame, coin: int = fixed.COIN) -> DataFrame:
    """Accounts and what they hold by size of balance; every label has a row."""
    held = balances(outputs).filter("balance > 0").groupBy(C.balance_bucket(F.col("balance"), coin).alias("bucket")).agg(F.count(F.lit(1)).alias("accounts"), F.sum("balance").alias("amount"))
    return _all_labels(outputs.sparkSession, fixed.BALANCE_BUCKETS, held, "accounts", "amount")


def supply_aging(outputs: DataFrame, tip: Column | int, blocks_per_day: int = 1) -> DataFrame:
    """What is unspent by its age in days."""
    days = F.floor((F.lit(tip) - F.col("height")) / blocks_per_day)
    held = as_of(outputs).groupBy(C.age_bucket(days).alias("bucket")).agg(F.sum("value").alias("amount"))
    return _all_labels(outputs.sparkSession, fixed.AGE_BUCKETS, held, "amount")


def entries(outputs: DataFrame) -> DataFrame:
    """account, height, delta, phase: what enters (0) and leaves (1) an account; outputs are made before they are spent."""
    made = outputs.select("account", "height", F.col("value").alias("delta"), F.lit(0).alias("phase"))
    spent = outputs.filter(F.col("spend_height").isNotNull()).select("account", F.col("spend_height").alias("height"), (-F.col("value")).alias("delta"), F.lit(1).alias("phase"))
    return made.unionByName(spent)


def block_balances(outputs: DataFrame) -> DataFrame:
    """account, height, delta, balance (after the block), before."""
    w = Window.partitionBy("account").orderBy("height")
    blocks = entries(outputs).groupBy("account", "height").agg(F.sum("delta").cast("long").alias("delta"))
    run = F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return blocks.withColumn("balance", run).withColumn("before", F.col("balance") - F.col("delta"))


def daily_movement(outputs: DataFrame, blocks_per_day: int = fixed.BLOCKS_PER_DAY) -> DataFrame:
    """Per day, with none left out: coins that moved, receivers counted once a block, accounts that went from nothing to something."""
    day = lambda h: F.floor(F.col(h) / blocks_per_day).cast("long")
    received = outputs.groupBy("height", "account").agg(F.sum("value").alias("value")).groupBy(day("height").alias("dy")).agg(F.sum("value").cast("long").alias("moved"), F.count(F.lit(1)).alias("active"))
    fresh = block_balances(outputs).filter("before <= 0 and balance > 0").groupBy(day("height").alias("dy")).agg(F.count(F.lit(1)).alias("fresh"))
    ends = received.agg(F.min("dy").alias("a"), F.max("dy").alias("b"))
    days = ends.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("dy"))
    return days.join(received, "dy", "left").join(fresh, "dy", "left").select("dy", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("moved", "active", "fresh")])


def clamped_balances(moves: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The running value of max(0, value + delta), without a fold: the sum so far less the least sum so far, if that is below zero."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = moves.withColumn("running", F.sum("delta").over(w).cast("long"))
    return total.withColumn("clamped", F.col("running") - F.least(F.lit(0), F.min("running").over(w)))


def merged_balances(outputs: DataFrame, mempool_from: int) -> DataFrame:
    """account, confirmed, unconfirmed: unconfirmed is what transactions that are in no block yet would change."""
    confirmed = balances(outputs.filter(F.col("height") < mempool_from), mempool_from - 1).withColumnRenamed("balance", "confirmed")
    pending = entries(outputs).filter(F.col("height") >= mempool_from).groupBy("account").agg(F.sum("delta").cast("long").alias("unconfirmed"))
    return confirmed.join(pending, "account", "full").select("account", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("confirmed", "unconfirmed")])


def history(txs: DataFrame, mempool_from: int) -> DataFrame:
    """account, tx, height, source: confirmed transactions first (0), then those of the mempool (1) at height 0."""
    done = txs.filter(F.col("height") < mempool_from).select("account", "tx", "height", F.lit(0).alias("source"))
    return done.unionByName(txs.filter(F.col("height") >= mempool_from).select("account", "tx", F.lit(0).cast("long").alias("height"), F.lit(1).alias("source")))


def address_status(txs: DataFrame) -> DataFrame:
    """SHA-256 over `tx:height:` of an account's transactions in chain order."""
    items = F.array_sort(F.collect_list(F.struct("height", "tx")))
    text = F.array_join(F.transform(items, lambda x: F.concat(x["tx"].cast("string"), F.lit(":"), x["height"].cast("string"), F.lit(":"))), "")
    return txs.groupBy("account").agg(F.sha2(text, 256).alias("status"))


def fees(outputs: DataFrame) -> DataFrame:
    """Per transaction what its spent outputs held beyond those that are not spent, at least 0."""
    spent, kept = F.sum(F.when(F.col("spent"), F.col("value")).otherwise(0)), F.sum(F.when(~F.col("spent"), F.col("value")).otherwise(0))
    return outputs.groupBy("tx").agg(F.greatest(F.lit(0), spent - kept).cast("long").alias("fee"))


def mempool_state(outputs: DataFrame, mempool_from: int) -> DataFrame:
    """Per account in one pass: new outputs, transactions, and the change of the balance."""
    pool = outputs.filter(F.col("height") >= mempool_from)
    return pool.groupBy("account").agg(
        F.count(F.lit(1)).alias("outputs"),
        F.countDistinct("tx").alias("transactions"),
        F.sum(F.when(F.col("spent"), 0).otherwise(F.col("value"))).cast("long").alias("delta"),
        F.max("spent").alias("spends"),
    )
