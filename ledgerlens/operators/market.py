"""Trades, candles, prices, order books, listings and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.paging import clamp, first_per_group, page

DAY = 86_400


def candles(trades: DataFrame, seconds: int) -> DataFrame:
    """Open, high, low, close, volume and count per token and interval; trades of the same second are in the order of their numbers."""
    order = F.struct("ts", "trade")
    return trades.groupBy("token", (F.floor(F.col("ts") / seconds) * seconds).cast("long").alias("start")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").cast("long").alias("volume"), F.count(F.lit(1)).alias("trades")
    )


def last_candles(trades: DataFrame, token: str, seconds: int, limit: int = 100) -> DataFrame:
    """The last candles of a token, the earliest first."""
    return candles(trades.filter(F.col("token") == token), seconds).orderBy(F.desc("start")).limit(clamp(limit, 1, 1000)).orderBy("start")


def trades_between(trades: DataFrame, token: str, start: int = 0, end: int = 0, limit: int = 50) -> DataFrame:
    """A token's trades from start to end, both included, 0 for no bound, the latest first."""
    found = trades.filter(F.col("token") == token)
    if start:
        found = found.filter(F.col("ts") >= start)
    if end:
        found = found.filter(F.col("ts") <= end)
    return page(found, [F.desc("ts"), F.desc("trade")], limit)


def latest_prices(trades: DataFrame) -> DataFrame:
    order = F.struct("ts", "trade")
    return trades.groupBy("token").agg(F.max_by("price", order).alias("price"), F.max("ts").alias("ts"))


def volumes(trades: DataFrame, at: int, span: int = DAY) -> DataFrame:
    """Volume and count of each token within `span` seconds up to `at`."""
    return trades.filter((F.col("ts") >= at - span) & (F.col("ts") <= at)).groupBy("token").agg(F.sum("amount").cast("long").alias("volume"), F.count(F.lit(1)).alias("trades"))


def daily_volumes(trades: DataFrame) -> DataFrame:
    return trades.groupBy("token", F.floor(F.col("ts") / DAY).cast("long").alias("dy")).agg(F.sum("amount").cast("long").alias("volume"))


def summary(trades: DataFrame, at: int) -> DataFrame:
    """Per token: price, the last price in the hour that ended a day before, the change, and a day's volume; one pass over trades."""
    order = F.struct("ts", "trade")
    up_to = F.col("ts") <= at
    before = F.col("ts").between(at - DAY - 3600, at - DAY)
    recent = F.col("ts").between(at - DAY, at)
    made = trades.groupBy("token").agg(
        F.max_by("price", F.when(up_to, order)).alias("price"),
        F.max_by("price", F.when(before, order)).alias("price_24h_ago"),
        F.coalesce(F.sum(F.when(recent, F.col("amount"))), F.lit(0)).cast("long").alias("volume"),
        F.count(F.when(recent, 1)).alias("trades"),
    )
    change = F.col("price") - F.col("price_24h_ago")
    return made.withColumn("change_24h", change).withColumn("change_24h_pct", F.bround((change * 100).cast("double") / F.col("price_24h_ago"), 2))


def live(orders: DataFrame, tip: int) -> DataFrame:
    """Orders that are open or partly filled and not expired at the tip."""
    return orders.filter(F.col("state").isin("OPEN", "PARTIAL") & ~((F.col("expiry") > 0) & (F.col("expiry") <= tip)))


def order_book(orders: DataFrame, tip: int, limit: int = 50) -> DataFrame:
    """The best orders of each pair and side: the cheapest to buy from, the dearest to sell to."""
    by = F.when(F.col("side") == "SELL", F.col("price")).otherwise(-F.col("price"))
    return first_per_group(live(orders, tip), ["pair", "side"], [by, F.asc("order")], limit).select("pair", "side", "rank", "order", "price")


def open_orders(orders: DataFrame, tip: int, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(live(orders, tip), [F.asc("pair"), F.asc("side"), F.asc("price"), F.asc("order")], limit, offset)


def maker_orders(orders: DataFrame, maker: int, state: str | None = None, limit: int = 100) -> DataFrame:
    found = orders.filter(F.col("maker") == maker)
    return page(found.filter(F.col("state") == state) if state else found, [F.asc("order")], limit)


def filled(orders: DataFrame, limit: int = 100) -> DataFrame:
    return page(orders.filter(F.col("state") == "FILLED"), [F.desc("height"), F.desc("order")], limit)


def shown(orders: DataFrame, tip: int) -> DataFrame:
    """Orders as they are shown: expired where they have not been filled in time."""
    late = F.col("state").isin("OPEN", "PARTIAL") & (F.col("expiry") > 0) & (F.col("expiry") <= tip)
    return orders.withColumn("state", F.when(late, "EXPIRED").otherwise(F.col("state")))


def lifecycle(orders: DataFrame, spends: DataFrame) -> DataFrame:
    """Orders with the height of the first spend of what backs them, from their own height on: filled if there is one."""
    first = orders.join(spends, "order", "left").filter(F.col("spend_height").isNull() | (F.col("spend_height") >= F.col("height")))
    closed = first.groupBy("order").agg(F.min("spend_height").alias("closed"))
    return orders.join(closed, "order", "left").select("order", "height", "closed", F.when(F.col("closed").isNull(), "OPEN").otherwise("FILLED").alias("state"))


def pair_stats(orders: DataFrame, tip: int, span: int) -> DataFrame:
    """Per pair: last price, high, low and volume of what was filled within `span` blocks up to the tip, and open orders on each side."""
    done, order = F.col("state") == "FILLED", F.struct("height", "order")
    recent = done & (F.col("height") > tip - span)
    open_ = F.col("state").isin("OPEN", "PARTIAL") & ~((F.col("expiry") > 0) & (F.col("expiry") <= tip))
    return orders.groupBy("pair").agg(
        F.max_by("price", F.when(done, order)).alias("last"),
        F.max(F.when(recent, F.col("price"))).alias("high"),
        F.min(F.when(recent, F.col("price"))).alias("low"),
        F.coalesce(F.sum(F.when(recent, F.col("price"))), F.lit(0)).cast("long").alias("volume"),
        F.count(F.when(open_ & (F.col("side") == "BUY"), 1)).alias("bids"),
        F.count(F.when(open_ & (F.col("side") == "SELL"), 1)).alias("asks"),
    )


def profit() -> Column:
    return F.col("reward").cast("double") / F.coalesce(F.nullif(F.col("difficulty"), F.lit(0)), F.lit(1))


def contracts_page(contracts: DataFrame, active: bool | None = None, algorithm: int | None = None, sort: str = "reward", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """Contracts by one of their fields or by profit, each row with the number of all that match."""
    if sort not in {"reward", "difficulty", "name", "ref", "algorithm", "profit"}:
        raise ValueError(f"no such order: {sort}")
    if active is not None:
        contracts = contracts.filter(F.col("active") == active)
    if algorithm is not None:
        contracts = contracts.filter(F.col("algorithm") == algorithm)
    key = profit() if sort == "profit" else F.col(sort)
    total = contracts.agg(F.count(F.lit(1)).alias("total"))
    return page(contracts, [key.desc() if descending else key.asc(), F.asc("ref")], limit, offset).crossJoin(F.broadcast(total))


def most_profitable(contracts: DataFrame, limit: int = 10) -> DataFrame:
    rated = contracts.filter("active").withColumn("profit", profit())
    return page(rated, [F.desc("profit"), F.asc("ref")], limit).select("ref", "reward", "difficulty", "profit")


def contract_stats(contracts: DataFrame) -> DataFrame:
    """Counts and rewards in all, by algorithm and by state."""
    return contracts.groupingSets([[], [F.col("algorithm")], [F.col("active")]], F.col("algorithm"), F.col("active")).agg(F.count(F.lit(1)).alias("n"), F.sum("reward").cast("long").alias("reward"))


def reconcile(known: DataFrame, indexed: DataFrame, key: str, value: str) -> DataFrame:
    """What to do with each key so that known becomes indexed: INSERT, UPDATE, DELETE, or KEEP."""
    a = known.select(key, F.col(value).alias("old"))
    b = indexed.select(key, F.col(value).alias("new"))
    step = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(F.col("old") != F.col("new"), "UPDATE").otherwise("KEEP")
    return a.join(b, key, "full").select(key, step.alias("step"))


def without_denied(contracts: DataFrame, denied: DataFrame) -> DataFrame:
    return contracts.join(denied, "ref", "left_anti")


def running_count(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return df.withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
