"""Tokens: catalogue, holders, supply, events, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ledger import as_of
from ledgerlens.operators.paging import clamp, first_per_group, page


def holdings(outputs: DataFrame) -> DataFrame:
    """token, account, amount of what is not spent."""
    return as_of(outputs).groupBy("token", "account").agg(F.sum("amount").cast("long").alias("amount")).filter("amount > 0")


def by_type(tokens: DataFrame, kind: str, limit: int = 100, order: str = "ref") -> DataFrame:
    by = [F.asc("ref")] if order == "ref" else [F.desc("height"), F.asc("ref")]
    return page(tokens.filter(F.col("type") == kind), by, limit)


def recent(tokens: DataFrame, limit: int = 100) -> DataFrame:
    return page(tokens, [F.desc("height"), F.asc("ref")], limit)


def by_protocol(tokens: DataFrame, protocol: str, limit: int = 100) -> DataFrame:
    """tokens must have `protocols`, a list."""
    return page(tokens.filter(F.array_contains("protocols", protocol)).drop("protocols"), [F.desc("height"), F.asc("ref")], limit)


def search(tokens: DataFrame, name: str, protocols: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Tokens of exactly that name in any case, with one of the protocols if any are given."""
    found = tokens.filter(F.lower("name") == name.lower())
    if protocols:
        found = found.filter(F.arrays_overlap("protocols", F.array(*map(F.lit, protocols))))
    return page(found.drop("protocols"), [F.asc("ref")], limit)


def holders_page(outputs: DataFrame, token: int, start: int = 0, limit: int = 100) -> DataFrame:
    """Holders in the order of their keys, from `start` on."""
    held = holdings(outputs.filter(F.col("token") == token))
    return held.filter(F.col("account") >= start).orderBy("account").limit(clamp(limit, 1, 500)).select("account", "amount")


def top_holders(outputs: DataFrame, k: int = 3) -> DataFrame:
    """The k largest holders of every token, with their share of what is held in per cent."""
    held = holdings(outputs)
    supply = held.groupBy("token").agg(F.sum("amount").alias("supply"))
    top = first_per_group(held, ["token"], [F.desc("amount"), F.asc("account")], k)
    return top.join(supply, "token").select("token", "rank", "account", "amount", F.round(F.col("amount") / F.col("supply") * 100, 4).alias("percent"))


def supply(outputs: DataFrame) -> DataFrame:
    """Per token: what is held, by how many, what was ever made, what is gone."""
    return (
        outputs.groupBy("token", "account")
        .agg(F.sum("amount").alias("made"), F.sum(F.when(F.col("spent"), 0).otherwise(F.col("amount"))).alias("held"), F.count(F.when(F.col("spent"), 1)).alias("gone"))
        .groupBy("token")
        .agg(F.sum("held").cast("long").alias("circulating"), F.count(F.when(F.col("held") > 0, 1)).alias("holders"), F.sum("made").cast("long").alias("minted"), F.sum("gone").cast("long").alias("burns"))
        .withColumn("supply", F.when((F.col("circulating") == 0) & (F.col("minted") > 0), F.col("minted")).otherwise(F.col("circulating")))
    )


def events(outputs: DataFrame) -> DataFrame:
    """token, height, tx, event: a mint for each output, a burn for each that is spent."""
    made = outputs.select("token", "height", "tx", F.lit(1).alias("event"), "amount")
    return made.unionByName(outputs.filter("spent").select("token", F.col("spend_height").alias("height"), "tx", F.lit(3).alias("event"), "amount"))


def events_page(outputs: DataFrame, token: int, event: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a token's events in chain order, each row with the number of all."""
    found = events(outputs).filter(F.col("token") == token)
    if event is not None:
        found = found.filter(F.col("event") == event)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page(found, [F.asc("height"), F.asc("tx"), F.asc("event"), F.asc("amount")], limit, offset).crossJoin(F.broadcast(total))


def stats(tokens: DataFrame) -> DataFrame:
    """Counts of tokens in all, by type and by ticker."""
    return tokens.groupingSets([[], [F.col("type")], [F.col("ticker")]], F.col("type"), F.col("ticker")).agg(F.count(F.lit(1)).alias("n"), F.min("height").alias("first_height"))


def companions(outputs: DataFrame) -> DataFrame:
    """token, tx, first_token, companions: tokens first made in a transaction with others, the least of these, and how many others there are."""
    made = outputs.groupBy("token").agg(F.min(F.struct("height", "tx")).alias("m")).select("token", F.col("m.tx").alias("tx"))
    groups = made.groupBy("tx").agg(F.min("token").alias("first_token"), (F.count(F.lit(1)) - 1).alias("companions")).filter("companions > 0")
    return made.join(groups, "tx").select("tx", "token", "first_token", "companions")


def account_tokens(outputs: DataFrame, tokens: DataFrame, account: int) -> DataFrame:
    held = holdings(outputs.filter(F.col("account") == account))
    return held.join(tokens, held.token == tokens.ref).select("ref", "name", "ticker", "amount")
