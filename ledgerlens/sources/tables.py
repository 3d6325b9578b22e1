"""The driver's tables read as a ledger.

An order is a transaction of its customer in a block that is its day; a line item is an output with its value in base
units, spent if it was returned; a part is a token; an event is a trade; a supplier is a minting contract. Everything else
in the library works on the columns that these functions name, wherever they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = "1995-01-01"
#: Transactions from this day on are not in a block yet.
MEMPOOL_FROM = "2001-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit(START).cast("date")).cast("long")


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx, account, height, state, pair, cents, at"""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx"),
        F.col("o_custkey").alias("account"),
        day("o_orderdate").alias("height"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("pair"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.col("o_orderdate").alias("at"),
    )


def mempool_height() -> int:
    from datetime import date

    return (date.fromisoformat(MEMPOOL_FROM) - date.fromisoformat(START)).days


def outputs(spark: SparkSession, sf_dir: str, rows_each: int | None = None) -> DataFrame:
    """tx, account, height, token, value, amount, spent, spend_height, minter; if asked, dealt by tx to as many tasks as have about rows_each."""
    made = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx"),
        F.col("l_partkey").alias("token"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"),
        F.col("l_quantity").cast("long").alias("amount"),
        (F.col("l_returnflag") == "R").alias("spent"),
        day("l_shipdate").alias("shipped"),
        F.col("l_suppkey").alias("minter"),
    )
    by = txs(spark, sf_dir).select("tx", "account", "height")
    if rows_each and (n := made.count() // rows_each) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        made, by = made.repartition(n, "tx"), by.repartition(n, "tx")
    return made.join(by, "tx").withColumn("spend_height", F.when(F.col("spent"), F.greatest(F.col("height") + 1, F.col("shipped")))).drop("shipped")


def outpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outputs with vout, their place in the transaction"""
    w = Window.partitionBy("tx").orderBy("token", "value", "amount", "minter", F.col("spent").cast("int"), F.coalesce("spend_height", F.lit(-1)))
    return outputs(spark, sf_dir).withColumn("vout", F.row_number().over(w).cast("long") - 1)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, name, ticker, type, height"""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("ticker"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("height"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade, token, price, amount, ts (seconds), buyer"""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trade"),
        F.col("event_type").alias("token"),
        F.round(F.col("value") * 100).cast("long").alias("price"),
        (1 + F.col("event_id") % 10).alias("amount"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id").alias("buyer"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order, maker, pair, side, price, state, height, expiry"""
    return txs(spark, sf_dir).select(
        F.col("tx").alias("order"),
        F.col("account").alias("maker"),
        "pair",
        F.when(F.col("tx") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("cents").alias("price"),
        F.when(F.col("state") == "O", "OPEN").when(F.col("state") == "P", "PARTIAL").otherwise("FILLED").alias("state"),
        "height",
        F.when(F.col("tx") % 3 == 0, F.col("height") + 365).otherwise(F.lit(0)).alias("expiry"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, name, algorithm, reward, difficulty, active"""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ref"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("long").alias("algorithm"),
        F.greatest(F.round(F.col("s_acctbal") * 100).cast("long"), F.lit(0)).alias("reward"),
        (F.col("s_suppkey") % 7).alias("difficulty"),
        (F.col("s_suppkey") % 4 != 0).alias("active"),
    )


#: The same as common table expressions of DuckDB, by name.
SQL = {
    "txs": """txs AS (SELECT o_orderkey AS tx, o_custkey AS account, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS height, o_orderstatus AS state, o_orderpriority AS pair, cast(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS at FROM orders)""",
    "outs": """outs AS (SELECT l_orderkey AS tx, l_partkey AS token, cast(round(l_extendedprice * 100) AS BIGINT) AS value, cast(l_quantity AS BIGINT) AS amount, l_returnflag = 'R' AS spent, l_suppkey AS minter, t.account, t.height,
        CASE WHEN l_returnflag = 'R' THEN greatest(t.height + 1, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT) END AS spend_height FROM lineitem JOIN txs t ON t.tx = l_orderkey)""",
    "points": """points AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY token, value, amount, minter, spent::INT, coalesce(spend_height, -1)) - 1 AS vout FROM outs)""",
    "tokens": """tokens AS (SELECT p_partkey AS ref, p_name AS name, p_brand AS ticker, p_type AS type, p_size::BIGINT AS height FROM part)""",
    "trades": """trades AS (SELECT event_id AS trade, event_type AS token, cast(round(value * 100) AS BIGINT) AS price, 1 + event_id % 10 AS amount, floor(epoch(ts))::BIGINT AS ts, user_id AS buyer FROM events)""",
    "book": """book AS (SELECT tx AS "order", account AS maker, pair, CASE WHEN tx % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, cents AS price, CASE state WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PARTIAL' ELSE 'FILLED' END AS state, height, CASE WHEN tx % 3 = 0 THEN height + 365 ELSE 0 END AS expiry FROM txs)""",
    "contracts": """contracts AS (SELECT s_suppkey AS ref, s_name AS name, s_nationkey::BIGINT AS algorithm, greatest(cast(round(s_acctbal * 100) AS BIGINT), 0) AS reward, s_suppkey % 7 AS difficulty, s_suppkey % 4 <> 0 AS active FROM supplier)""",
}
