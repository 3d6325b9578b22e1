"""More of the catalogue: outpoints and their references, mempool order, token rules and states, and a stream run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions import fixed
from ledgerlens.operators import chain, ledger, market, tokens
from ledgerlens.operators.paging import clamp, page, with_total
from ledgerlens.plans.catalog import ACCOUNT, POOL, TOKEN, query
from ledgerlens.sources import tables as T
from ledgerlens.streaming import live


#: Outputs that a task of contract_lives is dealt.
ROWS_EACH = 250_000


@query(
    "txs outs points",
    f"""SELECT p.tx, p.vout, coalesce(m.token, c.token) AS ref FROM points p LEFT JOIN (SELECT tx, vout, token FROM points WHERE height >= {POOL}) m USING (tx, vout) LEFT JOIN (SELECT tx, vout, token FROM points WHERE height < {POOL}) c USING (tx, vout)""",
)
def refs_by_outpoint(spark, d):
    """What every outpoint refers to: of the mempool if it is there, else of the blocks."""
    points = T.outpoints(spark, d)
    pool, done = (points.filter(f).select("tx", "vout", F.col("token").alias(n)) for f, n in ((F.col("height") >= POOL, "m"), (F.col("height") < POOL, "c")))
    return points.select("tx", "vout").join(pool, ["tx", "vout"], "left").join(done, ["tx", "vout"], "left").select("tx", "vout", F.coalesce("m", "c").alias("ref"))


@query("txs", f"SELECT account, arg_min(tx, tx) AS first_tx, arg_max(tx, tx) AS last_tx FROM txs WHERE height >= {POOL} GROUP BY account")
def mempool_first_last(spark, d):
    pool = T.txs(spark, d).filter(F.col("height") >= POOL)
    return pool.groupBy("account").agg(F.min_by("tx", "tx").alias("first_tx"), F.max_by("tx", "tx").alias("last_tx"))


@query("txs", f"SELECT tx, tx - 1 - tx % 3 IN (SELECT tx FROM txs WHERE height >= {POOL}) AS unconfirmed_inputs FROM txs WHERE height >= {POOL}")
def has_unconfirmed_inputs(spark, d):
    pool = T.txs(spark, d).filter(F.col("height") >= POOL).select("tx")
    parents = pool.select(F.col("tx").alias("parent"), F.lit(True).alias("found"))
    return pool.withColumn("parent", F.col("tx") - 1 - F.col("tx") % 3).join(parents, "parent", "left").select("tx", F.coalesce("found", F.lit(False)).alias("unconfirmed_inputs"))


@query("txs outs", f"SELECT (SELECT count(*) FROM txs WHERE account = {ACCOUNT}) AS transactions, count(*) FILTER (WHERE NOT spent) AS unspent, coalesce(sum(value) FILTER (WHERE NOT spent), 0)::BIGINT AS balance FROM outs WHERE account = {ACCOUNT}")
def account_overview(spark, d):
    """An account's history, outputs and balance in one row."""
    out = T.outputs(spark, d).filter(F.col("account") == ACCOUNT)
    n = T.txs(spark, d).filter(F.col("account") == ACCOUNT).agg(F.count(F.lit(1)).alias("transactions"))
    held = out.agg(F.count(F.when(~F.col("spent"), 1)).alias("unspent"), F.coalesce(F.sum(F.when(~F.col("spent"), F.col("value"))), F.lit(0)).cast("long").alias("balance"))
    return n.crossJoin(held)


@query("tokens", "SELECT ref, name, type, (SELECT count(*) FROM tokens) AS total FROM tokens ORDER BY ref LIMIT 50 OFFSET 10")
def token_summaries(spark, d):
    return page(with_total(T.tokens(spark, d).select("ref", "name", "type")), [F.asc("ref")], clamp(50, 1, 500), 10)


#: Protocol lists of a test: number i is in the list if bit i of the token's number is set.
_LIST = "list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], lambda i: (p_partkey >> (i - 1)) & 1 = 1)"


def _protocols():
    return F.filter(F.array(*map(F.lit, range(1, 12))), lambda i: F.col("p_partkey").bitwiseAND(F.pow(F.lit(2.0), i - 1).cast("long")) != 0)


def _has(p: int) -> str:
    return f"list_contains(l, {p})"


@query(
    "",
    f"""SELECT p_partkey, CASE WHEN {_has(1)} AND {_has(4)} THEN 4 WHEN {_has(1)} THEN 1 WHEN {_has(2)} AND {_has(11)} THEN 5 WHEN {_has(2)} AND {_has(7)} THEN 6 WHEN {_has(2)} AND {_has(10)} THEN 7 WHEN {_has(2)} THEN 2 WHEN {_has(3)} THEN 3 ELSE 0 END AS type
    FROM (SELECT p_partkey, {_LIST} AS l FROM part)""",
)
def token_types(spark, d):
    return T.table(spark, d, "part").select("p_partkey", C.token_type(_protocols()).alias("type"))


@query(
    "",
    f"""SELECT p_partkey, CASE WHEN {_has(1)} AND {_has(2)} THEN 'FT and NFT are mutually exclusive' WHEN l = [6] THEN 'BURN alone is invalid - it is an action marker, not a token type' WHEN {_has(6)} AND NOT {_has(1)} AND NOT {_has(2)} THEN 'BURN must accompany FT or NFT'
    {" ".join(f"WHEN {_has(a)} AND NOT {_has(b)} THEN '{said}'" for a, b, said in C.NEEDS)} END AS error FROM (SELECT p_partkey, {_LIST} AS l FROM part)""",
)
def protocol_errors(spark, d):
    return T.table(spark, d, "part").select("p_partkey", C.protocol_error(_protocols()).alias("error"))


@query("", "SELECT p_partkey, regexp_matches(id, '^[a-z0-9][a-z0-9_-]*$') AND length(id) BETWEEN 2 AND 48 AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN lower(replace(p_name, ' ', '_')) ELSE '_' || p_brand END AS id FROM part)")
def realm_ids(spark, d):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    named = F.when(k == 0, name).when(k == 1, F.lower(F.replace(name, F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("_"), "p_brand"))
    return T.table(spark, d, "part").select("p_partkey", (named.rlike(fixed.REALM_ID) & F.length(named).between(2, 48)).alias("valid"))


@query("", "SELECT s_suppkey, (['BUY', 'SELL'])[(s_suppkey % 2 + 1)::INT] AS side, coalesce((['OPEN', 'PARTIAL', 'FILLED', 'CANCELLED', 'EXPIRED'])[(s_suppkey % 7 + 1)::INT], 'unknown') AS state FROM supplier")
def labels_of_numbers(spark, d):
    return T.table(spark, d, "supplier").select("s_suppkey", C.label(F.col("s_suppkey") % 2, fixed.SIDES).alias("side"), C.label(F.col("s_suppkey") % 7, fixed.ORDER_STATES).alias("state"))


@query(
    "txs outs",
    """, m AS (SELECT token, count(*) AS mints, sum(amount)::BIGINT AS mined FROM outs GROUP BY token)
    SELECT token, mints, mined, round_even(mined * 100.0::DOUBLE / (mined + token % 50), 4) AS percent, CASE WHEN token % 50 = 0 THEN 'mined out' WHEN mints > 25 THEN 'slow' ELSE 'open' END AS state FROM m""",
)
def mint_progress(spark, d):
    """What has been minted of each token against its most, and its state."""
    made = T.outputs(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("mints"), F.sum("amount").cast("long").alias("mined"))
    most = F.col("mined") + F.col("token") % 50
    percent = F.bround(F.col("mined") * F.lit(100.0) / most, 4)
    state = F.when(F.col("mined") >= most, "mined out").when(F.col("mints") > 25, "slow").otherwise("open")
    return made.select("token", "mints", "mined", percent.alias("percent"), state.alias("state"))


@query(
    "txs outs",
    """, g AS (SELECT token, count(DISTINCT tx) AS made, count(DISTINCT tx) FILTER (WHERE spent) AS gone, max(CASE WHEN spent THEN spend_height END) AS last FROM outs GROUP BY token)
    SELECT token, made - gone AS live, coalesce(CASE WHEN made = gone THEN last END, -1)::BIGINT AS burned_at FROM g""",
)
def contract_lives(spark, d):
    """How many of a token's contracts live, and the height at which the last one was destroyed."""
    # tasks hold the pairs of their transactions: more rows are more tasks, not larger ones
    each = T.outputs(spark, d, ROWS_EACH).groupBy("token", "tx").agg(F.max("spent").alias("spent"), F.max("spend_height").alias("last"))
    g = each.groupBy("token").agg(F.count("tx").alias("made"), F.count(F.when(F.col("spent"), 1)).alias("gone"), F.max("last").alias("last"))
    return g.select("token", (F.col("made") - F.col("gone")).alias("live"), F.coalesce(F.when(F.col("made") == F.col("gone"), F.col("last")), F.lit(-1)).alias("burned_at"))


@query("txs outs", f"SELECT account, sum(CASE WHEN spent THEN -amount ELSE amount END)::BIGINT AS delta FROM outs WHERE token = {TOKEN} AND height >= 1000 GROUP BY account")
def unconfirmed_token_balance(spark, d):
    pool = T.outputs(spark, d).filter((F.col("token") == TOKEN) & (F.col("height") >= 1000))
    return pool.groupBy("account").agg(F.sum(F.when(F.col("spent"), -F.col("amount")).otherwise(F.col("amount"))).cast("long").alias("delta"))


@query("txs outs", f"SELECT count(DISTINCT tx) AS transactions, count(DISTINCT account) AS accounts, count(DISTINCT token) AS tokens, count(*) FILTER (WHERE spent) AS spends FROM outs WHERE height >= {POOL}")
def mempool_stats(spark, d):
    pool = T.outputs(spark, d).filter(F.col("height") >= POOL)
    return pool.agg(F.countDistinct("tx").alias("transactions"), F.countDistinct("account").alias("accounts"), F.countDistinct("token").alias("tokens"), F.count(F.when(F.col("spent"), 1)).alias("spends"))


@query("tokens txs outs", "SELECT t.ref, t.name, count(DISTINCT o.account) AS holders FROM tokens t LEFT JOIN outs o ON o.token = t.ref AND NOT o.spent GROUP BY ALL")
def token_holder_counts(spark, d):
    held = tokens.holdings(T.outputs(spark, d)).groupBy(F.col("token").alias("ref")).agg(F.count(F.lit(1)).alias("holders"))
    return T.tokens(spark, d).join(held, "ref", "left").select("ref", "name", F.coalesce("holders", F.lit(0)).alias("holders"))


@query("txs outs", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY received DESC, height) AS rank FROM (SELECT account, height, sum(value)::BIGINT AS received FROM outs GROUP BY account, height)) WHERE rank <= 2")
def best_days(spark, d):
    from ledgerlens.operators.paging import first_per_group

    days = T.outputs(spark, d).groupBy("account", "height").agg(F.sum("value").cast("long").alias("received"))
    return first_per_group(days, ["account"], [F.desc("received"), F.asc("height")], 2).select("account", "height", "received", "rank")


@query("txs", f"SELECT account, tx, height, count(*) OVER (PARTITION BY account ORDER BY height, tx ROWS UNBOUNDED PRECEDING) AS seen FROM txs WHERE height < {POOL}")
def history_numbered(spark, d):
    """Every account's confirmed history, numbered."""
    own = T.txs(spark, d).filter(F.col("height") < POOL).select("account", "tx", "height")
    return market.running_count(own, "account", [F.asc("height"), F.asc("tx")])


@query(
    "trades",
    "SELECT token, ts // 86400 * 86400 AS start, arg_min(price, ts * 100000000 + trade) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts * 100000000 + trade) AS close, sum(amount)::BIGINT AS volume, count(*) AS trades FROM trades GROUP BY 1, 2",
)
def live_ohlcv_1d(spark, d):
    """Daily candles of a stream of trades, run until nothing is left; each trigger replaces the table of candles."""
    shared = chain.shared_dir(spark)
    run_id = uuid.uuid4().hex
    out, state = f"{shared}/candles-{run_id}", f"{shared}/candles-state-{run_id}"
    trades = T.trades(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("trade", "token", "price", "amount", "ts")
    source = f"{out}-in"
    trades.write.mode("overwrite").parquet(source)
    made = live.candles(spark.readStream.schema(trades.schema).parquet(source), "1 day", "36500 days")
    run = made.writeStream.outputMode("complete").option("checkpointLocation", state).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.unix_timestamp("start"))


@query("txs outs", "SELECT account, sum(value)::BIGINT AS balance FROM outs WHERE NOT spent AND account IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) GROUP BY account")
def balances_of_subscribed(spark, d):
    who = T.table(spark, d, "customer").filter("c_nationkey = 5").select(F.col("c_custkey").alias("account"))
    return ledger.balances(T.outputs(spark, d).join(who, "account", "left_semi"))
