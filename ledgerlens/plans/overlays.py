"""More of the catalogue: what stands over the ledger (names, realms, listings, the mempool's tokens and orders), look-ups, and windows over time."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions import fixed
from ledgerlens.operators import chain, ledger, names, tokens
from ledgerlens.plans.catalog import POOL, TOKEN, query
from ledgerlens.sources import tables as T

# ---- look-ups


@query("tokens", f"SELECT * FROM tokens WHERE ref = {TOKEN}")
def token_get(spark, d):
    return T.tokens(spark, d).filter(F.col("ref") == TOKEN)


@query("txs outs", f"SELECT account, token, sum(amount)::BIGINT AS amount FROM outs WHERE NOT spent AND token = {TOKEN} AND account = (SELECT min(account) FROM outs WHERE NOT spent AND token = {TOKEN}) GROUP BY ALL")
def token_balance_point(spark, d):
    """What one account, the first that holds the token, has of it."""
    held = T.outputs(spark, d).filter(~F.col("spent") & (F.col("token") == TOKEN))
    one = held.agg(F.min("account").alias("account"))
    return held.join(F.broadcast(one), "account").groupBy("account", "token").agg(F.sum("amount").cast("long").alias("amount"))


@query("tokens", f"SELECT ref, name, sha256(name) AS hash FROM tokens WHERE sha256(name) = (SELECT sha256(name) FROM tokens WHERE ref = {TOKEN})")
def metadata_by_hash(spark, d):
    """All tokens whose metadata has a hash."""
    hashed = T.tokens(spark, d).select("ref", "name", F.sha2("name", 256).alias("hash"))
    return hashed.join(F.broadcast(hashed.filter(F.col("ref") == TOKEN).select("hash")), "hash", "left_semi").select("ref", "name", "hash")


@query("contracts", "SELECT * FROM contracts WHERE ref = 5")
def contract_get(spark, d):
    return T.contracts(spark, d).filter("ref = 5")


@query("txs", "SELECT at_height, tip >= at_height AS active, greatest(0, at_height - tip)::BIGINT AS blocks_remaining FROM (SELECT max(height) AS tip FROM txs), (VALUES (1000::BIGINT), (2403::BIGINT), (410000::BIGINT)) v(at_height)")
def activation_status(spark, d):
    """Whether rules that begin at a height are in force, and the blocks until then."""
    tip = T.txs(spark, d).agg(F.max("height").alias("tip"))
    asked = F.explode(F.array(*[F.lit(h).cast("long") for h in (1000, 2403, 410000)])).alias("at_height")
    left = F.greatest(F.lit(0).cast("long"), F.col("at_height") - F.col("tip"))
    return tip.select("tip", asked).select("at_height", (F.col("tip") >= F.col("at_height")).alias("active"), left.alias("blocks_remaining"))


PROTOCOLS = ["FT", "NFT", "DAT", "DMINT", "MUT", "BURN", "CONTAINER", "ENCRYPTED", "TIMELOCK", "AUTHORITY", "WAVE"]


@query("", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{p}')" for i, p in enumerate(PROTOCOLS, 1)) + ") v(id, name)")
def protocol_catalogue(spark, d):
    """The protocols by number."""
    numbered = {name: getattr(fixed, name) for name in PROTOCOLS}
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name")) for n, i in numbered.items()]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


@query("txs", "SELECT tx FROM (SELECT tx, row_number() OVER (ORDER BY tx) - 1 AS pos FROM txs WHERE height = 1000) WHERE pos = 2")
def tx_at_position(spark, d):
    """The transaction at a place in a block: of a block's rows in order, one."""
    return T.txs(spark, d).filter("height = 1000").select("tx").orderBy("tx").offset(2).limit(1)


@query("txs outs", "SELECT tx, any_value(height) AS height FROM outs WHERE NOT spent GROUP BY tx")
def height_of_unspent(spark, d):
    """The height of every transaction that has an unspent output left."""
    return T.outputs(spark, d).filter(~F.col("spent")).groupBy("tx").agg(F.first("height").alias("height"))


def _leaves(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("block").orderBy("tx")
    rows = T.txs(spark, d).select(F.col("height").alias("block"), "tx", C.double_sha256(F.col("tx").cast("string").cast("binary")).alias("hash"))
    return rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


@query()
def merkle_branches(spark, d):
    """The proof of every block's last transaction, from the leaf up."""
    leaves = _leaves(spark, d)
    found = chain.merkle_branch(leaves, leaves.groupBy("block").agg(F.max("pos").alias("pos")))
    return found.select("block", "pos", F.concat_ws(",", F.transform("branch", lambda h: F.lower(F.hex(h)))).alias("branch"))


@query()
def merkle_branches_short(spark, d):
    """The same with an asterisk for a partner that is the node itself."""
    leaves = _leaves(spark, d)
    found = chain.merkle_branch(leaves, leaves.groupBy("block").agg(F.max("pos").alias("pos")), star=True)
    return found.select("block", "pos", F.concat_ws(",", F.transform("branch", lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("*")))).alias("branch"))


# ---- names and realms

FIRST = "first AS (SELECT trim(lower(name)) AS name, arg_min(ref, height * 100000000 + ref) AS ref FROM tokens GROUP BY 1)"


@query("tokens", f", {FIRST} SELECT name, ref FROM first WHERE name > 'b' ORDER BY name LIMIT 20")
def names_page(spark, d):
    """A page of the names that hold, each once, from a cursor on."""
    return names.canonical(T.tokens(spark, d).filter(F.trim(F.lower("name")) > "b")).select("name", "ref").orderBy("name").limit(20)


@query("tokens", "SELECT count(DISTINCT trim(lower(name))) AS names, count(*) AS claims, count(*) - count(DISTINCT trim(lower(name))) AS duplicates FROM tokens")
def name_stats(spark, d):
    per = names.counts(T.tokens(spark, d))
    return per.agg(F.count(F.lit(1)).alias("names"), F.sum("claims").alias("claims"), (F.sum("claims") - F.count(F.lit(1))).alias("duplicates"))


@query("tokens", "SELECT count(DISTINCT trim(lower(name))) AS names FROM tokens WHERE starts_with(trim(lower(name)), 'b')")
def prefix_count(spark, d):
    return T.tokens(spark, d).select(F.trim(F.lower("name")).alias("name")).filter(F.col("name").startswith("b")).distinct().agg(F.count(F.lit(1)).alias("names"))


@query("tokens txs outs", f", {FIRST}, o AS (SELECT token, arg_max(account, height * 10000000 + account) AS owner, max(height) AS since FROM outs GROUP BY token) SELECT name, ref, owner, since FROM first LEFT JOIN o ON token = ref")
def name_owners(spark, d):
    """The present owner of every name that holds: the account of its token's last move."""
    moved = T.outputs(spark, d).groupBy(F.col("token").alias("ref")).agg(F.max(F.struct("height", "account")).alias("m"))
    return names.canonical(T.tokens(spark, d)).select("name", "ref").join(moved, "ref", "left").select("name", "ref", F.col("m.account").alias("owner"), F.col("m.height").alias("since"))


@query("tokens", f", {FIRST} SELECT t.ref, t.name, f.ref IS NOT NULL AS canonical FROM tokens t LEFT JOIN first f ON f.ref = t.ref")
def canonical_flags(spark, d):
    """Every claim, and whether it is the one that holds."""
    holds = names.canonical(T.tokens(spark, d)).select("ref", F.lit(True).alias("canonical"))
    return T.tokens(spark, d).join(holds, "ref", "left").select("ref", "name", F.coalesce("canonical", F.lit(False)).alias("canonical"))


@query("txs outs tokens", "SELECT ref, name, min(account) AS owner FROM tokens LEFT JOIN outs ON token = ref AND NOT spent GROUP BY ref, name")
def realm_owners(spark, d):
    """The first holder, by account, of every realm's token; null where nobody holds it."""
    first = T.outputs(spark, d).filter(~F.col("spent")).groupBy(F.col("token").alias("ref")).agg(F.min("account").alias("owner"))
    return T.tokens(spark, d).select("ref", "name").join(first, "ref", "left").select("ref", "name", "owner")


@query("txs outs", f", h AS (SELECT account, sum(amount)::BIGINT AS amount FROM outs WHERE NOT spent AND token = {TOKEN} GROUP BY account ORDER BY amount DESC, account LIMIT 50) SELECT account, amount, c_name AS identity FROM h LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = account")
def holders_with_identity(spark, d):
    """The largest holders of a token, and who they are where that is known: looked up for the page only."""
    top = tokens.holdings(T.outputs(spark, d).filter(F.col("token") == TOKEN)).orderBy(F.desc("amount"), "account").limit(50)
    known = T.table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("account"), F.col("c_name").alias("identity"))
    return top.join(known, "account", "left").select("account", "amount", "identity")


# ---- listings and orders


@query("txs outs points", "SELECT token, account AS seller, tx, vout, value AS price, height FROM points WHERE amount % 5 = 0 AND NOT spent ORDER BY height DESC, tx DESC, vout LIMIT 200")
def listings_active(spark, d):
    """Offered outputs that are not spent, newest first: spending one closes its listing."""
    points = T.outpoints(spark, d)
    spent = points.filter("spent").select("tx", "vout")
    open_ = ledger.unspent(points.filter("amount % 5 = 0"), spent)
    return open_.select("token", F.col("account").alias("seller"), "tx", "vout", F.col("value").alias("price"), "height").orderBy(F.desc("height"), F.desc("tx"), "vout").limit(200)


@query("txs outs points", "SELECT token, count(*) AS listed, count(*) FILTER (WHERE spent) AS closed, min(value) FILTER (WHERE NOT spent) AS floor_price FROM points WHERE amount % 5 = 0 GROUP BY token")
def listing_states(spark, d):
    """Of every token how many outputs were offered, how many of these are closed, and the least price that is open."""
    offered = T.outputs(spark, d).filter("amount % 5 = 0")
    return offered.groupBy("token").agg(F.count(F.lit(1)).alias("listed"), F.count(F.when(F.col("spent"), 1)).alias("closed"), F.min(F.when(~F.col("spent"), F.col("value"))).alias("floor_price"))


@query("txs book", "SELECT pair, count(*) AS orders FROM book GROUP BY pair")
def swap_counts(spark, d):
    return T.orders(spark, d).groupBy("pair").agg(F.count(F.lit(1)).alias("orders"))


@query("txs book", """SELECT "order", pair, side, price FROM book WHERE state = 'OPEN' AND NOT (expiry > 0 AND expiry <= (SELECT max(height) FROM txs)) ORDER BY height DESC, "order" DESC LIMIT 50""")
def swaps_open(spark, d):
    """Open orders that have not expired at the tip, newest first."""
    tip = T.txs(spark, d).agg(F.max("height").alias("tip"))
    live = T.orders(spark, d).filter("state = 'OPEN'").crossJoin(F.broadcast(tip)).filter(~((F.col("expiry") > 0) & (F.col("expiry") <= F.col("tip"))))
    return live.orderBy(F.desc("height"), F.desc("order")).limit(50).select("order", "pair", "side", "price")


@query("contracts", "SELECT * FROM contracts WHERE active AND ref > 10 ORDER BY ref LIMIT 30")
def dmint_page(spark, d):
    """A page of the contracts that can be minted, from a cursor on."""
    return T.contracts(spark, d).filter(F.col("active") & (F.col("ref") > 10)).orderBy("ref").limit(30)


# ---- the mempool


def _pool(spark, d):
    return T.outputs(spark, d).filter(F.col("height") >= POOL)


def _spent_in_pool(spark, d):
    return T.outputs(spark, d).filter((F.col("height") < POOL) & (F.col("spend_height") >= POOL))


@query("txs outs", f"SELECT token, account, sum(credit)::BIGINT AS credit, sum(debit)::BIGINT AS debit FROM (SELECT token, account, amount AS credit, 0 AS debit FROM outs WHERE height >= {POOL} UNION ALL SELECT token, account, 0, amount FROM outs WHERE height < {POOL} AND spend_height >= {POOL}) GROUP BY token, account")
def mempool_token_moves(spark, d):
    """What the mempool credits and debits of each token to each account."""
    zero = F.lit(0).cast("long")
    credit = _pool(spark, d).select("token", "account", F.col("amount").alias("credit"), zero.alias("debit"))
    debit = _spent_in_pool(spark, d).select("token", "account", zero.alias("credit"), F.col("amount").alias("debit"))
    return credit.unionByName(debit).groupBy("token", "account").agg(F.sum("credit").alias("credit"), F.sum("debit").alias("debit"))


@query("txs outs", f"SELECT token, count(DISTINCT tx) AS transactions FROM outs WHERE height >= {POOL} GROUP BY token")
def mempool_token_txs(spark, d):
    """How many transactions of the mempool move each token."""
    return _pool(spark, d).groupBy("token").agg(F.countDistinct("tx").alias("transactions"))


@query("txs outs points", f"SELECT account, tx, vout, value FROM points WHERE height >= {POOL}")
def mempool_outputs(spark, d):
    """The outputs that the mempool makes for every account."""
    return T.outpoints(spark, d).filter(F.col("height") >= POOL).select("account", "tx", "vout", "value")


@query("txs outs points", f"SELECT DISTINCT account, tx, vout FROM points WHERE spend_height >= {POOL}")
def potential_spends(spark, d):
    """The outputs of every account that transactions of the mempool spend."""
    return T.outpoints(spark, d).filter(F.col("spend_height") >= POOL).select("account", "tx", "vout").distinct()


@query("txs book", f"""SELECT pair, side, count(*) AS orders, min(price) AS lowest, max(price) AS highest FROM book WHERE height >= {POOL} GROUP BY pair, side""")
def mempool_orders_by_pair(spark, d):
    made = T.orders(spark, d).filter(F.col("height") >= POOL)
    return made.groupBy("pair", "side").agg(F.count(F.lit(1)).alias("orders"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


@query("txs book", f"""SELECT maker, "order", pair, side, price FROM book WHERE height >= {POOL} AND maker = (SELECT min(maker) FROM book WHERE height >= {POOL})""")
def mempool_orders_of_maker(spark, d):
    """The unconfirmed orders of one maker, the first that has any."""
    made = T.orders(spark, d).filter(F.col("height") >= POOL)
    one = made.agg(F.min("maker").alias("maker"))
    return made.join(F.broadcast(one), "maker", "left_semi").select("maker", "order", "pair", "side", "price")


# ---- over time


@query("trades", "SELECT token, s AS start, sum(amount)::BIGINT AS volume, count(*) AS trades FROM (SELECT token, amount, unnest([ts // 43200 * 43200 - 43200, ts // 43200 * 43200]) AS s FROM trades) GROUP BY token, s")
def sliding_volume(spark, d):
    """Volume of each token in windows of a day that begin every half day."""
    timed = T.trades(spark, d).withColumn("at", F.timestamp_seconds("ts"))
    found = timed.groupBy("token", F.window("at", "1 day", "12 hours").alias("w")).agg(F.sum("amount").cast("long").alias("volume"), F.count(F.lit(1)).alias("trades"))
    return found.select("token", F.unix_timestamp("w.start").alias("start"), "volume", "trades")


@query(
    "trades",
    """, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 86400 THEN 0 ELSE 1 END AS fresh FROM trades WINDOW w AS (PARTITION BY buyer ORDER BY ts, trade)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY buyer ORDER BY ts, trade) AS run FROM gaps) SELECT buyer, min(ts) AS start, count(*) AS trades, sum(amount)::BIGINT AS volume FROM runs GROUP BY buyer, run""",
)
def trade_sessions(spark, d):
    """Every buyer's sessions: trades less than a day apart."""
    # session_window would join trades that are just a day apart, and leave those without a time out
    w = Window.partitionBy("buyer").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("trade"))
    gaps = T.trades(spark, d).withColumn("fresh", F.when(F.col("ts") - F.lag("ts").over(w) < 86400, 0).otherwise(1))
    runs = gaps.withColumn("run", F.sum("fresh").over(w))
    found = runs.groupBy("buyer", "run").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("trades"), F.sum("amount").cast("long").alias("volume"))
    return found.drop("run")


@query("trades", "SELECT token, arg_max(price, ts * 100000000 + trade) AS revealed, max(ts) AS at FROM trades GROUP BY token")
def last_write(spark, d):
    """The last value that was written for each key."""
    last = F.struct("ts", "trade")
    return T.trades(spark, d).groupBy("token").agg(F.max_by("price", last).alias("revealed"), F.max("ts").alias("at"))


@query("txs outs", f", b AS (SELECT height, count(*) AS transactions FROM txs WHERE height < {POOL} GROUP BY height), s AS (SELECT spend_height AS height, count(*) AS spends FROM outs WHERE spend_height < {POOL} GROUP BY spend_height) SELECT height, transactions, spends FROM b JOIN s USING (height)")
def aligned_updates(spark, d):
    """Two streams, of blocks and of spends, joined at the heights that both have reached; run until nothing is left."""
    path = f"{chain.shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.col("height") * 86400).alias("at")
    T.txs(spark, d).filter(F.col("height") < POOL).groupBy("height").agg(F.count(F.lit(1)).alias("transactions")).select("height", at, "transactions").write.parquet(f"{path}/blocks")
    T.outputs(spark, d).filter(F.col("spend_height") < POOL).groupBy(F.col("spend_height").alias("height")).agg(F.count(F.lit(1)).alias("spends")).select("height", at, "spends").write.parquet(f"{path}/spends")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{path}/{name}").schema).parquet(f"{path}/{name}").withWatermark("at", "36500 days")
    both = read("blocks").join(read("spends"), ["height", "at"]).select("height", "transactions", "spends")
    run = both.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(both.schema).parquet(f"{path}/out")
