"""The catalogue: named queries over the driver's tables, each beside the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions import fixed
from ledgerlens.operators import chain, ledger, market, names, tokens
from ledgerlens.operators.paging import keyset, page
from ledgerlens.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Parameters of the queries.
ACCOUNT, OWNER, TOKEN, ROLLBACK, POOL = 7, 80, 11, 1500, T.mempool_height()
#: Blocks of this ledger are days; its movement is shown by weeks.
WEEK = 7


def query(ctes: str = "", sql: str = ""):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(T.SQL[c] for c in ctes.split())} " if ctes else "") + sql
        return f

    return register


# ---- balances and outputs


@query("txs outs", "SELECT account, sum(value)::BIGINT AS balance FROM outs WHERE NOT spent GROUP BY account HAVING sum(value) > 0 ORDER BY balance DESC, account LIMIT 100 OFFSET 10")
def rich_list(spark, d):
    return ledger.rich_list(T.outputs(spark, d), 100, 10)


@query("txs outs", "SELECT count(*) AS accounts FROM (SELECT account FROM outs WHERE NOT spent GROUP BY account HAVING sum(value) > 0)")
def rich_list_total(spark, d):
    return ledger.balances(T.outputs(spark, d)).filter("balance > 0").agg(F.count(F.lit(1)).alias("accounts"))


@query("txs outs", f"SELECT account, sum(value)::BIGINT AS balance FROM outs WHERE NOT spent AND account = {ACCOUNT} GROUP BY account")
def balance_point(spark, d):
    return ledger.balances(T.outputs(spark, d).filter(F.col("account") == ACCOUNT))


@query(
    "txs outs",
    f"""SELECT account, coalesce(a.v, 0)::BIGINT AS confirmed, coalesce(b.v, 0)::BIGINT AS unconfirmed FROM
    (SELECT account, sum(value) AS v FROM outs WHERE height < {POOL} AND (spend_height IS NULL OR spend_height >= {POOL}) GROUP BY account) a FULL JOIN
    (SELECT account, sum(delta) AS v FROM (SELECT account, height, value AS delta FROM outs UNION ALL SELECT account, spend_height, -value FROM outs WHERE spent) WHERE height >= {POOL} GROUP BY account) b USING (account)""",
)
def balance_merged(spark, d):
    return ledger.merged_balances(T.outputs(spark, d), POOL)


@query("txs outs points", "SELECT account, tx, vout, value FROM points WHERE NOT spent")
def utxo_list(spark, d):
    """The unspent outputs of every account."""
    points = T.outpoints(spark, d)
    return ledger.unspent(points, points.filter("spent").select("tx", "vout")).select("account", "tx", "vout", "value")


@query("txs outs points", "SELECT tx, vout, account, value FROM points WHERE spent")
def spend_resolution(spark, d):
    points = T.outpoints(spark, d)
    found, _ = ledger.resolve_spends(points.filter("spent").select("tx", "vout"), points)
    return found.select("tx", "vout", "account", "value")


def _labels(bounds) -> str:
    return ", ".join(f"({i}, '{name}')" for i, (_, name) in enumerate(bounds))


def _case(value: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {low} THEN '{name}'" for low, name in reversed(bounds)) + f" ELSE '{bounds[0][1]}' END"


@query(
    "txs outs",
    f"""SELECT l.place::BIGINT AS place, l.bucket, coalesce(h.accounts, 0)::BIGINT AS accounts, coalesce(h.amount, 0)::BIGINT AS amount FROM (VALUES {_labels(fixed.BALANCE_BUCKETS)}) l(place, bucket) LEFT JOIN
    (SELECT {_case("balance / 100.0::DOUBLE", fixed.BALANCE_BUCKETS)} AS bucket, count(*) AS accounts, sum(balance) AS amount FROM (SELECT sum(value)::BIGINT AS balance FROM outs WHERE NOT spent GROUP BY account) GROUP BY 1) h USING (bucket)""",
)
def balance_distribution(spark, d):
    return ledger.balance_distribution(T.outputs(spark, d), 100)


@query(
    "txs outs",
    f"""SELECT l.place::BIGINT AS place, l.bucket, coalesce(h.amount, 0)::BIGINT AS amount FROM (VALUES {_labels(fixed.AGE_BUCKETS)}) l(place, bucket) LEFT JOIN
    (SELECT {_case(f"({POOL} - height)", fixed.AGE_BUCKETS)} AS bucket, sum(value) AS amount FROM outs WHERE NOT spent GROUP BY 1) h USING (bucket)""",
)
def supply_aging(spark, d):
    return ledger.supply_aging(T.outputs(spark, d), POOL)


ENTRIES = "SELECT account, height, value AS delta FROM outs UNION ALL SELECT account, spend_height, -value FROM outs WHERE spent"
BLOCK_BALANCES = f"SELECT account, height, delta, sum(delta) OVER (PARTITION BY account ORDER BY height ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM (SELECT account, height, sum(delta)::BIGINT AS delta FROM ({ENTRIES}) GROUP BY ALL)"


@query(
    "txs outs",
    f"""SELECT days.dy, coalesce(r.moved, 0)::BIGINT AS moved, coalesce(r.active, 0)::BIGINT AS active, coalesce(f.fresh, 0)::BIGINT AS fresh
    FROM (SELECT unnest(generate_series((SELECT min(height // {WEEK}) FROM outs), (SELECT max(height // {WEEK}) FROM outs))) AS dy) days
    LEFT JOIN (SELECT height // {WEEK} AS dy, sum(v) AS moved, count(*) AS active FROM (SELECT height, account, sum(value) AS v FROM outs GROUP BY ALL) GROUP BY 1) r ON r.dy = days.dy
    LEFT JOIN (SELECT height // {WEEK} AS dy, count(*) AS fresh FROM ({BLOCK_BALANCES}) WHERE balance - delta <= 0 AND balance > 0 GROUP BY 1) f ON f.dy = days.dy""",
)
def daily_movement(spark, d):
    return ledger.daily_movement(T.outputs(spark, d), WEEK)


@query("txs outs", f"SELECT account, height, balance, balance - delta AS before FROM ({BLOCK_BALANCES})")
def running_balances(spark, d):
    return ledger.block_balances(T.outputs(spark, d)).select("account", "height", "balance", "before")


@query(
    "txs",
    """, moves AS (SELECT account, tx, CASE WHEN tx % 2 = 0 THEN cents ELSE -cents END AS delta FROM txs), s AS (SELECT *, sum(delta) OVER (PARTITION BY account ORDER BY tx ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM moves)
    SELECT account, tx, running - least(0, min(running) OVER (PARTITION BY account ORDER BY tx ROWS UNBOUNDED PRECEDING)) AS clamped FROM s""",
)
def clamped_balances(spark, d):
    moves = T.txs(spark, d).select("account", "tx", F.when(F.col("tx") % 2 == 0, F.col("cents")).otherwise(-F.col("cents")).alias("delta"))
    return ledger.clamped_balances(moves, ["account"], [F.asc("tx")]).select("account", "tx", "clamped")


@query("txs outs", f"SELECT account, sum(value)::BIGINT AS balance FROM outs WHERE height <= {ROLLBACK} AND (spend_height IS NULL OR spend_height > {ROLLBACK}) GROUP BY account")
def rollback_balances(spark, d):
    return ledger.balances(T.outputs(spark, d), ROLLBACK)


@query("txs outs", "SELECT tx, greatest(0, sum(CASE WHEN spent THEN value ELSE -value END))::BIGINT AS fee FROM outs GROUP BY tx")
def fees(spark, d):
    return ledger.fees(T.outputs(spark, d))


@query("txs outs", f"SELECT account, count(*) AS outputs, count(DISTINCT tx) AS transactions, sum(CASE WHEN spent THEN 0 ELSE value END)::BIGINT AS delta, bool_or(spent) AS spends FROM outs WHERE height >= {POOL} GROUP BY account")
def combined_mempool_state(spark, d):
    return ledger.mempool_state(T.outputs(spark, d), POOL)


# ---- history and blocks


@query("txs", f"SELECT tx, height FROM txs WHERE account = {ACCOUNT} ORDER BY height, tx LIMIT 20")
def address_history(spark, d):
    return T.txs(spark, d).filter(F.col("account") == ACCOUNT).orderBy("height", "tx").limit(20).select("tx", "height")


@query(
    "txs outs",
    f"""SELECT t.tx, t.height, CASE WHEN t.tx % 10 = 0 THEN 'mined' WHEN bool_or(o.value IS NOT NULL AND NOT o.spent) THEN 'received' ELSE 'sent' END AS direction, coalesce(sum(o.value), 0)::BIGINT AS amount, (SELECT count(*) FROM txs WHERE account = {ACCOUNT}) AS total
    FROM txs t LEFT JOIN outs o ON o.tx = t.tx WHERE t.account = {ACCOUNT} GROUP BY t.tx, t.height ORDER BY t.height DESC, t.tx DESC LIMIT 10 OFFSET 2""",
)
def address_history_page(spark, d):
    own = T.txs(spark, d).filter(F.col("account") == ACCOUNT)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    shown = page(own.select("tx", "height"), [F.desc("height"), F.desc("tx")], 10, 2)
    paid = T.outputs(spark, d).select("tx", "value", "spent")
    rows = shown.join(paid, "tx", "left").groupBy("tx", "height").agg(F.max(F.col("value").isNotNull() & ~F.col("spent")).alias("got"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("amount"))
    direction = F.when(F.col("tx") % 10 == 0, "mined").when(F.col("got"), "received").otherwise("sent")
    return rows.select("tx", "height", direction.alias("direction"), "amount").crossJoin(F.broadcast(total))


@query("txs", "SELECT account, sha256(string_agg(tx || ':' || height || ':', '' ORDER BY height, tx)) AS status FROM txs GROUP BY account")
def address_status(spark, d):
    return ledger.address_status(T.txs(spark, d))


@query("txs", f"SELECT account, tx, CASE WHEN height < {POOL} THEN height ELSE 0 END AS height, CASE WHEN height < {POOL} THEN 0 ELSE 1 END::INT AS source FROM txs")
def history_with_mempool(spark, d):
    return ledger.history(T.txs(spark, d), POOL)


@query("txs", f"SELECT tx FROM txs WHERE height >= {POOL} AND tx % 3 <> 0 EXCEPT ALL SELECT tx FROM txs WHERE height >= {POOL} AND tx % 2 = 0")
def mempool_evicted(spark, d):
    pool = T.txs(spark, d).filter(F.col("height") >= POOL).select("tx")
    return pool.filter("tx % 3 <> 0").exceptAll(pool.filter("tx % 2 = 0"))


@query("txs", f"SELECT tx FROM txs WHERE height >= {POOL} AND tx % 2 = 0 EXCEPT ALL SELECT tx FROM txs WHERE height >= {POOL} AND tx % 3 <> 0")
def mempool_arrived(spark, d):
    pool = T.txs(spark, d).filter(F.col("height") >= POOL).select("tx")
    return pool.filter("tx % 2 = 0").exceptAll(pool.filter("tx % 3 <> 0"))


@query("txs", f"SELECT account FROM txs WHERE height >= {POOL} INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def touched_subscribed(spark, d):
    subscribed = T.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("account"))
    return T.txs(spark, d).filter(F.col("height") >= POOL).select("account").intersect(subscribed)


@query("txs outs", "SELECT DISTINCT tx, token FROM outs o WHERE spent AND NOT EXISTS (SELECT 1 FROM outs n WHERE NOT n.spent AND n.tx = o.tx AND n.token = o.token)")
def destroyed_refs(spark, d):
    out = T.outputs(spark, d)
    return out.filter("spent").select("tx", "token").distinct().join(out.filter("not spent").select("tx", "token"), ["tx", "token"], "left_anti")


@query("txs", "SELECT height, count(*) AS n_tx, sum(count(*)) OVER (ORDER BY height ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM txs GROUP BY height")
def cum_tx_per_block(spark, d):
    return chain.blocks(T.txs(spark, d))


@query("txs", "SELECT n.number, b.height FROM (SELECT unnest(range((SELECT count(*) FROM txs))) AS number) n ASOF JOIN (SELECT height, sum(count(*)) OVER (ORDER BY height ROWS UNBOUNDED PRECEDING)::BIGINT - count(*) AS first FROM txs GROUP BY height) b ON n.number >= b.first")
def tx_num_to_height(spark, d):
    """The height of every transaction's number."""
    t = T.txs(spark, d)
    return chain.height_of(spark.range(t.count()).select(F.col("id").alias("number")), chain.blocks(t))


@query("txs", "SELECT height, count(*) AS n_tx FROM txs WHERE height > greatest(0, (SELECT max(height) FROM txs) - 25) GROUP BY height ORDER BY height DESC")
def recent_blocks(spark, d):
    t = T.txs(spark, d)
    tip = t.agg(F.max("height").alias("tip"))
    return t.crossJoin(F.broadcast(tip)).filter(F.col("height") > F.greatest(F.lit(0), F.col("tip") - 25)).groupBy("height").agg(F.count(F.lit(1)).alias("n_tx")).orderBy(F.desc("height"))


@query("txs", "SELECT tx, row_number() OVER (ORDER BY tx) - 1 AS pos FROM txs WHERE height = 1000")
def block_transactions(spark, d):
    w = Window.partitionBy("height").orderBy("tx")
    return T.txs(spark, d).filter("height = 1000").select("tx", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("txs", "SELECT height, count(*) AS n_tx FROM txs WHERE height BETWEEN 100 AND 199 GROUP BY height")
def header_range(spark, d):
    return T.txs(spark, d).filter("height between 100 and 199").groupBy("height").agg(F.count(F.lit(1)).alias("n_tx"))


HASHED = "SELECT height, md5(height || ':' || count(*)) AS hash FROM txs GROUP BY height"


def _hashed(spark, d):
    return T.txs(spark, d).groupBy("height").agg(F.md5(F.concat_ws(":", F.col("height").cast("string"), F.count(F.lit(1)).cast("string"))).alias("hash"))


@query("txs", f"SELECT min(height) AS height FROM ({HASHED}) WHERE height > 2000 AND height % 5 = 0")
def reorg_point(spark, d):
    mine = _hashed(spark, d)
    other = mine.withColumn("hash", F.when((F.col("height") > 2000) & (F.col("height") % 5 == 0), F.reverse("hash")).otherwise(F.col("hash")))
    return chain.reorg_point(mine, other)


@query("txs", f", h AS ({HASHED}) SELECT a.height, a.hash, reverse(b.hash) AS prev_hash, b.hash AS expected FROM h a JOIN h b ON a.height = b.height + 1 WHERE a.height % 100 = 0")
def chain_breaks(spark, d):
    mine = _hashed(spark, d)
    before = mine.select((F.col("height") + 1).alias("height"), F.col("hash").alias("p"))
    linked = mine.join(before, "height", "left").select("height", "hash", F.when(F.col("height") % 100 == 0, F.reverse("p")).otherwise(F.col("p")).alias("prev_hash"))
    return chain.breaks(linked)


@query()
def merkle_root_per_block(spark, d):
    w = Window.partitionBy("block").orderBy("tx")
    leaves = T.txs(spark, d).select(F.col("height").alias("block"), "tx", C.double_sha256(F.col("tx").cast("string").cast("binary")).alias("hash")).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    return chain.merkle_roots(leaves).select("block", F.lower(F.hex("root")).alias("root"))


@query(
    "",
    f"""WITH RECURSIVE {T.SQL["txs"]}, pool AS (SELECT tx, tx - 1 - tx % 3 AS parent FROM txs WHERE height >= {POOL}),
    r AS (SELECT tx, 0 AS depth FROM pool WHERE parent NOT IN (SELECT tx FROM pool) UNION ALL SELECT p.tx, r.depth + 1 FROM pool p JOIN r ON p.parent = r.tx) SELECT tx, depth::BIGINT AS depth FROM r""",
)
def unconfirmed_chain(spark, d):
    """Transactions of the mempool by their distance from a confirmed parent."""
    return chain.depths(T.txs(spark, d).filter(F.col("height") >= POOL).select("tx", (F.col("tx") - 1 - F.col("tx") % 3).alias("parent")))


# ---- tokens


@query("tokens", "SELECT * FROM tokens WHERE type = (SELECT min(p_type) FROM part) ORDER BY ref LIMIT 100")
def token_by_type(spark, d):
    kind = T.tokens(spark, d).agg(F.min("type")).first()[0]
    return tokens.by_type(T.tokens(spark, d), kind)


@query("tokens", "SELECT * FROM tokens ORDER BY height DESC, ref LIMIT 100")
def token_recent(spark, d):
    return tokens.recent(T.tokens(spark, d))


def _with_protocols(spark, d):
    return T.tokens(spark, d).withColumn("protocols", F.split("name", " "))


@query("tokens", "SELECT * FROM tokens WHERE list_contains(string_split(name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part)) ORDER BY height DESC, ref LIMIT 100")
def token_by_protocol(spark, d):
    one = _with_protocols(spark, d).agg(F.min(F.col("protocols")[0])).first()[0]
    return tokens.by_protocol(_with_protocols(spark, d), one)


@query("tokens", "SELECT * FROM tokens WHERE lower(name) = lower((SELECT max(p_name) FROM part)) ORDER BY ref LIMIT 50")
def token_search(spark, d):
    name = T.tokens(spark, d).agg(F.max("name")).first()[0]
    return tokens.search(_with_protocols(spark, d), name.upper(), name.split(" "))


@query("tokens", "SELECT type, ticker, count(*) AS n, min(height) AS first_height FROM tokens GROUP BY GROUPING SETS ((), (type), (ticker))")
def token_stats(spark, d):
    return tokens.stats(T.tokens(spark, d))


@query("tokens", "SELECT type, ticker, count(*) AS n FROM tokens GROUP BY CUBE (type, ticker)")
def token_cube(spark, d):
    return T.tokens(spark, d).cube("type", "ticker").agg(F.count(F.lit(1)).alias("n"))


@query("tokens", "SELECT type, ticker, count(*) AS n FROM tokens GROUP BY ROLLUP (type, ticker)")
def token_rollup(spark, d):
    return T.tokens(spark, d).rollup("type", "ticker").agg(F.count(F.lit(1)).alias("n"))


HOLD = "SELECT token, account, sum(amount)::BIGINT AS amount FROM outs WHERE NOT spent GROUP BY ALL HAVING sum(amount) > 0"


@query("txs outs", f"SELECT account, amount FROM ({HOLD}) WHERE token = {TOKEN} AND account >= 100 ORDER BY account LIMIT 100")
def token_holders(spark, d):
    return tokens.holders_page(T.outputs(spark, d), TOKEN, 100)


@query(
    "txs outs",
    f", h AS ({HOLD}) SELECT token, rank, account, amount, round(amount / supply::DOUBLE * 100, 4) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY amount DESC, account) AS rank, sum(amount) OVER (PARTITION BY token) AS supply FROM h) WHERE rank <= 3",
)
def top_holders_per_token(spark, d):
    return tokens.top_holders(T.outputs(spark, d), 3)


@query(
    "txs outs",
    """, h AS (SELECT token, account, sum(amount) AS made, sum(CASE WHEN spent THEN 0 ELSE amount END) AS held, count(*) FILTER (WHERE spent) AS gone FROM outs GROUP BY ALL)
    SELECT token, sum(held)::BIGINT AS circulating, count(*) FILTER (WHERE held > 0) AS holders, sum(made)::BIGINT AS minted, sum(gone)::BIGINT AS burns, (CASE WHEN sum(held) = 0 AND sum(made) > 0 THEN sum(made) ELSE sum(held) END)::BIGINT AS supply FROM h GROUP BY token""",
)
def token_supply(spark, d):
    return tokens.supply(T.outputs(spark, d))


EVENTS = "SELECT token, height, tx, 1 AS event, amount FROM outs UNION ALL SELECT token, spend_height, tx, 3, amount FROM outs WHERE spent"


@query("txs outs", f", e AS (SELECT * FROM ({EVENTS}) WHERE token = {TOKEN}) SELECT *, (SELECT count(*) FROM e) AS total FROM e ORDER BY height, tx, event, amount LIMIT 20 OFFSET 5")
def token_events_page(spark, d):
    return tokens.events_page(T.outputs(spark, d), TOKEN, None, 20, 5)


@query("txs outs", f", e AS (SELECT * FROM ({EVENTS}) WHERE token = {TOKEN} AND event = 3) SELECT *, (SELECT count(*) FROM e) AS total FROM e ORDER BY height, tx, event, amount LIMIT 50")
def token_burns(spark, d):
    return tokens.events_page(T.outputs(spark, d), TOKEN, 3, 50)


@query("txs outs tokens", f"SELECT ref, name, ticker, amount FROM ({HOLD}) JOIN tokens ON token = ref WHERE account = {ACCOUNT}")
def account_tokens(spark, d):
    return tokens.account_tokens(T.outputs(spark, d), T.tokens(spark, d), ACCOUNT)


@query("txs outs", ", m AS (SELECT token, arg_min(tx, height * 10000000 + tx) AS tx FROM outs GROUP BY token) SELECT m.tx, token, first_token, companions FROM m JOIN (SELECT tx, min(token) AS first_token, count(*) - 1 AS companions FROM m GROUP BY tx HAVING count(*) > 1) USING (tx)")
def sibling_singletons(spark, d):
    return tokens.companions(T.outputs(spark, d))


@query("txs outs", "SELECT token, arg_min(tx, height * 10000000 + tx) AS first_tx, arg_max(tx, height * 10000000 + tx) AS last_tx FROM outs GROUP BY token")
def singleton_first_last(spark, d):
    order = F.struct("height", "tx")
    return T.outputs(spark, d).groupBy("token").agg(F.min_by("tx", order).alias("first_tx"), F.max_by("tx", order).alias("last_tx"))


@query("", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def metadata_extract(spark, d):
    return T.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---- market


def _candles(name: str, seconds: int) -> None:
    def run(spark, d):
        return market.candles(T.trades(spark, d), seconds)

    run.__name__ = f"ohlcv_{name}"
    query(
        "trades",
        f"""SELECT token, ts // {seconds} * {seconds} AS start, arg_min(price, ts * 100000000 + trade) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts * 100000000 + trade) AS close, sum(amount)::BIGINT AS volume, count(*) AS trades FROM trades GROUP BY 1, 2""",
    )(run)


for _name, _seconds in fixed.INTERVALS.items():
    _candles(_name, _seconds)

LAST = "(SELECT max(ts) FROM trades)"


def _last(spark, d) -> int:
    return T.trades(spark, d).agg(F.max("ts")).first()[0] or 0


@query("trades", f"SELECT token, sum(amount)::BIGINT AS volume, count(*) AS trades FROM trades WHERE ts BETWEEN {LAST} - 86400 AND {LAST} GROUP BY token")
def volume_24h(spark, d):
    return market.volumes(T.trades(spark, d), _last(spark, d))


@query("trades", "SELECT token, arg_max(price, ts * 100000000 + trade) AS price, max(ts) AS ts FROM trades GROUP BY token")
def latest_price(spark, d):
    return market.latest_prices(T.trades(spark, d))


@query("trades", "SELECT token, ts // 86400 AS dy, sum(amount)::BIGINT AS volume FROM trades GROUP BY 1, 2")
def volume_daily(spark, d):
    return market.daily_volumes(T.trades(spark, d))


@query(
    "trades",
    f""", m AS (SELECT token, arg_max(price, ts * 100000000 + trade) AS price, arg_max(price, ts * 100000000 + trade) FILTER (WHERE ts BETWEEN {LAST} - 90000 AND {LAST} - 86400) AS price_24h_ago, coalesce(sum(amount) FILTER (WHERE ts BETWEEN {LAST} - 86400 AND {LAST}), 0)::BIGINT AS volume, count(*) FILTER (WHERE ts BETWEEN {LAST} - 86400 AND {LAST}) AS trades FROM trades GROUP BY token)
    SELECT *, price - price_24h_ago AS change_24h, round_even(((price - price_24h_ago) * 100)::DOUBLE / price_24h_ago, 2) AS change_24h_pct FROM m""",
)
def market_summary(spark, d):
    return market.summary(T.trades(spark, d), _last(spark, d))


@query("trades", f"SELECT * FROM trades WHERE token = (SELECT min(token) FROM trades) AND ts BETWEEN {LAST} - 864000 AND {LAST} - 86400 ORDER BY ts DESC, trade DESC LIMIT 50")
def trades_between(spark, d):
    t, last = T.trades(spark, d), _last(spark, d)
    return market.trades_between(t, t.agg(F.min("token")).first()[0], last - 864_000, last - 86_400)


@query("trades", "SELECT * FROM (SELECT token, ts // 86400 * 86400 AS start, arg_min(price, ts * 100000000 + trade) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts * 100000000 + trade) AS close, sum(amount)::BIGINT AS volume, count(*) AS trades FROM trades WHERE token = (SELECT min(token) FROM trades) GROUP BY 1, 2 ORDER BY start DESC LIMIT 10) ORDER BY start")
def ohlcv_page(spark, d):
    t = T.trades(spark, d)
    return market.last_candles(t, t.agg(F.min("token")).first()[0], 86_400, 10)


TIP = 2300
LIVE = f"""state IN ('OPEN', 'PARTIAL') AND NOT (expiry > 0 AND expiry <= {TIP})"""


@query("txs book", f"""SELECT pair, side, rank, "order", price FROM (SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY CASE WHEN side = 'SELL' THEN price ELSE -price END, "order") AS rank FROM book WHERE {LIVE}) WHERE rank <= 50""")
def orderbook(spark, d):
    return market.order_book(T.orders(spark, d), TIP)


@query("txs book", f"""SELECT * FROM book WHERE {LIVE} ORDER BY pair, side, price, "order" LIMIT 100 OFFSET 20""")
def orders_open_page(spark, d):
    return market.open_orders(T.orders(spark, d), TIP, 100, 20)


@query("txs book", f"""SELECT * FROM book WHERE maker = {ACCOUNT} AND state = 'FILLED' ORDER BY "order" LIMIT 100""")
def orders_user(spark, d):
    return market.maker_orders(T.orders(spark, d), ACCOUNT, "FILLED")


@query("txs book", """SELECT * FROM book WHERE state = 'FILLED' ORDER BY height DESC, "order" DESC LIMIT 100""")
def swap_history(spark, d):
    return market.filled(T.orders(spark, d))


@query("txs book", f"""SELECT * REPLACE (CASE WHEN state IN ('OPEN', 'PARTIAL') AND expiry > 0 AND expiry <= {TIP} THEN 'EXPIRED' ELSE state END AS state) FROM book""")
def orders_shown(spark, d):
    return market.shown(T.orders(spark, d), TIP)


@query("txs book", """SELECT * FROM book WHERE "order" = 42""")
def order_point(spark, d):
    return T.orders(spark, d).filter(F.col("order") == 42)


@query(
    "txs outs book",
    """, s AS (SELECT tx, min(spend_height) AS closed FROM outs WHERE spent GROUP BY tx) SELECT b."order", b.height, coalesce(s.closed, -1)::BIGINT AS closed, CASE WHEN s.closed IS NULL THEN 'OPEN' ELSE 'FILLED' END AS state FROM book b LEFT JOIN s ON s.tx = b."order" AND s.closed >= b.height""",
)
def order_lifecycle(spark, d):
    spends = T.outputs(spark, d).filter("spent").select(F.col("tx").alias("order"), "spend_height")
    return market.lifecycle(T.orders(spark, d), spends).withColumn("closed", F.coalesce("closed", F.lit(-1)))


@query(
    "txs book",
    f"""SELECT pair, arg_max(price, height * 10000000 + "order") FILTER (WHERE state = 'FILLED') AS last, max(price) FILTER (WHERE state = 'FILLED' AND height > {TIP - 144}) AS high, min(price) FILTER (WHERE state = 'FILLED' AND height > {TIP - 144}) AS low,
    coalesce(sum(price) FILTER (WHERE state = 'FILLED' AND height > {TIP - 144}), 0)::BIGINT AS volume, count(*) FILTER (WHERE {LIVE} AND side = 'BUY') AS bids, count(*) FILTER (WHERE {LIVE} AND side = 'SELL') AS asks FROM book GROUP BY pair""",
)
def pair_stats(spark, d):
    return market.pair_stats(T.orders(spark, d), TIP, fixed.BLOCKS_PER_DAY)


@query("contracts", ", c AS (SELECT * FROM contracts WHERE active) SELECT *, (SELECT count(*) FROM c) AS total FROM c ORDER BY reward DESC, ref LIMIT 20 OFFSET 3")
def contracts_v2(spark, d):
    return market.contracts_page(T.contracts(spark, d), True, None, "reward", True, 20, 3)


@query("contracts", "SELECT ref, reward, difficulty, reward::DOUBLE / coalesce(nullif(difficulty, 0), 1) AS profit FROM contracts WHERE active ORDER BY profit DESC, ref LIMIT 10")
def contracts_profitable(spark, d):
    return market.most_profitable(T.contracts(spark, d))


@query("contracts", ", c AS (SELECT * FROM contracts WHERE active AND algorithm = 3) SELECT *, (SELECT count(*) FROM c) AS total FROM c ORDER BY name, ref LIMIT 100")
def contracts_by_algorithm(spark, d):
    return market.contracts_page(T.contracts(spark, d), True, 3, "name", False)


@query("contracts", "SELECT coalesce(contracts.algorithm::VARCHAR, 'all') AS algorithm, coalesce(contracts.active::VARCHAR, 'all') AS active, count(*) AS n, sum(reward)::BIGINT AS reward FROM contracts GROUP BY GROUPING SETS ((), (contracts.algorithm), (contracts.active))")
def contracts_stats(spark, d):
    made = market.contract_stats(T.contracts(spark, d))
    return made.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("algorithm", "active")})


@query(
    "tokens",
    """SELECT ref, CASE WHEN a.old IS NULL THEN 'INSERT' WHEN b.new IS NULL THEN 'DELETE' WHEN a.old <> b.new THEN 'UPDATE' ELSE 'KEEP' END AS step FROM (SELECT ref, height AS old FROM tokens WHERE ref % 5 <> 0) a FULL JOIN (SELECT ref, CASE WHEN ref % 3 = 0 THEN height + 1 ELSE height END AS new FROM tokens WHERE ref % 7 <> 0) b USING (ref)""",
)
def contracts_reconcile(spark, d):
    t = T.tokens(spark, d)
    indexed = t.filter("ref % 7 <> 0").withColumn("height", F.when(F.col("ref") % 3 == 0, F.col("height") + 1).otherwise(F.col("height")))
    return market.reconcile(t.filter("ref % 5 <> 0"), indexed, "ref", "height")


@query("contracts", "SELECT * FROM contracts WHERE ref NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def contracts_allowed(spark, d):
    denied = T.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("ref"))
    return market.without_denied(T.contracts(spark, d), denied)


# ---- names


CLAIMS = "SELECT trim(lower(name)) AS name, height, ref, row_number() OVER (PARTITION BY trim(lower(name)) ORDER BY height, ref) AS claim FROM tokens"


@query("tokens", f"SELECT name, height, ref FROM ({CLAIMS}) WHERE claim = 1")
def names_canonical(spark, d):
    return names.canonical(T.tokens(spark, d))


@query("tokens", f"SELECT * FROM ({CLAIMS}) WHERE claim > 1")
def names_duplicates(spark, d):
    return names.duplicates(T.tokens(spark, d))


@query("tokens", "SELECT trim(lower(name)) AS name, count(*) AS claims, count(*) > 1 AS has_duplicates FROM tokens GROUP BY 1")
def name_has_duplicates(spark, d):
    return names.counts(T.tokens(spark, d))


@query("tokens", "SELECT DISTINCT trim(lower(s_name)) AS name FROM supplier WHERE trim(lower(s_name)) NOT IN (SELECT trim(lower(name)) FROM tokens)")
def names_available(spark, d):
    return names.available(T.table(spark, d, "supplier").select(F.col("s_name").alias("name")), T.tokens(spark, d))


SLOT = "strpos('abcdefghijklmnopqrstuvwxyz0123456789-', substr(name, i::INT, 1)) - 1"
EDGES = f"SELECT name, i - 1 AS depth, substr(name, 1, (i - 1)::INT) AS prefix, substr(name, i::INT, 1) AS character, ({SLOT})::BIGINT AS slot FROM (SELECT name, unnest(generate_series(1, length(name))) AS i FROM (SELECT DISTINCT trim(lower(name)) AS name FROM tokens))"


@query("tokens", EDGES)
def name_edges(spark, d):
    return names.edges(T.tokens(spark, d))


@query("tokens", f"SELECT slot, character, count(*) AS names FROM ({EDGES}) WHERE prefix = 'b' AND slot >= 0 GROUP BY ALL ORDER BY slot")
def name_children(spark, d):
    return names.children(T.tokens(spark, d), "b")


@query(
    "txs outs tokens",
    f""", o AS (SELECT token, arg_max(account, height * 10000000 + account) AS owner FROM outs GROUP BY token) SELECT name, height, ref FROM tokens WHERE ref IN (SELECT token FROM o WHERE owner = {OWNER})""",
)
def name_reverse(spark, d):
    owners = T.outputs(spark, d).select(F.col("token").alias("ref"), "account", "height")
    return names.owned(T.tokens(spark, d).select("name", "height", "ref"), owners, OWNER)


@query("tokens", "SELECT * FROM tokens WHERE contains(lower(name || ' ' || ticker || ' ' || type), lower('Brand')) ORDER BY height DESC, ref LIMIT 200")
def realm_search(spark, d):
    return names.search(T.tokens(spark, d), "bRAND", ["name", "ticker", "type"])


@query("tokens", "SELECT ref, name FROM tokens WHERE ref >= 120 ORDER BY ref LIMIT 25")
def keyset_page(spark, d):
    return keyset(T.tokens(spark, d).select("ref", "name"), ["ref"], [120], 25)


# ---- scalar functions


@query(
    "",
    """SELECT c_custkey, sha256(c_name) AS hash, substr(sha256(c_name), 1, 22) AS hashx,
       array_to_string(list_transform(range(32, 0, -1), lambda i: substr(sha256(c_name), (i * 2 - 1)::INT, 2)), '') AS shown FROM customer""",
)
def hashes(spark, d):
    script = F.col("c_name").cast("binary")
    return T.table(spark, d, "customer").select("c_custkey", F.lower(F.hex(C.sha256(script))).alias("hash"), F.lower(F.hex(C.hashx(script))).alias("hashx"), C.scripthash(script).alias("shown"))


@query("", "SELECT p_partkey, (p_partkey * 1000 / 100000000)::DECIMAL(28, 8)::VARCHAR AS coins, ((p_size * 30) // 144)::BIGINT AS dy FROM part")
def units(spark, d):
    return T.table(spark, d, "part").select("p_partkey", C.coins(F.col("p_partkey") * 1000).cast("string").alias("coins"), C.block_day(F.col("p_size") * 30).cast("long").alias("dy"))


@query(
    "",
    """SELECT p_partkey, CASE WHEN name = '' THEN 'Name cannot be empty' WHEN length(name) > 63 THEN 'Name exceeds maximum length of 63' WHEN starts_with(name, '-') THEN 'Name cannot start with hyphen' WHEN ends_with(name, '-') THEN 'Name cannot end with hyphen'
       WHEN contains(name, '--') AND NOT starts_with(lower(name), 'xn--') THEN 'Name cannot contain consecutive hyphens (except Punycode prefix)' WHEN regexp_matches(lower(name), '[^a-z0-9-]') THEN 'Invalid character: ' || regexp_extract(lower(name), '([^a-z0-9-])', 1) END AS error
       FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN replace(p_name, ' ', '--') ELSE '-' || p_name END AS name FROM part)""",
)
def name_errors(spark, d):
    name = F.col("p_name")
    k = F.col("p_partkey") % 4
    named = F.when(k == 0, name).when(k == 1, F.replace(name, F.lit(" "), F.lit("-"))).when(k == 2, F.replace(name, F.lit(" "), F.lit("--"))).otherwise(F.concat(F.lit("-"), name))
    return T.table(spark, d, "part").select("p_partkey", C.name_error(named).alias("error"))
