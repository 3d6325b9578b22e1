"""Queries over scripts: rows of the ledger are written as scripts, as blocks hold them, and read again; the SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import covenants as V
from ledgerlens.functions import metadata as M
from ledgerlens.plans.catalog import query
from ledgerlens.sources import tables as T


def _bytes(n: Column, wide: int) -> Column:
    """A number in so many bytes, little-endian."""
    pairs = F.lpad(F.hex(n), 2 * wide, "0")
    return F.unhex(F.concat(*[F.substring(pairs, 2 * i + 1, 2) for i in reversed(range(wide))]))


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def _raw(text: str) -> Column:
    return F.unhex(F.lit(text))


def _push(data: Column) -> Column:
    """A push of up to 255 bytes."""
    size = F.octet_length(data)
    return F.concat(F.when(size < 0x4C, _byte(size)).otherwise(F.concat(_raw("4C"), _byte(size))), data)


def _cbor_text(text: Column) -> Column:
    """A text of up to 255 bytes."""
    data = text.cast("binary")
    size = F.octet_length(data)
    return F.concat(F.when(size < 24, _byte(size + 0x60)).otherwise(F.concat(_raw("78"), _byte(size))), data)


def _field(name: str, value: Column) -> Column:
    return F.concat(_cbor_text(F.lit(name)), value)


def _cbor_number(n: Column) -> Column:
    """A number from 0 on in eight bytes."""
    return F.concat(_raw("1B"), F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0")))


def dealt_parts(spark, d, *columns: str):
    """Parts dealt out by key: their file is small, one task would read it and decode all of its scripts."""
    return T.table(spark, d, "part").select("p_partkey", *columns).repartition("p_partkey")


def _revealed(spark, d):
    """A script for each part: every third with a map of short names, the others with long ones; every second as an output with flags."""
    parts = dealt_parts(spark, d, "p_name", "p_type", "p_size")
    key = F.col("p_partkey")
    protocols = F.concat(_raw("82"), _byte(F.lit(1)), _byte(F.lit(4)))
    short = F.concat(_raw("A3"), _field("p", protocols), _field("n", _cbor_text(F.col("p_name"))), _field("dc", _cbor_number(F.col("p_size"))))
    mining = F.concat(_raw("A1"), _field("reward", _cbor_number(key + 1)))
    long = F.concat(_raw("A4"), _field("type", _cbor_text(F.lit("FT"))), _field("name", _cbor_text(F.col("p_name"))), _field("ticker", _cbor_text(F.col("p_type"))), _field("dmint", mining))
    held = _push(F.when(key % 3 == 0, short).otherwise(long))
    apart = F.concat(_push(F.lit("gly").cast("binary")), held)
    flagged = F.concat(_raw("6A"), _push(F.concat(F.lit("gly").cast("binary"), _raw("0280"))), held)
    return parts.select(key.alias("part"), F.when(key % 2 == 0, flagged).otherwise(apart).alias("script"))


@query(
    "",
    """SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS version, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS ticker,
    CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS decimals, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 1 END AS token_type, CASE WHEN p_partkey % 3 = 0 THEN 'dMint FT' ELSE 'Fungible Token' END AS kind FROM part""",
)
def token_rows(spark, d):
    """Every token's row, from the envelope in its script: mark, metadata, protocols or type, names long or short."""
    read = _revealed(spark, d).select("part", M.envelope(F.col("script")).alias("e"))
    told = read.select("part", "e.version", M.metadata_json(F.col("e.metadata")).alias("json"))
    parsed = told.select("part", "version", F.try_parse_json("json").alias("v"))
    info = parsed.select("part", M.variant_info(F.col("v"), F.col("version")).alias("i"))
    return info.select("part", "i.version", "i.name", "i.ticker", "i.decimals", "i.token_type", "i.kind")


@query("", "SELECT p_partkey AS part, lower(sha256(p_name)) AS commit_hash, p_partkey % 2 = 0 AS rooted FROM part")
def token_commits(spark, d):
    """Promises of metadata: their hash, and whether they name a root of contents."""
    parts = dealt_parts(spark, d, "p_name")
    digest = F.unhex(F.sha2("p_name", 256))
    rooted = F.col("p_partkey") % 2 == 0
    promise = F.concat(F.lit("gly").cast("binary"), _raw("02"), F.when(rooted, F.concat(_raw("01"), digest, digest)).otherwise(F.concat(_raw("00"), digest)))
    read = parts.select(F.col("p_partkey").alias("part"), M.envelope(F.concat(_raw("6A"), _push(promise))).alias("e"))
    return read.select("part", F.lower(F.hex("e.commit_hash")).alias("commit_hash"), F.col("e.content_root").isNotNull().alias("rooted"))


@query(
    "",
    """SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS version, p_size::BIGINT AS height, p_partkey % 7 AS max_height, p_partkey + 1 AS reward,
    CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 5 END AS algorithm, 4611686018427387904 AS target FROM part WHERE p_partkey % 7 > 0""",
)
def contract_states(spark, d):
    """The states of mining contracts in scripts, of both versions; one that mines no block is none."""
    parts = dealt_parts(spark, d, "p_size")
    key = F.col("p_partkey")
    ref = F.concat(F.unhex(F.sha2(key.cast("string"), 256)), _bytes(F.lit(0).cast("long"), 4))
    number = lambda n: _push(_bytes(n.cast("long"), 8))
    head = F.concat(_push(_bytes(F.col("p_size").cast("long"), 4)), _raw("D8"), ref, _raw("D0"), ref, number(key % 7), number(key + 1))
    late = F.when(key % 2 == 0, F.concat(number(key % 5), _raw("51"), number(F.lit(60)), number(F.lit(1_700_000_000)))).otherwise(_raw(""))
    script = F.concat(head, late, number(F.lit(1 << 62)), _raw("BD51AC"))
    read = parts.select(key.alias("part"), M.contract_state(script).alias("c")).filter("c IS NOT NULL")
    return read.select("part", "c.version", "c.height", "c.max_height", "c.reward", "c.algorithm", "c.target")


def _sale(spark, d):
    """A sale script for each output of a token that is offered: its seller, a price, and one or two royalties."""
    points = T.outpoints(spark, d).filter("amount % 5 = 0").select("token", "account", "tx", "vout", "value", "height", "spent")
    hash_of = lambda c: F.substring(F.unhex(F.sha2(c.cast("string"), 256)), 1, 20)
    pays = lambda c: F.concat(_raw("76A9"), _push(hash_of(c)), _raw("88AC"))
    ref = F.concat(F.unhex(F.sha2(F.col("tx").cast("string"), 256)), _bytes(F.col("vout").cast("long"), 4))
    paid = lambda i, to, n: F.concat(_raw(i), _raw("CD"), _push(to), _raw("88"), _raw(i), _raw("CC"), _push(_bytes(n.cast("long"), 8)), _raw("A269"))
    first, second = paid("52", pays(F.col("token")), F.col("value") + 1), paid("53", pays(F.col("account")), F.col("value") + 2)
    royalties = F.when(F.col("token") % 2 == 0, F.concat(first, second)).otherwise(first)
    seller = pays(F.col("account"))
    script = F.concat(_raw("D8"), ref, _raw("7563"), seller, _raw("67"), paid("00", seller, F.col("value") + 1), royalties, _raw("5168"))
    return points.withColumn("script", script)


@query(
    "txs outs points",
    """SELECT tx, vout, token, account AS seller, value + 1 AS price, CASE WHEN token % 2 = 0 THEN 2 ELSE 1 END AS royalties, value + 1 + CASE WHEN token % 2 = 0 THEN value + 2 ELSE 0 END AS royalty_total FROM points WHERE amount % 5 = 0 AND NOT spent""",
)
def royalty_listings(spark, d):
    """Sales with royalties that are open: the terms are read from the script, and spending the output closes it."""
    read = _sale(spark, d).filter(~F.col("spent")).select("tx", "vout", "token", F.col("account").alias("seller"), V.royalty_sale(F.col("script")).alias("s"))
    total = F.aggregate("s.royalties", F.lit(0).cast("decimal(38,0)"), lambda t, r: (t + r["value"]).cast("decimal(38,0)"))
    found = read.filter("s IS NOT NULL")
    return found.select("tx", "vout", "token", "seller", F.col("s.price").cast("long").alias("price"), F.size("s.royalties").alias("royalties"), total.cast("long").alias("royalty_total"))
