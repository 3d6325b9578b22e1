"""Queries over standard forms of scripts, sets of one code, metadata of names and realms, and contracts in files; the SQL says what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import fixed, scripts
from ledgerlens.functions import templates as M
from ledgerlens.operators import chain
from ledgerlens.plans.catalog import POOL, query
from ledgerlens.plans.decoded import dealt_parts
from ledgerlens.sources import files
from ledgerlens.sources import tables as T

#: The contract whose code the queries of one code ask for.
CODE = 5


def _raw(text):
    return F.unhex(F.lit(text))


def _hash_of(c):
    return F.substring(F.unhex(F.sha2(c.cast("string"), 256)), 1, 20)


def _pays(c):
    return F.concat(_raw("76A914"), _hash_of(c), _raw("88AC"))


def _held(spark, d):
    """A token's script for each part: one of a kind, of many kinds before its separator, and paid to a script."""
    key = F.col("p_partkey")
    ref = F.concat(F.unhex(F.sha2("p_name", 256)), _raw("00000000"))
    single = F.concat(_raw("D8"), ref, _raw("75"), _pays(key))
    many = F.concat(_pays(key), _raw("BDD0"), ref, _raw("51"))
    to_script = F.concat(_raw("D8"), ref, _raw("75A914"), _hash_of(key), _raw("87"))
    script = F.when(key % 3 == 0, single).when(key % 3 == 1, many).otherwise(to_script)
    return dealt_parts(spark, d, "p_name").select(key.alias("part"), script.alias("script"))


PAYEE = "CASE WHEN p_partkey % 3 = 2 THEN 'a914' || substr(sha256(p_partkey::VARCHAR), 1, 40) || '87' ELSE '76a914' || substr(sha256(p_partkey::VARCHAR), 1, 40) || '88ac' END"


@query("", f"SELECT p_partkey AS part, {PAYEE} AS payee FROM part")
def token_payees(spark, d):
    """Whom every token's output pays, wherever its script says so."""
    return _held(spark, d).select("part", F.lower(F.hex(M.payee("script"))).alias("payee"))


@query(
    "",
    f"""SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'd8' || repeat('00', 36) || '75' || {PAYEE} WHEN 1 THEN {PAYEE} || 'bdd0' || repeat('00', 36) || '51'
    ELSE 'd8' || sha256(p_name) || '0000000075' || {PAYEE} END AS script FROM part""",
)
def blanked_references(spark, d):
    """Scripts by which outputs of all tokens with one payee look alike: no references where a signature is checked."""
    return _held(spark, d).select("part", F.lower(F.hex(M.without_references("script"))).alias("script"))


@query("", f"SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 2 THEN '05' ELSE '00' END || substr(sha256(p_partkey::VARCHAR), 1, 40) AS paid, p_partkey % 3 = 2 AS to_script FROM part")
def payee_addresses(spark, d):
    """The addresses of all payees, read back."""
    named = _held(spark, d).select("part", M.address(M.payee("script")).alias("address"))
    return named.select("part", F.lower(F.hex(scripts.from_base58check("address"))).alias("paid"), F.col("address").startswith("3").alias("to_script"))


@query()
def header_hashes(spark, d):
    """What every block's header is known by, and the key hash of its bytes."""
    header = F.col("height").cast("string").cast("binary")
    blocks = T.txs(spark, d).select("height").distinct()
    return blocks.select("height", F.lower(F.hex(M.header_hash(header))).alias("hash"), F.lower(F.hex(M.key_hash(header))).alias("key_hash"))


# ---- one code


def _of_code(spark, d):
    """Outputs whose script has the code of one contract, whatever its state; what is asked for is a constant, so each script is read once."""
    code = lambda minter: F.concat(_raw("BD"), _hash_of(minter), _raw("51"))
    state = F.concat(_raw("04"), F.unhex(F.lpad(F.hex("vout"), 8, "0")))
    points = T.outpoints(spark, d).withColumn("script", F.concat(state, code(F.col("minter"))))
    return points.filter(scripts.code_hash(F.col("script")) == F.unhex(F.sha2(code(F.lit(CODE).cast("long")), 256)))


@query("txs outs points", f"SELECT tx, vout, value, CASE WHEN height < {POOL} THEN height ELSE 0 END AS height FROM points WHERE minter = {CODE} AND NOT spent")
def code_unspent(spark, d):
    """Unspent outputs of one code: what is confirmed, without what the mempool spends and with what it makes."""
    height = F.when(F.col("height") < POOL, F.col("height")).otherwise(F.lit(0))
    return _of_code(spark, d).filter("NOT spent").select("tx", "vout", "value", height.alias("height"))


@query("txs outs points", f"SELECT tx, vout, value FROM points WHERE minter = {CODE} AND height >= {POOL}")
def code_made_in_pool(spark, d):
    return _of_code(spark, d).filter(F.col("height") >= POOL).select("tx", "vout", "value")


@query("txs outs points", f"SELECT tx, vout FROM points WHERE minter = {CODE} AND spend_height >= {POOL}")
def code_spent_in_pool(spark, d):
    """Outputs of one code that the mempool spends; the tables do not name the spender, so these are the spends themselves."""
    return _of_code(spark, d).filter(F.col("spend_height") >= POOL).select("tx", "vout")


# ---- orders


def _long(n):
    """A number in eight bytes, little-endian."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 16, "0"), F.lit("(..)"), 1)), ""))


@query(
    "txs book",
    """SELECT "order", CASE WHEN "order" % 3 = 0 THEN 1 ELSE 2 END AS outputs, price + CASE WHEN "order" % 3 = 0 THEN 0 ELSE height END AS total,
    CASE WHEN "order" % 3 <> 2 THEN '76a914' || substr(sha256(maker::VARCHAR), 1, 40) || '88ac' END AS maker FROM book""",
)
def order_terms(spark, d):
    """What every order asks to be paid, in how many outputs, and its maker: from terms that are a list, or one value and its script."""
    out = lambda n, script: F.concat(_long(n), F.unhex(F.lpad(F.hex(F.octet_length(script)), 2, "0")), script)
    maker = F.when(F.col("order") % 3 == 2, _raw("51")).otherwise(_pays(F.col("maker")))
    listed = F.concat(_raw("02"), out(F.col("height"), _raw("6A")), out(F.col("price"), maker))
    terms = F.when(F.col("order") % 3 == 0, F.concat(_long(F.col("price")), maker)).otherwise(listed)
    told = T.orders(spark, d).select("order", scripts.price_terms(terms).alias("outputs"), scripts.payment(terms).alias("p"))
    return told.select("order", F.size("outputs").alias("outputs"), F.col("p.total").cast("long").alias("total"), F.lower(F.hex("p.maker")).alias("maker"))


# ---- names and realms


@query(
    "",
    """SELECT c_custkey AS account, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS address, c_mktsegment AS display, CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || c_nationkey END AS a,
    CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END AS custom FROM customer""",
)
def name_zones(spark, d):
    """The records of every name's metadata; those without an address have the target of their attributes."""
    full = F.struct(F.col("c_name").alias("address"), F.col("c_mktsegment").alias("display"), F.concat(F.lit("10.0.0."), "c_nationkey").alias("A"), F.col("c_nationkey").cast("string").alias("x-nation"))
    bare = F.struct(F.col("c_mktsegment").alias("display"))
    meta = lambda zone: F.to_json(F.struct(F.struct(F.struct(zone.alias("zone")).alias("data")).alias("app"), F.struct(F.col("c_mktsegment").alias("target")).alias("attrs")))
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.when(F.col("c_custkey") % 2 == 0, meta(full)).otherwise(meta(bare)).alias("json"))
    return rows.select("account", M.zone(F.col("json")).alias("z")).select("account", "z.address", "z.display", "z.a", F.col("z.custom")["x-nation"].alias("custom"))


def _realms(spark, d):
    key = F.col("s_suppkey")
    body = F.struct(
        F.concat(F.lit("r-"), key.cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.get(F.array(*map(F.lit, ["world", "arena", "experience", "other"])), (key % 4).cast("int")).alias("kind"),
        F.array(key, -key, F.lit(0).cast("long")).alias("spawn"),
        (key * 100_000_000).alias("seed"),
        F.lit("owner").alias("owner"),
    )
    base = F.struct((key * 100).alias("royalty_bps"))
    app = F.struct(F.lit(fixed.REALM_SCHEMA).alias("schema"), F.struct(base.alias("base"), body.alias("realm")).alias("data"))
    rows = T.table(spark, d, "supplier").select(key.alias("supplier"), F.to_json(F.struct(app.alias("app"))).alias("json"))
    return rows.select("supplier", M.realm(F.col("json")).alias("r")).filter("r IS NOT NULL").select("supplier", "r.*")


REALMS = """SELECT s_suppkey AS supplier, 'r-' || s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'world' WHEN 1 THEN 'arena' ELSE 'experience' END AS kind, s_suppkey * 100000000 AS seed,
    CASE WHEN s_suppkey <= 50 THEN s_suppkey * 100 END AS royalty FROM supplier WHERE s_suppkey % 4 < 3 AND s_suppkey * 100000000 <= 4294967295"""


@query("", REALMS)
def realms_read(spark, d):
    """All realms whose metadata is valid: of a known kind, with a seed of 32 bits."""
    return _realms(spark, d).select("supplier", "id", "name", "kind", "seed", "royalty")


@query("", f"SELECT * FROM ({REALMS}) WHERE id = 'r-5'")
def realm_by_id(spark, d):
    """One realm, asked for by its id in any case."""
    return _realms(spark, d).filter(F.col("id") == F.lower(F.lit("R-5"))).select("supplier", "id", "name", "kind", "seed", "royalty")


# ---- contracts


@query("", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', {repr(op) if op else 'NULL'})" for i, (n, op) in enumerate(fixed.ALGORITHMS)) + ") v(id, name, opcode)")
def algorithm_catalogue(spark, d):
    """The mining algorithms by number."""
    rows = [F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name"), F.lit(op).cast("string").alias("opcode")) for i, (n, op) in enumerate(fixed.ALGORITHMS)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(
    "contracts",
    f"""SELECT ref, CASE ref % 6 WHEN 0 THEN 'fixed' WHEN 1 THEN 'epoch' WHEN 2 THEN 'asert' WHEN 3 THEN 'lwma' WHEN 4 THEN 'schedule' ELSE 'unknown' END AS adjustment,
    CASE WHEN ref % 6 IN (1, 2, 3) THEN {fixed.BLOCK_TIME} END AS block_time, CASE ref % 6 WHEN 1 THEN {fixed.EPOCH} WHEN 2 THEN {fixed.HALF_LIFE} WHEN 3 THEN {fixed.WINDOW} END AS span,
    CASE WHEN ref % 6 = 1 THEN {fixed.MOST_ADJUSTMENT} END AS most, difficulty, reward FROM contracts""",
)
def contract_adjustments(spark, d):
    """How each contract's difficulty is adjusted, with the settings of its way: an epoch's, a half-life's or a window's length."""
    way = F.col("ref") % 6
    named = F.coalesce(F.get(F.array(*map(F.lit, fixed.ADJUSTMENTS)), way.cast("int")), F.lit("unknown"))
    span = F.when(way == 1, fixed.EPOCH).when(way == 2, fixed.HALF_LIFE).when(way == 3, fixed.WINDOW)
    time, most = F.when(way.isin(1, 2, 3), fixed.BLOCK_TIME), F.when(way == 1, fixed.MOST_ADJUSTMENT)
    return T.contracts(spark, d).select("ref", named.alias("adjustment"), time.alias("block_time"), span.alias("span"), most.alias("most"), "difficulty", "reward")


@query("contracts", "SELECT sha256(ref::VARCHAR) || '_0' AS ref, name, algorithm, reward, difficulty, active FROM contracts WHERE ref % 5 <> 0")
def contracts_from_files(spark, d):
    """Contracts written to files and read again, without those that a deny list in a file names in other forms of their references."""
    path = f"{chain.shared_dir(spark)}/contracts-{uuid.uuid4().hex}"
    digest = F.sha2(F.col("ref").cast("string"), 256)
    rows = T.contracts(spark, d).withColumn("id", F.col("ref")).withColumn("ref", F.concat(digest, F.lit("_0")))
    files.write_contracts(rows.drop("id"), f"{path}/contracts")
    entry = F.when(F.col("id") % 2 == 0, F.to_json(F.struct("ref", F.lit("x").alias("reason")))).otherwise(F.concat(F.lit('"'), F.regexp_replace("ref", "_0$", ":0"), F.lit('"')))
    denied = rows.filter("id % 5 = 0").select(F.concat(F.lit('{"refs": ['), entry, F.lit(', "none"]}')).alias("value"))
    denied.write.option("lineSep", " ").option("maxRecordsPerFile", 1).text(f"{path}/denied")
    return files.allowed(files.read_contracts(spark, f"{path}/contracts"), files.read_denied(spark, f"{path}/denied"))
