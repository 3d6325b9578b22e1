"""Laws that hold on any data."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.operators import chain, ledger
from ledgerlens.operators.paging import keyset, next_key
from ledgerlens.sources import tables as T


def test_buckets_hold_all_that_is_unspent(spark, small):
    out = T.outputs(spark, small)
    held = out.filter("not spent").agg(F.sum("value")).first()[0]
    assert ledger.balance_distribution(out, 100).agg(F.sum("amount")).first()[0] == held
    assert ledger.supply_aging(out, T.mempool_height()).agg(F.sum("amount")).first()[0] == held


@pytest.mark.parametrize("height", [0, 700, 1500, 3000])
def test_rollback_is_rebuilding(spark, small, height):
    out = T.outputs(spark, small)
    then = out.filter(F.col("height") <= height).withColumn("spend_height", F.when(F.col("spend_height") <= height, F.col("spend_height")))
    assert sorted(ledger.balances(out, height).collect()) == sorted(ledger.balances(then).collect())


@pytest.mark.parametrize("descending", [False, True])
def test_pages_visit_each_row_once(spark, small, descending):
    rows = T.tokens(spark, small).select("height", "ref").filter("ref < 60").cache()
    seen, start = [], None
    while True:
        seen += [tuple(r) for r in keyset(rows, ["height", "ref"], start, 17, descending).collect()]
        start = next_key(rows, ["height", "ref"], start, 17, descending)
        if start is None:
            break
    assert seen == sorted(map(tuple, rows.collect()), reverse=descending)


def sha(data):
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def folded(hashes):
    while len(hashes) > 1:
        if len(hashes) % 2:
            hashes = [*hashes, hashes[-1]]
        hashes = [sha(a + b) for a, b in zip(hashes[::2], hashes[1::2], strict=True)]
    return hashes[0]


def test_merkle_roots_and_branches(spark):
    leaves = {n: [sha(bytes([i])) for i in range(n)] for n in (1, 2, 3, 5, 8, 13)}
    df = spark.createDataFrame([(n, i, bytearray(h)) for n, hs in leaves.items() for i, h in enumerate(hs)], "block long, pos long, hash binary")
    roots = {r.block: bytes(r.root) for r in chain.merkle_roots(df).collect()}
    assert roots == {n: folded(hs) for n, hs in leaves.items()}
    asked = spark.createDataFrame([(n, i) for n in (3, 5, 13) for i in range(n)], "block long, pos long")
    for row in chain.merkle_branch(df, asked).collect():
        own, at = leaves[row.block][row.pos], row.pos
        for other in map(bytes, row.branch):
            own, at = sha(other + own if at % 2 else own + other), at // 2
        assert own == roots[row.block]


def test_scalars(spark):
    data = bytes(range(40))
    row = (
        spark.createDataFrame([(bytearray(data), bytearray(b"\x76\xa9\x14" + data[:20] + b"\x88\xac"), bytearray(b"\x6a\x01"))], "a binary, p binary, r binary")
        .select(
            C.reversed_hex(F.col("a")).alias("rev"),
            C.hashx(F.col("a")).alias("hx"),
            C.scripthash_to_hashx(C.scripthash(F.col("a"))).alias("hx2"),
            C.pays_to_key_hash(F.col("p")).alias("pkh"),
            C.pays_to_key_hash(F.col("a")).alias("none"),
            C.unspendable(F.col("r")).alias("un"),
            C.from_cursor(C.cursor(F.lit("key?>1"))).alias("cursor"),
            C.script_number(F.unhex(F.lit("FF80"))).alias("minus"),
            C.script_number(F.unhex(F.lit("E803"))).alias("thousand"),
            C.reference(F.unhex(F.lit("00" * 31 + "FF")), F.lit(3)).alias("ref"),
            C.token_type(F.array(F.lit(1), F.lit(4))).alias("type"),
            C.protocol_error(F.array(F.lit(11), F.lit(2))).alias("error"),
            C.protocol_error(F.array(F.lit(1))).alias("fine"),
        )
        .first()
    )
    assert row.rev == data[::-1].hex() and bytes(row.hx) == bytes(row.hx2) == hashlib.sha256(data).digest()[:11]
    assert bytes(row.pkh) == data[:20] and row.none is None and row.un and row.cursor == "key?>1"
    assert (row.minus, row.thousand) == (-255, 1000)
    assert row.ref == "ff" + "00" * 31 + "_3" and row.type == 4 and row.error == "WAVE requires MUT" and row.fine is None


def test_reference_candidates(spark):
    raw = "ab" * 31 + "cd" + "01000000"
    shown = "cd" + "ab" * 31 + "_1"
    row = spark.range(1).select(*[C.reference_candidates(F.lit(x)).alias(n) for n, x in (("raw", raw), ("shown", shown), ("bad", "xyz"))]).first()
    assert row.raw == [raw.upper(), ("cd" + "ab" * 31 + "01000000").upper()] and row.shown == [raw.upper()] and row.bad is None
