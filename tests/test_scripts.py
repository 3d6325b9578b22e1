"""Decoders against scripts that are built here."""

import hashlib
import random
import struct

from pyspark.sql import functions as F

from ledgerlens.functions import scripts as S


def push(data):
    return (bytes([len(data)]) if len(data) < 0x4C else b"\x4c" + bytes([len(data)])) + data


def sha(data):
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def decoded(spark, script, f):
    df = spark.createDataFrame([(bytearray(script),)], "s binary").withColumn("c", S.chunks("s"))
    return df.select(f(F.col("s"), F.col("c")).alias("x")).first().x


def test_advertisements(spark):
    token, want, utxo = bytes(range(32)), b"w" * 32, b"u" * 32
    one = b"\x6a" + b"".join(map(push, (b"RSWP", b"\x01", b"\x02", token, utxo, b"\x05", b"terms", b"sig")))
    two = b"\x6a" + b"".join(map(push, (b"RSWP", b"\x02", b"\x01", b"\x01", b"\x01", token, want, utxo, b"\x07", b"terms", b"sig")))
    three = b"\x6a" + b"".join(map(push, (b"RSWP", b"\x03", b"\x02", b"\x01", b"\x01", token, struct.pack("<I", 900), utxo, b"\x07", b"terms", b"sig")))
    a, b, c = (decoded(spark, s, S.swap_advertisement) for s in (one, two, three))
    assert (a.version, bytes(a.token), a.want, bytes(a.utxo), a.vout, bytes(a.terms)) == (1, token, None, utxo, 5, b"terms")
    assert (b.version, bytes(b.want), bytes(b.utxo), b.vout, b.expiry) == (2, want, utxo, 7, 0)
    assert (c.version, c.want, c.expiry, bytes(c.utxo)) == (3, None, 900, utxo)
    late = two.replace(push(b"\x01"), push(b"\x02"), 1)
    assert decoded(spark, late, S.swap_advertisement) is None and decoded(spark, two[:60], S.swap_advertisement) is None


def test_beacons(spark):
    ref = bytes(range(36))
    royalty = b"\x6a" + push(b"RRYL") + b"\x51" + push(ref)
    assert tuple(decoded(spark, royalty, S.royalty_beacon)) == (1, ref)
    market = b"\x6a" + b"".join(map(push, (b"RMKT", b"\x01", ref, ref, ref, struct.pack("<I", 4444), struct.pack("<I", 50), b"o" * 33, "Will it?".encode())))
    found = decoded(spark, market, S.market_beacon)
    assert (found.expiry, found.grace, found.question) == (4444, 50, "Will it?") and decoded(spark, market[:-1], S.market_beacon) is None


def test_numbers_that_opcodes_push(spark):
    """Output 1 is pushed by an opcode; a byte 0x51 that is pushed stays 81; a market of another version is none."""
    token, utxo, ref = bytes(range(32)), b"u" * 32, bytes(range(36))
    one = b"\x6a" + b"".join(map(push, (b"RSWP", b"\x01", b"\x02", token, utxo))) + b"\x51" + push(b"terms") + push(b"sig")
    assert decoded(spark, one, S.swap_advertisement).vout == 1
    assert decoded(spark, one.replace(b"\x51" + push(b"terms"), push(b"\x51") + push(b"terms")), S.swap_advertisement).vout == 81
    market = lambda v: b"\x6a" + push(b"RMKT") + v + b"".join(map(push, (ref, ref, ref, struct.pack("<I", 4), struct.pack("<I", 5), b"o" * 33, b"?")))
    assert decoded(spark, market(b"\x51"), S.market_beacon).expiry == 4 and decoded(spark, market(push(b"\x07")), S.market_beacon) is None


def test_version_3_is_named_by_what_it_spends_and_makes(spark):
    low, high = b"\x01" * 35 + b"\x02", b"\x02" * 35 + b"\x01"  # as numbers with the last byte first, high comes before low
    script = b"\xd0" + low + b"\xd8" + high + b"\xd0" + low + b"\x76"
    raw = struct.pack("<i", 3) + b"\x01" + b"p" * 32 + struct.pack("<I", 7) + b"\x02ss" + b"\xff\xff\xff\xfe" + b"\x02" + struct.pack("<Q", 5000) + bytes([len(script)]) + script + struct.pack("<Q", 1) + b"\x01\x76" + struct.pack("<I", 99)
    made = struct.pack("<Q", 5000) + sha(script) + struct.pack("<I", 2) + sha(high + low) + struct.pack("<Q", 1) + sha(b"\x76") + bytes(36)
    want = sha(struct.pack("<Ii", 3, 1) + sha(b"p" * 32 + struct.pack("<I", 7) + sha(b"ss")) + sha(b"\xff\xff\xff\xfe") + struct.pack("<i", 2) + sha(made) + struct.pack("<I", 99))
    old = struct.pack("<i", 2) + raw[4:]
    rows = S.transactions(spark.createDataFrame([(1, bytearray(bytes(80) + b"\x02" + raw + old))], "height long, raw binary")).orderBy("pos").collect()
    assert [bytes(r.txid) for r in rows] == [want, sha(old)]


def test_states_terms_and_ranges(spark):
    from decimal import Decimal

    script = b"\x02\xbdz\x4c\x01\xbd\xd8" + b"\xbd" * 36 + b"\xbd\x76\xa9"
    rows = spark.createDataFrame([(bytearray(script),), (bytearray(b"\x76"),), (bytearray(b"\x05a"),), (None,)], "s binary").select(S.state_separator("s").alias("at"), S.code_hash(F.col("s")).alias("h")).collect()
    assert [r.at for r in rows] == [43, 0, None, None]
    assert bytes(rows[0].h) == hashlib.sha256(script[43:]).digest() and bytes(rows[1].h) == hashlib.sha256(b"\x76").digest() and rows[2].h is None
    payee = b"\x76\xa9\x14" + b"k" * 20 + b"\x88\xac"
    terms = b"\x02" + struct.pack("<Q", 2**63) + b"\x01\x6a" + struct.pack("<Q", 2**63 + 5) + bytes([len(payee)]) + payee
    alone = struct.pack("<Q", 7) + payee
    out = spark.createDataFrame([(bytearray(terms),), (bytearray(alone),), (bytearray(b"\x01\x02"),), (bytearray(b""),)], "t binary").select(S.payment(F.col("t")).alias("p")).collect()
    assert (out[0].p.total, bytes(out[0].p.maker)) == (2**64 + 5, payee) and (out[1].p.total, bytes(out[1].p.maker)) == (7, payee) and out[2].p is None and out[3].p is None
    amounts = spark.createDataFrame([(Decimal(-1),), (Decimal(0),), (Decimal(2**64 - 1),), (Decimal(2**64),)], "a decimal(38,0)").select(S.in_range(F.col("a")).alias("x")).collect()
    assert [r.x for r in amounts] == [False, True, True, False]


def test_random_scripts_never_raise(spark):
    rng = random.Random(1)
    rows = [(bytearray(rng.randbytes(rng.randrange(60))),) for _ in range(400)] + [(bytearray([a, b]),) for a in range(0, 256, 5) for b in range(0, 256, 17)] + [(None,)]
    df = spark.createDataFrame(rows, "s binary").withColumn("c", S.chunks("s"))
    out = df.select(S.references("s"), S.state_separator("s"), S.payment(F.col("s")), S.swap_advertisement(F.col("s"), F.col("c")), S.royalty_beacon(F.col("s"), F.col("c")), S.market_beacon(F.col("s"), F.col("c")))
    assert len(out.collect()) == len(rows)


def test_references(spark):
    a, b = bytes([1]) * 36, bytes([2]) * 36
    row = spark.createDataFrame([(bytearray(b"\xd0" + a + b"\x02zz" + b"\xd8" + b + b"\xd0" + a),)], "s binary").select(S.references("s").alias("r")).first()
    assert [(bytes(x.ref), x.singleton) for x in row.r] == [(a, False), (b, True)]


def test_opcodes_between_references_have_no_operand(spark):
    ref = bytes(range(36))
    for op in range(0xD4, 0xD8):
        script = bytes([op, 0xD8]) + ref + b"\xbd\xac"
        row = spark.createDataFrame([(script,)], "s binary").select(S.references("s").alias("r"), S.state_separator("s").alias("at")).first()
        assert [(bytes(r.ref), r.singleton) for r in row.r] == [(ref, True)] and row["at"] == 38


def test_transactions_and_spends(spark):
    def tx(inputs, outputs):
        body = struct.pack("<i", 1) + bytes([len(inputs)])
        for prev, index in inputs:
            body += prev + struct.pack("<I", index) + b"\x01\x51" + struct.pack("<I", 0)
        body += bytes([len(outputs)])
        for value, script in outputs:
            body += struct.pack("<Q", value) + bytes([len(script)]) + script
        return body + struct.pack("<I", 0)

    first = tx([(b"\0" * 32, 0xFFFFFFFF)], [(2**64 - 1, b"\x51"), (7, b"\x6a\x01x")])
    second = tx([(sha(first), 0)], [(5, b"\x52")])
    block = b"h" * 80 + b"\x02" + first + second
    df = spark.createDataFrame([(1, bytearray(block)), (2, bytearray(block[:150]))], "height long, raw binary")
    txs = S.transactions(df).cache()
    assert [bytes(r.txid) for r in txs.filter("height = 1").orderBy("pos").collect()] == [sha(first), sha(second)]
    outs = S.outputs_of(txs.filter("height = 1")).collect()
    assert sorted(int(r.value) for r in outs) == [5, 2**64 - 1] and S.inputs_of(txs.filter("height = 1")).count() == 1


def test_base58(spark):
    rng = random.Random(2)
    rows = [(bytearray(b"\0" * (i % 3) + rng.randbytes(20)),) for i in range(30)]
    out = spark.createDataFrame(rows, "p binary").select("p", S.base58check("p").alias("t")).select("p", "t", S.from_base58check("t").alias("b")).collect()
    assert all(r.p == r.b for r in out)
    assert spark.createDataFrame([("1BoatSLRHtKNngkdXEeobR76b53LETtpyT",), ("1BoatSLRHtKNngkdXEeobR76b53LETtpyU",), ("0",)], "t string").select(S.from_base58check("t").alias("b")).filter("b is not null").count() == 1
