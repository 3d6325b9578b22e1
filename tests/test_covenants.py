"""Sales and prediction markets against scripts that are built here."""

import struct

from pyspark.sql import functions as F

from ledgerlens.functions import covenants as V
from ledgerlens.operators import markets
from tests.test_metadata import number, push

REF, KEY, SELLER = b"r" * 36, b"k" * 20, b"\x76\xa9\x14" + b"s" * 20 + b"\x88\xac"


def paid(output, script, value, again=None):
    return output + b"\xcd" + push(script) + b"\x88" + (again or output) + b"\xcc" + push(number(value)) + b"\xa2\x69"


def sale(*royalties, price=paid(b"\x00", SELLER, 500), end=b"\x51\x68", key=KEY):
    return b"\xd8" + REF + b"\x75\x63\x76\xa9" + push(key) + b"\x88\xac\x67" + price + b"".join(royalties) + end


def test_sales(spark):
    one = paid(b"\x52", b"a" * 25, 7)
    good = [sale(one), sale(one, paid(b"\x53", b"b" * 25, 2**63)), sale(*[one] * 32)]
    bad = [
        sale(),
        sale(*[one] * 33),
        sale(one, price=paid(b"\x00", SELLER, 0)),
        sale(one, price=paid(b"\x52", SELLER, 5)),
        sale(paid(b"\x52", b"a", 7, b"\x53")),
        sale(paid(b"\x51", b"a", 7)),
        sale(paid(b"\x52", b"a", -7)),
        sale(one, end=b"\x51"),
        sale(one) + b"\x51",
        sale(one, key=b"short"),
        sale(one)[:-9],
        b"",
        None,
    ]
    df = spark.createDataFrame([(i, None if s is None else bytearray(s)) for i, s in enumerate(good + bad)], "i int, s binary")
    found = [r.x for r in df.select("i", V.royalty_sale(F.col("s")).alias("x")).orderBy("i").collect()]
    assert [x is not None for x in found] == [True] * len(good) + [False] * len(bad)
    assert (bytes(found[0].ref), bytes(found[0].canceller), bytes(found[0].seller), found[0].price) == (REF, KEY, SELLER, 500)
    assert [(bytes(r.script), r.value) for r in found[1].royalties] == [(b"a" * 25, 7), (b"b" * 25, 2**63)]


def test_prediction_markets(spark):
    txid, yes, no, oracle = b"p" * 32, b"y" * 36, b"n" * 36, b"\x02" + b"o" * 32
    market = txid + struct.pack("<I", 258)
    state = b"\x01" + struct.pack("<II", 900, 50) + oracle
    own = push(state) + b"\xbd\xd8" + market + b"\xd0" + yes + b"\xd0" + no
    anchor = lambda share: push(bytes(20)) + b"\xbd\xd0" + share + b"\xd1" + market
    beacon = lambda expiry: b"\x6a" + push(b"RMKT") + b"\x51" + b"".join(map(push, (market, yes, no, struct.pack("<I", expiry), struct.pack("<I", 50), oracle, b"Will it?")))
    spends = (txid, 258)
    cases = {
        "good": ([own, anchor(yes), anchor(no), beacon(900)], spends),
        "other terms": ([own, anchor(yes), anchor(no), beacon(901)], spends),
        "long": ([own.replace(push(state), push(state + b"x" * 60)), anchor(yes), anchor(no), beacon(900)], spends),
        "not spent": ([own, anchor(yes), anchor(no), beacon(900)], (txid, 257)),
        "no singleton": ([own.replace(b"\xd8", b"\xd0"), anchor(yes), anchor(no), beacon(900)], spends),
        "swapped": ([own, anchor(no), anchor(yes), beacon(900)], spends),
        "two outputs": ([own, beacon(900)], spends),
        "no beacon": ([own, anchor(yes), anchor(no)], spends),
        "no state": ([b"", anchor(yes), anchor(no), beacon(900)], spends),
    }
    outputs = [(name, 7, vout, bytearray(s)) for name, (scripts, _) in cases.items() for vout, s in enumerate(scripts)]
    inputs = [(name, bytearray(prev), index) for name, (_, (prev, index)) in cases.items()]
    outputs, inputs = spark.createDataFrame(outputs, "txid string, height long, vout int, script binary"), spark.createDataFrame(inputs, "txid string, prev binary, index long")
    found = {r.txid: r for r in markets.prediction_markets(outputs, inputs).collect()}
    assert set(found) == {"good", "other terms", "long"}
    good = found["good"]
    assert (good.status, good.expiry, good.grace, bytes(good.oracle), good.optimistic, good.agrees, good.question, bytes(good.market)) == (1, 900, 50, oracle, False, True, "Will it?", market)
    assert not found["other terms"].agrees and found["long"].optimistic
    assert markets.prediction_markets(outputs.limit(0), inputs).count() == 0
