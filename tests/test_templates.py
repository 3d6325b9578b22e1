"""Templates, hashes, zones and realms against values that are built here."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import templates as M

KEY = bytes(range(20))
TO_KEY = b"\x76\xa9\x14" + KEY + b"\x88\xac"
TO_SCRIPT = b"\xa9\x14" + KEY + b"\x87"
REF = bytes([0xAC]) * 36


def one(spark, script, f):
    found = spark.createDataFrame([(script,)], "s binary").select(f(F.col("s")).alias("x")).first().x
    return bytes(found) if isinstance(found, bytearray) else found


@pytest.mark.parametrize(
    ("script", "found"),
    [
        (TO_KEY, TO_KEY),
        (b"\xd8" + REF + b"\x75" + TO_KEY, TO_KEY),
        (TO_KEY + b"\xbd\xd0" + REF + b"\x51", TO_KEY),
        (b"\xd0" + REF + b"\x75" + TO_SCRIPT, TO_SCRIPT),
        (TO_SCRIPT + TO_KEY, TO_KEY),
        (bytes([len(TO_KEY)]) + TO_KEY, bytes([len(TO_KEY)]) + TO_KEY),  # pushed bytes are no template
        (b"\xd8" + REF + b"\x6d\x51", b"\x51"),
        (b"\xd8" + REF, b"\xd8" + REF),
        (b"\x4c\x02ab\x51", b"\x4c\x02ab\x51"),
        (b"\xd8\x01", b"\xd8\x01"),
        (b"", b""),
        (None, None),
    ],
)
def test_payees(spark, script, found):
    assert one(spark, script, M.payee) == found


@pytest.mark.parametrize(
    ("script", "found"),
    [
        (b"\xd8" + REF + b"\x75" + TO_KEY, b"\xd8" + bytes(36) + b"\x75" + TO_KEY),
        (b"\xd8" + REF + b"\x51", b"\xd8" + REF + b"\x51"),
        (b"\x4c\x02ab\xac", b"\x4cab\xac"),
        (b"\xd4\xac", b"\xd4\xac"),
        (b"\x05ab", None),
        (b"", b""),
        (None, None),
    ],
)
def test_references_are_blanked_where_a_signature_is_checked(spark, script, found):
    assert one(spark, script, M.without_references) == found


def test_hashes(spark):
    twice = lambda b: hashlib.new("sha512_256", hashlib.new("sha512_256", b).digest()).digest()
    assert one(spark, b"abc", M.header_hash) == twice(b"abc")
    assert one(spark, b"", M.ripemd160).hex() == "9c1185a5c5e9fc54612808977ee8f548b2258d31"
    assert one(spark, b"key", M.key_hash) == hashlib.new("ripemd160", hashlib.sha256(b"key").digest()).digest()
    assert one(spark, None, M.header_hash) is None


def test_accounts_are_shown_by_address_script_or_key(spark):
    show = lambda s: M.shown(s, F.lit(b"\x01\x02"))
    assert one(spark, b"\x76\xa9\x14" + bytes(20) + b"\x88\xac", show) == "1111111111111111111114oLvT2"
    assert one(spark, b"\xa9\x14" + bytes(20) + b"\x87", show).startswith("3")
    assert one(spark, b"\x51", show) == "51"
    assert one(spark, b"", show) == one(spark, None, show) == "0102"


def read(spark, data, f):
    text = data if data is None or isinstance(data, str) else json.dumps(data)
    found = spark.createDataFrame([(text,)], "s string").select(f(F.col("s")).alias("x")).first().x
    return found and found.asDict()


def test_zones(spark):
    z = {"address": "r1", "display": "d", "A": "1.2.3.4", "MX": ["a", "b"], "x-custom": "1", "desc": "t"}
    found = read(spark, {"app": {"data": {"zone": z}}, "attrs": {"target": "r2"}}, M.zone)
    assert (found["address"], found["display"], found["a"], found["description"], found["custom"]) == ("r1", "d", "1.2.3.4", "t", {"x-custom": "1"})
    assert json.loads(found["mx"]) == ["a", "b"] and found["cname"] is None
    assert read(spark, {"attrs": {"target": "r2"}}, M.zone)["address"] == "r2"
    assert read(spark, {"attrs": {"target": "r2", "target_type": "url"}}, M.zone)["address"] is None
    assert read(spark, {}, M.zone)["custom"] == {}
    assert read(spark, "no json", M.zone) is read(spark, None, M.zone) is None


def payload(realm=None, app=None, **more):
    r = {"id": "abc-1", "name": "N\x07ame", "kind": "world", "spawn": [1, -2, 3], "seed": 7, "owner": "o"} | (realm or {})
    return {"name": "outer", "app": {"schema": "realm_v1", "namespace": "rxd.game", "data": {"base": {"creator": "c", "royalty_bps": 250}, "realm": r}} | (app or {})} | more


def test_realms(spark):
    found = read(spark, payload(), M.realm)
    assert found == {"id": "abc-1", "name": "Name", "kind": "world", "seed": 7, "spawn": [1, -2, 3], "owner": "o", "description": None, "creator": "c", "royalty": 250}
    assert read(spark, payload({"name": ""}), M.realm)["name"] == "outer"
    assert read(spark, payload({"name": 5}, name=None), M.realm)["name"] == "abc-1"
    assert read(spark, payload(app={"namespace": None}), M.realm)["id"] == "abc-1"


@pytest.mark.parametrize(
    "bad",
    [
        payload({"id": "A"}),
        payload({"id": "x" * 49}),
        payload({"kind": "else"}),
        payload({"seed": 2**32}),
        payload({"seed": -1}),
        payload({"seed": "7"}),
        payload({"seed": True}),
        payload({"spawn": [1, 2]}),
        payload({"spawn": [1, 2, 3, 4]}),
        payload({"spawn": [1, 2, "3"]}),
        payload({"owner": ""}),
        payload(app={"schema": "realm_v2"}),
        payload(app={"namespace": "other"}),
        payload(app={"namespace": 5}),
        [],
        "no json",
        None,
    ],
)
def test_what_is_no_realm(spark, bad):
    assert read(spark, bad, M.realm) is None
