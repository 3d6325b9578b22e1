"""Standard forms inside scripts: who a token's script pays, scripts without their references, addresses, and hashes that Spark has not.

Input is not trusted: a script that ends too early gives null or itself, as each function says.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import columns as C
from ledgerlens.functions import fixed
from ledgerlens.functions.scripts import REFERENCES, base58check, walk

#: Opcodes that check a signature.
SIGNED = (0xAC, 0xAD, 0xAE, 0xAF)
#: The opcodes of a payment to a key's hash and to a script's hash; 0x14 pushes the 20 bytes.
TO_KEY, TO_SCRIPT = bytes([0x76, 0xA9, 0x14, 0x88, 0xAC]), bytes([0xA9, 0x14, 0x87])
#: Opcodes that drop one or two values.
DROPS = (0x75, 0x6D)
#: Bytes that an address of a key's and of a script's hash begins with.
KEY_VERSION, SCRIPT_VERSION = b"\x00", b"\x05"
#: Bytes of length after opcodes that push.
WIDE = {0x4C: 1, 0x4D: 2, 0x4E: 4}


@F.pandas_udf(T.BinaryType())
def sha512_256(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else hashlib.new("sha512_256", bytes(d)).digest())


@F.pandas_udf(T.BinaryType())
def ripemd160(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else hashlib.new("ripemd160", bytes(d)).digest())


def header_hash(header: Column) -> Column:
    """What a block is known by: SHA-512/256 twice."""
    return sha512_256(sha512_256(header))


def key_hash(key: Column) -> Column:
    """What a public key is paid by."""
    return ripemd160(C.sha256(key))


@F.pandas_udf(T.BinaryType())
def without_references(scripts: pd.Series) -> pd.Series:
    """The opcodes and operands of a script that checks a signature, with zeros for references and without the lengths of long pushes; any other script as it is; null for one that ends too early."""

    def blank(script):
        try:
            steps = list(walk(script))
        except IndexError:
            return None
        if not any(op in SIGNED for op, _ in steps):
            return script
        return b"".join(bytes([op]) + (bytes(36) if op in REFERENCES else data) for op, data in steps)

    return scripts.map(lambda s: None if s is None else blank(bytes(s)))


@F.pandas_udf(T.BinaryType())
def payee(scripts: pd.Series) -> pd.Series:
    """The payment to a key's or script's hash, in this order, that a token's script holds, wherever it stands; without one the script after
    its leading references and drops, and itself where nothing is left or it ends too early."""

    def find(script):
        ends, ops, lead = [0], bytearray(), 0
        try:
            for op, data in walk(script):
                ops.append(op)
                ends.append(ends[-1] + 1 + WIDE.get(op, 0) + len(data))
        except IndexError:
            return script
        for form in (TO_KEY, TO_SCRIPT):
            if (i := ops.find(form)) >= 0:
                return script[ends[i] : ends[i + len(form)]]
        while lead < len(ops) and (ops[lead] in REFERENCES or ops[lead] in DROPS):
            lead += 1
        return script[ends[lead] :] or script

    return scripts.map(lambda s: None if s is None else find(bytes(s)))


def address(script: Column) -> Column:
    """The address that a standard script pays, null for any other."""
    to_script = F.when((F.octet_length(script) == 23) & F.hex(script).rlike("^A914.{40}87$"), F.substring(script, 3, 20))
    to_key = C.pays_to_key_hash(script)
    return base58check(F.when(to_key.isNotNull(), F.concat(F.lit(KEY_VERSION), to_key)).otherwise(F.concat(F.lit(SCRIPT_VERSION), to_script)))


def shown(script: Column, hashx: Column) -> Column:
    """What stands for an account in a list: its address, else its script in hex, else its key."""
    plain = F.nullif(F.lower(F.hex(script)), F.lit(""))
    return F.coalesce(address(script), plain, F.lower(F.hex(hashx)))


# ---- names and realms in metadata (JSON text)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def zone(metadata: Column) -> Column:
    """address, avatar, display, description, url, email, the records A, AAAA, CNAME, TXT, MX, NS and custom (those from x- on) of a name's metadata.

    Lists come as JSON text. The address may also be the target of attributes that are of no other kind. Null for text that is no JSON.
    """
    v = F.try_parse_json(metadata)
    of = lambda name: _text(v, f"$.app.data.zone.{name}")
    target = F.when(F.coalesce(_text(v, "$.attrs.target_type"), F.lit("address")) == "address", _text(v, "$.attrs.target"))
    entries = F.from_json(F.get_json_object(metadata, "$.app.data.zone"), "map<string,string>")
    names = {"avatar": "avatar", "display": "display", "description": "desc", "url": "url", "email": "email", "a": "A", "aaaa": "AAAA", "cname": "CNAME", "txt": "TXT", "mx": "MX", "ns": "NS"}
    fields = [F.coalesce(F.nullif(of("address"), F.lit("")), target).alias("address")]
    fields += [F.coalesce(of(n), F.get_json_object(metadata, f"$.app.data.zone.{n}")).alias(alias) for alias, n in names.items()]
    custom = F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, _: k.startswith("x-"))
    return F.when(v.isNotNull(), F.struct(*fields, custom.alias("custom")))


def realm(metadata: Column) -> Column:
    """id, name, kind, seed, spawn, owner, description, creator, royalty of a realm's metadata; null unless it is one by its schema and all that must be there fits."""
    v = F.try_parse_json(metadata)
    of = lambda name: _text(v, f"$.app.data.realm.{name}")
    is_text = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    is_whole = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT"
    text = lambda path: F.when(is_text(path), _text(v, path))
    cleaned = lambda path, longest: F.nullif(C.sanitised(text(path), longest), F.lit(""))
    here = "$.app.data.realm"
    name, seed, space = text(f"{here}.id"), F.try_variant_get(v, f"{here}.seed", "long"), text("$.app.namespace")
    spawn = F.array(*[F.when(is_whole(f"{here}.spawn[{i}]"), F.try_variant_get(v, f"{here}.spawn[{i}]", "long")) for i in range(3)])
    longer = F.try_variant_get(v, f"{here}.spawn[3]", "variant").isNotNull()
    royalty = F.try_variant_get(v, "$.app.data.base.royalty_bps", "long")
    given = F.get_json_object(metadata, "$.app.namespace").isNull() | (space == fixed.REALM_NAMESPACE)
    fits = (
        (text("$.app.schema") == fixed.REALM_SCHEMA)
        & given
        & F.length(name).between(2, fixed.REALM_ID_LENGTH)
        & name.rlike(fixed.REALM_ID)
        & text(f"{here}.kind").isin(fixed.REALM_KINDS)
        & is_whole(f"{here}.seed")
        & seed.between(0, 2**32 - 1)
        & ~F.exists(spawn, lambda n: n.isNull())
        & ~longer
        & (text(f"{here}.owner") != "")
    )
    return F.when(
        fits,
        F.struct(
            name.alias("id"),
            F.coalesce(cleaned(f"{here}.name", fixed.REALM_NAME_LENGTH), cleaned("$.name", fixed.REALM_NAME_LENGTH), name).alias("name"),
            of("kind").alias("kind"),
            seed.alias("seed"),
            spawn.alias("spawn"),
            of("owner").alias("owner"),
            cleaned(f"{here}.desc", fixed.REALM_TEXT_LENGTH).alias("description"),
            F.nullif(text("$.app.data.base.creator"), F.lit("")).alias("creator"),
            F.when(is_whole("$.app.data.base.royalty_bps") & royalty.between(0, fixed.MOST_ROYALTY), royalty).alias("royalty"),
        ),
    )
