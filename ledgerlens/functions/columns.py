"""Scalar functions of ledger data as Column expressions: they stay inside generated code, without Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import fixed


def bucket(value: Column, bounds: Sequence[tuple[float, str]]) -> Column:
    """The label of the last bound that value reaches; below all of them the first."""
    found = F.lit(bounds[0][1])
    for low, label in bounds[1:]:
        found = F.when(value >= low, label).otherwise(found)
    return found


def balance_bucket(base_units: Column, coin: int = fixed.COIN) -> Column:
    return bucket(base_units / coin, fixed.BALANCE_BUCKETS)


def age_bucket(days: Column) -> Column:
    return bucket(days, fixed.AGE_BUCKETS)


def block_day(height: Column) -> Column:
    return F.floor(F.greatest(height, F.lit(0)) / fixed.BLOCKS_PER_DAY)


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def double_sha256(data: Column) -> Column:
    return sha256(sha256(data))


def reversed_hex(data: Column) -> Column:
    """Lower-case hex of a binary in reverse byte order: how hashes are shown."""
    return F.lower(F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)), ""))


def from_reversed_hex(text: Column) -> Column:
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("(..)"), 1)), ""))


def hashx(script: Column) -> Column:
    """The address key: 11 bytes of the script's SHA-256."""
    return F.substring(sha256(script), 1, 11)


def scripthash(script: Column) -> Column:
    return reversed_hex(sha256(script))


def scripthash_to_hashx(text: Column) -> Column:
    return F.substring(from_reversed_hex(text), 1, 11)


def previous_hash(header: Column) -> Column:
    return F.substring(header, 5, 32)


def coins(base_units: Column) -> Column:
    return (base_units.cast("decimal(20,0)") / F.lit(fixed.COIN)).cast("decimal(28,8)")


def little_endian(data: Column, size: int) -> Column:
    """An unsigned number of `size` bytes."""
    return F.conv(reversed_hex(F.substring(data, 1, size)), 16, 10).cast("decimal(20,0)")


def script_number(data: Column) -> Column:
    """A script's number: little endian, the top bit of the last byte is the sign. Up to 8 bytes; null for more."""
    size = F.octet_length(data)
    top = F.conv(F.substring(F.hex(data), -2, 2), 16, 10).cast("int")
    whole = F.conv(reversed_hex(data), 16, 10).cast("decimal(20,0)")
    sign_bit = F.pow(F.lit(2.0), 8 * size - 1).cast("decimal(20,0)")
    return F.when(size == 0, F.lit(0).cast("decimal(20,0)")).when(size > 8, None).when(top >= 128, -(whole - sign_bit)).otherwise(whole)


def reference(txid: Column, vout: Column) -> Column:
    """A reference as it is shown: the hash in reverse, an underscore, the output's number."""
    return F.concat_ws("_", reversed_hex(txid), vout.cast("string"))


def reference_candidates(text: Column) -> Column:
    """The hashes (36 bytes: hash and little-endian number) that a reference in text may stand for; null if it is none."""
    shown = F.regexp_extract(text, "^\\s*([0-9a-fA-F]{64})[_:]([0-9]+)\\s*$", 1)
    number = F.lpad(F.hex(F.try_to_number(F.regexp_extract(text, "[_:]([0-9]+)\\s*$", 1), F.lit("9999999999")).cast("long")), 8, "0")
    raw = F.upper(F.trim(text))
    turned = F.concat(F.upper(F.array_join(F.reverse(F.regexp_extract_all(F.substring(raw, 1, 64), F.lit("(..)"), 1)), "")), F.substring(raw, 65, 8))
    of_shown = F.array(F.concat(F.upper(F.array_join(F.reverse(F.regexp_extract_all(shown, F.lit("(..)"), 1)), "")), F.array_join(F.reverse(F.regexp_extract_all(number, F.lit("(..)"), 1)), "")))
    return F.when(shown != "", of_shown).when(raw.rlike("^[0-9A-F]{72}$"), F.array_distinct(F.array(raw, turned)))


def pays_to_key_hash(script: Column) -> Column:
    """The 20 bytes that a standard pay-to-key-hash script names, else null."""
    return F.when((F.octet_length(script) == 25) & F.hex(script).rlike("^76A914.{40}88AC$"), F.substring(script, 4, 20))


def unspendable(script: Column) -> Column:
    return F.hex(script).rlike("^(6A|006A)")


def generation(prev_hash: Column, prev_index: Column) -> Column:
    return (prev_index == 4294967295) & (F.hex(prev_hash) == "00" * 32)


def sanitised(text: Column, longest: int) -> Column:
    """Without control characters, cut to a length."""
    return F.substring(F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", ""), 1, longest)


def name_error(name: Column) -> Column:
    """Why a name is not valid, null if it is."""
    low = F.lower(name)
    odd = F.regexp_extract(low, "([^a-z0-9-])", 1)
    return (
        F.when(name.isNull() | (name == ""), "Name cannot be empty")
        .when(F.length(name) > fixed.NAME_LENGTH, f"Name exceeds maximum length of {fixed.NAME_LENGTH}")
        .when(name.startswith("-"), "Name cannot start with hyphen")
        .when(name.endswith("-"), "Name cannot end with hyphen")
        .when(name.contains("--") & ~low.startswith("xn--"), "Name cannot contain consecutive hyphens (except Punycode prefix)")
        .when(odd != "", F.concat(F.lit("Invalid character: "), odd))
    )


def name_key(name: Column) -> Column:
    """16 bytes that a name is looked up by."""
    return F.substring(sha256(F.trim(F.lower(name))), 1, 16)


def branch(character: Column) -> Column:
    """The place of a character in a name tree, -1 if it has none."""
    return F.instr(F.lit(fixed.NAME_CHARACTERS), F.lower(character)) - 1


def token_type(protocols: Column) -> Column:
    """The token type's number from a list of protocol numbers."""
    has = lambda p: F.array_contains(protocols, p)
    number = {name: i for i, name in enumerate(fixed.TOKEN_TYPES)}
    return (
        F.when(has(fixed.FT) & has(fixed.DMINT), number["DMINT"])
        .when(has(fixed.FT), number["FT"])
        .when(has(fixed.NFT) & has(fixed.WAVE), number["WAVE"])
        .when(has(fixed.NFT) & has(fixed.CONTAINER), number["CONTAINER"])
        .when(has(fixed.NFT) & has(fixed.AUTHORITY), number["AUTHORITY"])
        .when(has(fixed.NFT), number["NFT"])
        .when(has(fixed.DAT), number["DAT"])
        .otherwise(number["UNKNOWN"])
    )


#: Which protocols need which others, with the message, in the order of the checks.
NEEDS = [
    (fixed.DMINT, fixed.FT, "DMINT requires FT"),
    (fixed.MUT, fixed.NFT, "MUT requires NFT"),
    (fixed.CONTAINER, fixed.NFT, "CONTAINER requires NFT"),
    (fixed.ENCRYPTED, fixed.NFT, "ENCRYPTED requires NFT"),
    (fixed.TIMELOCK, fixed.ENCRYPTED, "TIMELOCK requires ENCRYPTED"),
    (fixed.AUTHORITY, fixed.NFT, "AUTHORITY requires NFT"),
    (fixed.WAVE, fixed.NFT, "WAVE requires NFT"),
    (fixed.WAVE, fixed.MUT, "WAVE requires MUT"),
]


def protocol_error(protocols: Column) -> Column:
    """Why a combination of protocols is not valid, null if it is."""
    has = lambda p: F.array_contains(protocols, p)
    found = (
        F.when(has(fixed.FT) & has(fixed.NFT), "FT and NFT are mutually exclusive")
        .when(protocols == F.array(F.lit(fixed.BURN)), "BURN alone is invalid - it is an action marker, not a token type")
        .when(has(fixed.BURN) & ~has(fixed.FT) & ~has(fixed.NFT), "BURN must accompany FT or NFT")
    )
    for one, other, said in NEEDS:
        found = found.when(has(one) & ~has(other), said)
    return found


def label(number: Column, names: Sequence[str]) -> Column:
    """The name of a number, `unknown` beyond the list."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), number.cast("int")), F.lit("unknown"))


def cursor(key: Column) -> Column:
    """An opaque cursor: URL-safe base 64 of the key of the next row."""
    return F.rtrim(F.translate(F.base64(key.cast("binary")), "+/", "-_"), F.lit("="))


def from_cursor(text: Column) -> Column:
    plain = F.translate(F.rtrim(F.trim(text), F.lit("=")), "-_ ", "+/+")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")).cast("string")
