"""What is read from binary scripts: one Arrow UDF cuts a script into chunks, everything after is columns over them.

Input is not trusted: a script that does not fit its format gives null, never an error.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Container, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import columns as C
from ledgerlens.functions import fixed

#: Opcodes: a script that carries data only, and operands of 36 bytes that name a reference.
RETURN = 0x6A
REFERENCES = (0xD0, 0xD1, 0xD2, 0xD3, 0xD8)
NORMAL, SINGLETON = 0xD0, 0xD8
#: What parts a script's state from its code, and the bytes of the length that follow these opcodes.
SEPARATOR, WIDTHS = 0xBD, {0x4C: 1, 0x4D: 2, 0x4E: 4}


def walk(script: bytes, references: Container[int] = REFERENCES) -> Iterator[tuple[int, bytes]]:
    """(opcode, operand) of each step, with an operand for opcodes of references; raises IndexError where the script ends too early."""
    at = 0
    while at < len(script):
        op = script[at]
        at += 1
        if op < 0x4C:
            size = op
        elif op <= 0x4E:
            wide = 1 << (op - 0x4C)
            size = int.from_bytes(script[at : at + wide], "little")
            at += wide
        else:
            size = 36 if op in references else 0
        if at + size > len(script):
            raise IndexError
        yield op, script[at : at + size]
        at += size


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def chunks(scripts: pd.Series) -> pd.Series:
    """What each step pushes (an opcode for 1 to 16, that number), or its opcode where it pushes nothing; up to where the script ends too early."""

    def cut(script):
        found = []
        try:
            for op, data in walk(script):
                found.append(data if op <= 0x4E and op else bytes([op - 0x50 if 0x51 <= op <= 0x60 else op]))
        except IndexError:
            pass
        return found

    return scripts.map(lambda s: None if s is None else cut(bytes(s)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("ref", T.BinaryType()), T.StructField("singleton", T.BooleanType())])))
def references(scripts: pd.Series) -> pd.Series:
    """References that a script pushes, in order, each once; null for a script that ends too early."""

    def read(script):
        try:
            found = [(data, op == SINGLETON) for op, data in walk(script) if op in (NORMAL, SINGLETON)]
        except IndexError:
            return None
        return [{"ref": r, "singleton": s} for r, s in dict.fromkeys(found)]

    return scripts.map(lambda s: None if s is None else read(bytes(s)))


def _at(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i))


def _text(c: Column) -> Column:
    return F.hex(c)


def _small(c: Column) -> Column:
    """A number of one byte."""
    return F.when(F.octet_length(c) == 1, F.conv(F.hex(c), 16, 10).cast("int"))


def _is_data(script: Column, c: Column, magic: bytes) -> Column:
    return (F.substring(F.hex(script), 1, 2) == f"{RETURN:02X}") & (_text(_at(c, 1)) == magic.hex().upper())


def swap_advertisement(script: Column, c: Column) -> Column:
    """version, token, want, utxo, vout, expiry, terms of an order that a script announces; c are its chunks.

    Version 1 is magic, version, kind, token, output's hash, its number, terms, signature. From 2 on there are flags, the
    offered kind and a constant before the token; flag 1 adds the wanted token after it, and in version 3 flag 2 an expiry.
    """
    version = _small(_at(c, 2))
    flags = F.coalesce(_small(_at(c, 3)), F.lit(0))
    want, late = flags.bitwiseAND(1), F.shiftright(flags.bitwiseAND(2), 1)
    token_at = F.when(version == 1, 4).otherwise(6)
    utxo_at = token_at + 1 + F.when(version == 1, 0).otherwise(want + late)
    token, utxo = F.get(c, token_at), F.get(c, utxo_at)
    expiry = F.when((version == 3) & (late == 1), C.little_endian(F.get(c, token_at + 1 + want), 4).cast("long")).otherwise(F.lit(0))
    wanted = F.when((version > 1) & (want == 1), F.get(c, token_at + 1))
    fits = (
        _is_data(script, c, b"RSWP")
        & version.between(1, 3)
        & (F.octet_length(token) == 32)
        & (F.octet_length(utxo) == 32)
        & (F.size(c) >= utxo_at + 4)
        & (wanted.isNull() | (F.octet_length(wanted) == 32))
        & ~((version == 2) & (late == 1))
    )
    return F.when(
        fits,
        F.struct(version.alias("version"), token.alias("token"), wanted.alias("want"), utxo.alias("utxo"), C.script_number(F.get(c, utxo_at + 1)).cast("long").alias("vout"), expiry.alias("expiry"), F.get(c, utxo_at + 2).alias("terms")),
    )


def royalty_beacon(script: Column, c: Column) -> Column:
    fits = _is_data(script, c, b"RRYL") & (F.octet_length(_at(c, 3)) == 36)
    return F.when(fits, F.struct(_small(_at(c, 2)).alias("version"), _at(c, 3).alias("ref")))


def market_beacon(script: Column, c: Column, longest: int = 1024) -> Column:
    """market, yes, no, expiry, grace, oracle, question of a prediction market, as version 1 writes them."""
    sizes = {3: 36, 4: 36, 5: 36, 6: 4, 7: 4, 8: 33}
    fits = _is_data(script, c, b"RMKT") & (_small(_at(c, 2)) == 1) & F.octet_length(_at(c, 9)).between(1, longest)
    for i, n in sizes.items():
        fits = fits & (F.octet_length(_at(c, i)) == n)
    number = lambda i: C.little_endian(_at(c, i), 4).cast("long")
    question = F.when(F.is_valid_utf8(_at(c, 9).cast("string")), _at(c, 9).cast("string"))
    return F.when(fits & question.isNotNull(), F.struct(_at(c, 3).alias("market"), _at(c, 4).alias("yes"), _at(c, 5).alias("no"), number(6).alias("expiry"), number(7).alias("grace"), _at(c, 8).alias("oracle"), question.alias("question")))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    wide = {253: 2, 254: 4, 255: 8}.get(first, 0)
    return (int.from_bytes(data[at + 1 : at + 1 + wide], "little") if wide else first), at + 1 + wide


def _twice(data: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(data).digest()).digest()


def _referred(script: bytes) -> bytes:
    """Of the different references that a script pushes, how many and a hash of all, as numbers in ascending order (last byte first)."""
    try:
        found = {data for op, data in walk(script) if op in (NORMAL, SINGLETON)}
    except IndexError:
        found = set()
    joint = b"".join(sorted(found, key=lambda ref: int.from_bytes(ref, "little")))
    return struct.pack("<I", len(found)) + (_twice(joint) if found else bytes(32))


def _txid_of_version_3(inputs: list[dict], sequences: list[bytes], outputs: list[dict], lock: bytes) -> bytes:
    """Version 3 is named by hashes of what it spends and makes, not by its bytes, so that a proof need not hold its scripts."""
    spent = b"".join(i["prev"] + struct.pack("<I", i["index"]) + _twice(i["script"]) for i in inputs)
    made = b"".join(struct.pack("<Q", int(o["value"])) + _twice(o["script"]) + _referred(o["script"]) for o in outputs)
    counted = [struct.pack("<Ii", 3, len(inputs)), _twice(spent), _twice(b"".join(sequences)), struct.pack("<i", len(outputs)), _twice(made), lock]
    return _twice(b"".join(counted))


def _transaction(data: bytes, at: int) -> tuple[dict, int]:
    start, version = at, int.from_bytes(data[at : at + 4], "little", signed=True)
    n, at = _varint(data, at + 4)
    inputs, outputs, sequences = [], [], []
    for vin in range(n):
        prev, index = data[at : at + 32], int.from_bytes(data[at + 32 : at + 36], "little")
        size, at = _varint(data, at + 36)
        inputs.append({"vin": vin, "prev": prev, "index": index, "script": data[at : at + size]})
        sequences.append(data[at + size : at + size + 4])
        at += size + 4
    n, at = _varint(data, at)
    for vout in range(n):
        value = int.from_bytes(data[at : at + 8], "little")
        size, at = _varint(data, at + 8)
        outputs.append({"vout": vout, "value": str(value), "script": data[at : at + size]})
        at += size
    at += 4
    if at > len(data):
        raise IndexError
    txid = _txid_of_version_3(inputs, sequences, outputs, data[at - 4 : at]) if version == 3 else _twice(data[start:at])
    return {"txid": txid, "version": version, "inputs": inputs, "outputs": outputs}, at


TRANSACTIONS = "height long, pos long, txid binary, version int, inputs array<struct<vin: int, prev: binary, index: long, script: binary>>, outputs array<struct<vout: int, value: string, script: binary>>"


def transactions(blocks: DataFrame, header: int = 80) -> DataFrame:
    """One row for each transaction in blocks (height, raw); a block that ends too early gives those before its end."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for height, raw in zip(frame["height"], frame["raw"], strict=True):
                rows = []
                try:
                    n, at = _varint(raw, header)
                    for pos in range(n):
                        tx, at = _transaction(raw, at)
                        rows.append({"height": height, "pos": pos, **tx})
                except IndexError:
                    pass
                yield pd.DataFrame(rows, columns=["height", "pos", "txid", "version", "inputs", "outputs"])

    return blocks.select("height", "raw").mapInPandas(read, TRANSACTIONS)


def index_bytes(index: Column) -> Column:
    """An output's number as references hold it: four bytes, little-endian."""
    pairs = F.lpad(F.hex(index.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(pairs, i, 2) for i in (7, 5, 3, 1)]))


def outputs_of(txs: DataFrame) -> DataFrame:
    """txid, vout, value, script, hashx: spendable outputs."""
    rows = txs.select("txid", "height", F.explode("outputs").alias("o"))
    flat = rows.select("txid", "height", "o.vout", F.col("o.value").cast("decimal(20,0)").alias("value"), "o.script")
    return flat.filter(~C.unspendable(F.col("script"))).withColumn("hashx", C.hashx(F.col("script")))


def inputs_of(txs: DataFrame) -> DataFrame:
    """txid, vin, prev, index: inputs that spend an output."""
    rows = txs.select("txid", "height", F.explode("inputs").alias("i")).select("txid", "height", "i.vin", "i.prev", "i.index")
    return rows.filter(~C.generation(F.col("prev"), F.col("index")))


@F.pandas_udf(T.IntegerType())
def state_separator(scripts: pd.Series) -> pd.Series:
    """Where the separator of state and code stands, 0 without one; null for a script that ends too early before it."""

    def find(script):
        at = 0
        try:
            for op, data in walk(script):
                if op == SEPARATOR:
                    return at
                at += 1 + WIDTHS.get(op, 0) + len(data)
        except IndexError:
            return None
        return 0

    return scripts.map(lambda s: None if s is None else find(bytes(s)))


def code_hash(script: Column) -> Column:
    """What scripts of the same code share, whatever their state: a SHA-256 of the script from its separator on."""
    return F.unhex(F.sha2(F.substr(script, state_separator(script) + 1), 256))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("value", T.DecimalType(20, 0)), T.StructField("script", T.BinaryType())])))
def price_terms(terms: pd.Series) -> pd.Series:
    """The outputs that an order asks to be paid: a counted list of up to 1000, or else one value and the rest its script; null if it is neither."""

    def listed(data):
        n, at = _varint(data, 0)
        found = []
        while len(found) < n <= 1000:
            value = int.from_bytes(data[at : at + 8], "little")
            size, at = _varint(data, at + 8)
            if at + size > len(data):
                raise IndexError
            found.append({"value": Decimal(value), "script": data[at : at + size]})
            at += size
        return found if at == len(data) else None

    def read(data):
        try:
            found = listed(data)
        except IndexError:
            found = None
        alone = [{"value": Decimal(int.from_bytes(data[:8], "little")), "script": data[8:]}] if len(data) > 8 else None
        return found or alone

    return terms.map(lambda t: None if t is None else read(bytes(t)))


def payment(terms: Column) -> Column:
    """total of what an order asks to be paid, and maker, the first standard payee's script; null if no terms can be read."""
    paid = price_terms(terms)
    total = F.aggregate(paid, F.lit(0).cast("decimal(38,0)"), lambda t, x: (t + x["value"]).cast("decimal(38,0)"))
    maker = F.get(F.filter(paid, lambda x: C.pays_to_key_hash(x["script"]).isNotNull()), F.lit(0))["script"]
    return F.when(paid.isNotNull(), F.struct(total.alias("total"), maker.alias("maker")))


def in_range(amount: Column) -> Column:
    """Whether a number of an order fits 64 bits without a sign."""
    return amount.cast("decimal(38,0)").between(0, Decimal(2**64 - 1))


def _check(payload: bytes) -> bytes:
    return _twice(payload)[:4]


@F.pandas_udf(T.StringType())
def base58check(payloads: pd.Series) -> pd.Series:
    def encode(payload):
        data = bytes(payload) + _check(bytes(payload))
        n, digits = int.from_bytes(data, "big"), ""
        while n:
            n, r = divmod(n, 58)
            digits = fixed.BASE58[r] + digits
        return fixed.BASE58[0] * (len(data) - len(data.lstrip(b"\0"))) + digits

    return payloads.map(lambda p: None if p is None else encode(p))


@F.pandas_udf(T.BinaryType())
def from_base58check(texts: pd.Series) -> pd.Series:
    """The payload, null if a digit or the check is wrong."""

    def decode(text):
        n = 0
        for c in text:
            if (d := fixed.BASE58.find(c)) < 0:
                return None
            n = n * 58 + d
        zeros = len(text) - len(text.lstrip(fixed.BASE58[0]))
        data = b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")
        return data[:-4] if len(data) > 4 and _check(data[:-4]) == data[-4:] else None

    return texts.map(lambda t: None if t is None else decode(t))
