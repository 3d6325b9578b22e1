"""Scripts that bind how an output may be spent: sales with royalties, and the outputs of prediction markets."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import columns as C
from ledgerlens.functions.scripts import RETURN, SEPARATOR, SINGLETON, walk

#: Royalties of a sale, bytes of a push in it, and the greatest value of an output.
ROYALTIES, LONGEST_PUSH, GREATEST = 32, 10_000, 2**64 - 1
#: Opcodes of a sale in the order of their places; None is a push or a number.
CANCEL = [SINGLETON, 0x75, 0x63, 0x76, 0xA9, None, 0x88, 0xAC, 0x67]
PAID = [None, 0xCD, None, 0x88, None, 0xCC, None, 0xA2, 0x69]
END = [0x51, 0x68]
#: Bytes of a market's state, without and with its optimistic part, and the state of an anchor.
STATE, STATE_OPTIMISTIC, ANCHOR = 42, 102, bytes(20)

Step = tuple[int, bytes]


def _follows(steps: list[Step], form: list[int | None]) -> bool:
    return len(steps) == len(form) and all(want is None or op == want for (op, _), want in zip(steps, form, strict=True))


def _number(step: Step) -> int | None:
    op, data = step
    if 0x51 <= op <= 0x60:
        return op - 0x50
    if op == 0x4F:
        return -1
    if op > 0x4E:
        return None
    n = int.from_bytes(data, "little")
    sign = 1 << (8 * len(data) - 1) if data else 0
    return sign - n if n & sign else n


def _paid(steps: list[Step]) -> tuple[int, bytes, int] | None:
    """Which output must pay, to which script, and at least how much."""
    if not _follows(steps, PAID) or not 1 <= steps[2][0] <= 0x4E or max(len(data) for _, data in steps) > LONGEST_PUSH:
        return None
    output, again, value = (_number(steps[i]) for i in (0, 4, 6))
    fits = output is not None and output == again and value is not None and 1 <= value <= GREATEST
    return (output, steps[2][1], value) if fits else None


def _sale(script: bytes) -> dict | None:
    try:
        steps = list(walk(script))
    except IndexError:
        return None
    head, body, end = steps[: len(CANCEL)], steps[len(CANCEL) : -2], steps[-2:]
    parts = [body[i : i + len(PAID)] for i in range(0, len(body), len(PAID))]
    if not (_follows(head, CANCEL) and _follows(end, END) and len(head[5][1]) == 20 and 2 <= len(parts) <= 1 + ROYALTIES):
        return None
    paid = [_paid(p) for p in parts]
    if None in paid or paid[0][0] != 0 or any(p[0][0] == END[0] for p in parts):
        return None
    (_, seller, price), *others = paid
    royalties = [{"script": to, "value": Decimal(value)} for _, to, value in others]
    return {"ref": head[0][1], "canceller": head[5][1], "seller": seller, "price": Decimal(price), "royalties": royalties}


SALE = T.StructType(
    [
        T.StructField("ref", T.BinaryType()),
        T.StructField("canceller", T.BinaryType()),
        T.StructField("seller", T.BinaryType()),
        T.StructField("price", T.DecimalType(20, 0)),
        T.StructField("royalties", T.ArrayType(T.StructType([T.StructField("script", T.BinaryType()), T.StructField("value", T.DecimalType(20, 0))]))),
    ]
)


@F.pandas_udf(SALE)
def _read_sale(scripts: pd.Series) -> pd.DataFrame:
    rows = [(None if s is None else _sale(bytes(s))) or {} for s in scripts]
    return pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype=object) for f in SALE.fieldNames()})


def royalty_sale(script: Column) -> Column:
    """ref, canceller (a key's hash), seller's script, price and royalties of a sale; null for a script of any other form."""
    read = _read_sale(script)
    return F.when(read["ref"].isNotNull(), read)


def stateful(script: Column) -> Column:
    """state and code of a script that begins with one push of state and the separator, null for others."""
    text = F.hex(script)
    byte = lambda i: F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("int")
    first = byte(0)
    at = F.when(first.between(1, 0x4B), 1).when(first == 0x4C, 2).when(first == 0x4D, 3)
    size = F.when(first < 0x4C, first).when(first == 0x4C, byte(1)).otherwise(byte(1) + 256 * byte(2))
    part = lambda start, n: F.substr(script, start + F.lit(1), n)
    parted = F.hex(part(at + size, F.lit(1))) == f"{SEPARATOR:02X}"
    return F.when(parted, F.struct(part(at, size).alias("state"), F.substr(script, at + size + F.lit(2)).alias("code")))


def market_state(script: Column) -> Column:
    """status, expiry, grace, oracle, optimistic and code of a market's own output, null if it is none."""
    held = stateful(script)
    state, size = held["state"], F.octet_length(held["state"])
    number = lambda at: C.little_endian(F.substring(state, at, 4), 4).cast("long")
    status = F.conv(F.hex(F.substring(state, 1, 1)), 16, 10).cast("int")
    fields = [status.alias("status"), number(2).alias("expiry"), number(6).alias("grace"), F.substring(state, 10, 33).alias("oracle"), (size == STATE_OPTIMISTIC).alias("optimistic"), held["code"].alias("code")]
    return F.when(size.isin(STATE, STATE_OPTIMISTIC), F.struct(*fields))


def anchors(script: Column, share: Column, market: Column) -> Column:
    """Whether an output anchors a market's share: an empty state, and code that names both."""
    held = stateful(script)
    return F.coalesce((held["state"] == F.lit(ANCHOR)) & F.contains(held["code"], share) & F.contains(held["code"], market), F.lit(False))


def may_announce(script: Column) -> Column:
    """A quick test before a script is cut: whether it carries data only."""
    return F.substring(F.hex(script), 1, 2) == f"{RETURN:02X}"
