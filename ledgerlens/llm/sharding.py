"""Operator 7: shards near equal in bytes, in DataFrame functions only.

Groups of equal texts stay together and are ordered: those larger than a fair share first, by
size, then all others by the SHA-256 of their text. The order is cut into contiguous shards whose
largest is as small as any contiguous cut of that order allows: a binary search over the capacity, each
step checking greedily. Within that capacity shards end near what is left for each.

The search runs on sums over ranges of the order, at most a bounded number of them on the
driver. Ranges in which a cut can fall are looked into, found again by a join on their number, until the
bounds on the capacity meet; it is exact. Places within a shard come from counts by (shard, part), so
no shard meets in one task.

Defined results: a null text has no bytes, its CRC-32 is 0, and it is equal to an empty text; each row
gets its own place, rows that repeat a doc_id and null doc_ids included; further columns are not
looked at; an empty table gives no rows. With fewer groups than shards some shards stay empty. Texts are known by 60
bits of their SHA-256: should two different ones ever agree there, they would share a shard, and nothing else.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut

#: Fixed by the contract: what a row costs besides its text.
ROW_BYTES = 16
#: Bits of the order key (15 hexadecimal digits of the SHA-256).
KEY_BITS = 60
#: Ranges of the order that one job brings to the driver, about.
RANGES = 1 << 16
#: Least number of parts a shard is counted in, and the rows a part should hold.
PARTS, PART_ROWS = 256, 250_000


def sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        *([F.struct(*keep).alias("row")] if keep else []),
    )


def filled(sums: list[int], capacity: int, shards: int, start: int = 0, fluid: list[bool] | None = None) -> list[int]:
    """How far shards that are filled greedily come, as sums over the order; what is fluid can be cut anywhere."""
    ends, total = [], sums[-1]
    while start < total and len(ends) < shards:
        to = min(start + capacity, total)
        at = bisect_right(sums, to) - 1
        if not (fluid and to < total and fluid[at]):
            to = sums[at]
        if to <= start:
            break
        ends.append(to)
        start = to
    return ends


def fits(sums: list[int], capacity: int, shards: int, start: int = 0, fluid: list[bool] | None = None) -> bool:
    ends = filled(sums, capacity, shards, start, fluid)
    return start >= sums[-1] or bool(ends) and ends[-1] == sums[-1]


def least_capacity(weights: list[int], shards: int, least: int = 1, fluid: list[bool] | None = None) -> int:
    """The smallest capacity, `least` at least, with which the units, in order, fit into the shards."""
    if not weights:
        return 0
    sums = [0, *accumulate(weights)]
    low, high = max(least, -(-sums[-1] // shards)), max(least, sums[-1])
    while low < high:
        mid = (low + high) // 2
        if fits(sums, mid, shards, fluid=fluid):
            high = mid
        else:
            low = mid + 1
    return low


def balanced_cuts(weights: list[int], shards: int, capacity: int) -> list[int]:
    """For each shard the number of units up to its end: never over the capacity, near what is left a shard."""
    sums, at, ends = [0, *accumulate(weights)], 0, []
    for left in range(shards, 0, -1):
        fair = sums[at] + (sums[-1] - sums[at]) // left
        farthest = bisect_right(sums, sums[at] + capacity) - 1
        to = min(max(bisect_right(sums, fair) - 1, at + 1), farthest)
        if to < farthest and sums[to + 1] - fair < fair - sums[to]:
            to += 1
        while to < farthest and not fits(sums, capacity, left - 1, sums[to]):
            to += 1
        at = len(weights) if left == 1 else to
        ends.append(at)
    return ends


@dataclass(frozen=True, order=True)
class Unit:
    """Groups of the order that stand side by side: all of one range of 2**shift keys (or one large group)."""

    place: tuple[int, int]
    last: int
    bytes: int
    groups: int
    shift: int


def _units(groups: DataFrame, shift: int) -> list[Unit]:
    found = groups.groupBy(F.shiftright("key", shift).alias("range")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("bytes").alias("w"), F.count(F.lit(1)).alias("n"))
    return [Unit((1, r.a), r.b, r.w, r.n, shift) for r in found.collect()]


def _open(units: list[Unit], shards: int, largest: int) -> tuple[list[Unit], int]:
    """Units that must be looked into before the least capacity is known for sure, and the capacity that surely does.

    The capacity lies between what would do if units of several groups could be cut anywhere and what does if they
    cannot be cut. A shard's end moves on with the capacity, so for all capacities between it lies between the ends of
    uncut units at the low one and of fluid units at the high one. Units of several groups there are open.
    """
    weights, several = [u.bytes for u in units], [u.groups > 1 for u in units]
    sums = [0, *accumulate(weights)]
    high = least_capacity(weights, shards, largest)
    heavy = [u for u in units if u.groups > 1 and u.bytes * RANGES > 4 * sums[-1]]
    if heavy:
        return heavy, high
    low = least_capacity(weights, shards, largest, several)
    if low == high:
        return [], high
    near = filled(sums, low, shards - 1)
    far = filled(sums, high, shards - 1, fluid=several)
    found: set[int] = set()
    for i, to in enumerate(far):
        first = near[min(i, len(near) - 1)] if near else 0
        found.update(k for k in range(bisect_right(sums, first) - 1, min(bisect_right(sums, to), len(units))) if several[k])
    return [units[k] for k in sorted(found)], high


def cuts(groups: DataFrame, shards: int, large: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """For every shard the place of its last group: (0, number among the large ones) or (1, key).

    large: (key, bytes) of the groups that stand first in the order; groups: all others, in the order of their keys.
    """
    first = [Unit((0, i), i, w, 1, 0) for i, (_, w) in enumerate(large)]
    largest = max([w for _, w in large], default=0) or groups.agg(F.coalesce(F.max("bytes"), F.lit(1))).first()[0]
    units = first + sorted(_units(groups, KEY_BITS - RANGES.bit_length() + 1))
    while True:
        found, capacity = _open(units, shards, largest)
        if not found:
            break
        shift = max(u.shift for u in found)  # one level at a time, so that one equality finds the groups
        found = [u for u in found if u.shift == shift]
        listed = F.lit(",".join(str(u.place[1] >> shift) for u in found))
        ids = groups.sparkSession.range(1).select(F.explode(F.split(listed, ",").cast("array<long>")).alias("range"))
        finer = max(0, shift - max(1, (RANGES // len(found)).bit_length() - 1))
        within = groups.withColumn("range", F.shiftright("key", shift)).join(ids, "range", "left_semi").drop("range")
        units = sorted(set(units) - set(found)) + _units(within, finer)
        units.sort()
    ends = balanced_cuts([u.bytes for u in units], shards, capacity)
    return [(units[e - 1].place[0], units[e - 1].last) if e else (0, -1) for e in ends]


def _numbered(ends: list[int], start: int) -> Column:
    """The number of the first end that the key does not exceed: a search tree, as deep as the logarithm of the shards."""
    if not ends:
        return F.lit(start)
    half = len(ends) // 2
    return F.when(F.col("key") <= ends[half], _numbered(ends[:half], start)).otherwise(_numbered(ends[half + 1 :], start + half + 1))


def shard(spark: SparkSession, docs: DataFrame, shards: int = 40, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, and the columns in keep."""
    rows = cut(spark, sizes(docs, keep or []), "sizes")
    groups = cut(spark, rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    # groups over the fair share of what is left stand first; there are fewer of these than shards
    large = []
    if count:
        for g in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
            if g.bytes * (shards - len(large)) <= total:
                break
            large.append((g.key, g.bytes))
            total -= g.bytes
    rest = groups.filter(~F.col("key").isin([k for k, _ in large])) if large else groups
    ends = cuts(rest, shards, large)[:-1]
    inside = [last for kind, last in ends if kind]
    number = _numbered(inside, len(ends) - len(inside))
    for i, (key, _) in enumerate(large):
        number = F.when(F.col("key") == key, sum(kind == 0 and last < i for kind, last in ends)).otherwise(number)
    return placed(rows.withColumn("shard", number.cast("int")), shards, bool(keep))


def placed(rows: DataFrame, shards: int, keep: bool) -> DataFrame:
    parts = max(PARTS, -(-rows.count() // (shards * PART_ROWS)))
    part: Column = F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int")
    rows = rows.withColumn("part", part)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # shards * parts rows at most
    offsets = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    return (
        rows.withColumn("place", place)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row.*"] if keep else []))
    )
