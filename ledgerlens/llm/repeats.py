"""Windows that occur more than once anywhere in a corpus: what the substring operators stand on.

A text is a row of symbols (bytes, or words); a window is `n` symbols in a row. All windows that occur
again are found exactly, without a row for each window:

1. Anchors. Of the `k`-grams in a window the one with the least hash is its anchor. Equal windows have equal
   anchors, so a window whose anchor occurs once in the corpus occurs once; about one symbol in (n - k) / 2 is
   an anchor, and only anchors are shuffled.
2. Runs. The windows of one anchor stand side by side and are handled together. A first pass settles most runs
   whole: by the span of all their windows (substrings.py) or by prefix doubling (doubling.py).
3. What is still open is cut into blocks of ever fewer windows, and with it the settled runs of the same
   anchor, which may hold an open window's equal. A block whose whole occurs again is settled as repeated; one
   whose core (the part that all its windows share) occurs nowhere else has no repeated window. In the end a block is
   a window, and its whole is its core.

Names of spans are two independent 64-bit hashes of the symbols. Each step is a job over the table of
different texts joined to lists of positions by text; no list is longer than its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import kernels as K
from ledgerlens.llm.common import cut, meet, release

Symbols = Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]


def bytes_of(texts: pa.Array, lane: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = K.flat(texts)
    return K.byte_symbols(buf, lane), off


def words_of(texts: pa.Array, lane: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = K.flat(texts)
    starts, ends, first = K.spans(buf, off)
    return K.word_hashes(buf, starts, ends, lane), first


@dataclass(frozen=True)
class Repeats:
    """symbols: what a text is made of; n: symbols in a window; k: in an anchor; blocks: windows in a block, step by step, the last 1."""

    symbols: Symbols
    n: int
    k: int
    blocks: tuple[int, ...] = (1,)

    def __post_init__(self) -> None:
        if not (0 < self.k <= self.n and self.n - self.k < 256 and self.blocks[-1] == 1):
            raise ValueError("an anchor is within its window, 255 places from its ends at most, and the last blocks are of one window")

    def runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: its text, its place, the first and last window of it (all within the text), and its name."""
        sym, off = self.symbols(texts, 0)
        h = K.window_hash(K.prefix(sym, 0), self.k, 0)
        inside = K.windows_inside(off, self.n)
        if not len(inside):
            z = np.zeros(0, np.int64)
            return z, z, z, z, z
        anchor = K.sliding_argmin(h, self.n - self.k + 1)[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(inside)) - 1
        s, e, a = inside[first], inside[last], anchor[first]
        text = np.searchsorted(off, s, side="right") - 1
        base = off[text]
        return text, a - base, s - base, e - base, h[a].view(np.int64)

    def anchors(self, texts: DataFrame, lanes: int = 1) -> DataFrame:
        """name (and name2), key, place (at << 32 | number in the text), lead (at - s << 8 | at - e) for every anchor."""
        names = ["name", "name2"][:lanes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in K.pieces(whole):
                    text, at, s, e, name = self.runs(batch.column(1))
                    number = np.arange(len(text)) - np.searchsorted(text, text)
                    own = [pa.array(name)]
                    if lanes > 1:
                        sym, off = self.symbols(batch.column(1), 1)
                        own.append(pa.array(K.span_hash(K.prefix(sym, 1), off[text] + at, off[text] + at + self.k, 1).view(np.int64)))
                    rest = [batch.column(0).take(pa.array(text)), pa.array(at << 32 | number), pa.array((at - s) << 8 | (at - e), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*own, *rest], names=[*names, "key", "place", "lead"])

        return texts.select("key", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", key long, place long, lead int")

    def spans(self, texts: DataFrame, lists: DataFrame) -> DataFrame:
        """name, w1, w2, key, at, s, e: the whole of the windows s to e of the anchors that the lists (key, ats) name."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in K.pieces(whole):
                    text, at, s, e, name = self.runs(batch.column(1))
                    flat, row = unlist(batch.column(2))
                    wanted = np.sort(row.astype(np.int64) << 32 | flat)
                    have = text << 32 | at
                    found = wanted[np.minimum(np.searchsorted(wanted, have), max(len(wanted) - 1, 0))] == have if len(wanted) else np.zeros(len(have), bool)
                    text, at, s, e, name = text[found], at[found], s[found], e[found], name[found]
                    w = self._names(batch.column(1), text, s, e + self.n, at - s)
                    yield pa.RecordBatch.from_arrays([pa.array(name), *w, batch.column(0).take(pa.array(text)), *[pa.array(x, pa.int32()) for x in (at, s, e)]], names=["name", "w1", "w2", "key", "at", "s", "e"])

        return joined(texts, lists).select("key", "text", "ats").mapInArrow(run, "name long, w1 long, w2 long, key long, at int, s int, e int")

    def split(self, texts: DataFrame, lists: DataFrame, size: int) -> DataFrame:
        """name, w1, w2, key, at, s, e, known: the blocks of `size` windows that the runs in lists (key, runs) fall into, with
        a name for their core and one for their whole; known: all windows of the run are settled already."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in K.pieces(whole):
                    runs, row = unlist(batch.column(2))
                    at, s, e = (runs.field(x).to_numpy().astype(np.int64) for x in ("at", "s", "e"))
                    known = runs.field("again").to_numpy(zero_copy_only=False)
                    # blocks end at multiples of size before the anchor, so equal surroundings are cut alike
                    low, high = (at - e) // size, (at - s) // size
                    count = high - low + 1
                    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                    text, at, s, e, known = (np.repeat(x, count) for x in (row, at, s, e, known))
                    last = at - b * size
                    w = self._names(batch.column(1), text, np.maximum(s, last - size + 1), np.minimum(e, last) + self.n, b)
                    # the core of the block as it would be uncut lies in every window that is left of it
                    c = self._names(batch.column(1), text, last, last - size + 1 + self.n, b)[0] if size > 1 else w[0]
                    s, e = np.maximum(s, last - size + 1), np.minimum(e, last)
                    yield pa.RecordBatch.from_arrays([c, *w, batch.column(0).take(pa.array(text)), *[pa.array(x, pa.int32()) for x in (at, s, e)], pa.array(known)], names=["name", "w1", "w2", "key", "at", "s", "e", "known"])

        return joined(texts, lists).select("key", "text", "runs").mapInArrow(run, "name long, w1 long, w2 long, key long, at int, s int, e int, known boolean")

    def _names(self, texts: pa.Array, text: np.ndarray, s: np.ndarray, e: np.ndarray, lead: np.ndarray) -> list[pa.Array]:
        """Two hashes of the symbols [s, e) of each text; the anchor's place in them counts too."""
        out = []
        for lane in (0, 1):
            sym, off = self.symbols(texts, lane)
            base = off[text]
            h = K.span_hash(K.prefix(sym, lane), base + s, base + e, lane)
            out.append(pa.array(K.mix(h + lead.astype(K.U)).view(np.int64)))
        return out

    def find(self, spark: SparkSession, texts: DataFrame, first: Callable[[SparkSession, Repeats, DataFrame, str], DataFrame], name: str) -> DataFrame:
        """key, runs (s, e): all windows s to e of the text that occur again in these texts; texts without any are left out.

        first: makes name, key, at, s, e, again, first for the windows s to e of every anchor that may occur again;
        again: all of them do; first: whether it stands for all rows with the same symbols (true where that is not known).
        """
        rows = cut(spark, first(spark, self, texts, name), f"{name}-runs")
        release(spark)
        settled = [rows.filter("again").select("key", "s", "e")]
        for step, size in enumerate(self.blocks):
            # of settled rows with the same whole one is enough to meet open windows in
            open_ = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("again")).alias("open")).filter("n > 1 and open").select("name", "n")
            open_ = cut(spark, open_, f"{name}-open{step}")
            lists = meet(rows.filter("first or not again"), open_, ["name"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("at", "s", "e", "again")).alias("runs"))
            blocks = cut(spark, self.split(texts, lists, size), f"{name}-blocks{step}")
            release(spark)
            if size > 1:
                rows = cut(spark, flagged(blocks).withColumn("again", F.col("again") | F.col("known")), f"{name}-rows{step}")
                settled.append(rows.filter("again and not known").select("key", "s", "e"))
            else:
                again = cut(spark, twice(blocks).select("w1", "w2", "n"), f"{name}-again{step}")
                settled.append(meet(blocks.filter("not known"), again, ["w1", "w2"], "left_semi").select("key", "s", "e"))
        every = settled[0]
        for more in settled[1:]:
            every = every.unionByName(more)
        return every.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("runs"))


def twice(rows: DataFrame) -> DataFrame:
    """w1, w2, n, one: the wholes that occur more than once, how often, and a number of the row that stands for them."""
    return rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("key", "s")).alias("one")).filter("n > 1").select("w1", "w2", "n", "one")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with `again`, which tells if their whole (w1, w2) occurs more than once, and `first`, of one of its rows."""
    found = meet(rows, cut(rows.sparkSession, twice(rows), "twice"), ["w1", "w2"], "left").withColumn("again", F.col("one").isNotNull())
    return found.withColumn("first", F.coalesce(F.xxhash64("key", "s") == F.col("one"), F.lit(True))).drop("w1", "w2", "one")


def joined(texts: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Texts stay in their buckets; the lists come to them and are what is hashed."""
    return texts.join(lists.hint("shuffle_hash"), "key", how)


def unlist(lists: pa.Array) -> tuple[np.ndarray | pa.Array, np.ndarray]:
    """All elements in a row, and the row of the batch that each comes from."""
    length = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    return (flat if pa.types.is_struct(flat.type) else flat.to_numpy().astype(np.int64)), np.repeat(np.arange(len(lists)), length)


def covered(length: int, runs: np.ndarray, n: int) -> np.ndarray:
    """Which of a text's symbols stand in any window of the runs (s, e)."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1] + n, -1)
    return np.cumsum(edge[:-1]) > 0
