"""Operators 5 and 9: removal of repeated windows of words, and of repeated strings of bytes.

Both remove every symbol that a window covers which occurs anywhere else, in the same document too, judged on
the input. They differ in how windows come under suspicion:

* words (5), a count-min prefilter: every task sketches how often the anchors of its windows occur, in ROWS rows of
  cells; the sketches are merged block by block, by adding cells, all over the cluster. An anchor's estimate is the least of
  its cells, one in each row. A window cannot occur more often than its anchor (repeats.py) and a sketch only
  overestimates, so what is estimated at two or more holds every repeated window, and is grouped exactly. The sketch is
  as wide as the corpus has anchors, times CELLS to twice that: of anchors that occur once, 1.4% at most are taken for more.
  Windows of one anchor stand side by side; if all that they cover occurs twice with the same extent around the
  anchor, all of them do.
* bytes (9), prefix doubling on sampled positions: see doubling.py.

Texts that are equal are looked at once. If there are two or more of them and they have a window at all,
all their symbols go.

Defined results: a null text is an empty one: nothing to remove, and the digest is that of no bytes; each row
gets the result of its text, rows that repeat a doc_id and null doc_ids included; further columns are not looked at;
an empty table gives no rows. One text is held in memory by the task that reads it, some fifty times its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import kernels as K
from ledgerlens.llm.common import cut, digest, distinct_texts, meet, release
from ledgerlens.llm.repeats import Repeats, bytes_of, covered, flagged, joined, words_of

#: Rows of the sketch, its cells for each anchor in each row at least, and the cells that are merged together.
ROWS, CELLS, BLOCK = 2, 8, 1 << 16
#: Anchors that a task sketches at once.
SKETCHED = 4_000_000
#: The SHA-256 of nothing.
EMPTY = hashlib.sha256(b"").hexdigest()


def cell(row: int, bits: int) -> Column:
    """The anchor's cell in a row of 2**bits: the lowest bits of its name in row 0, the highest in row 1."""
    return F.col("name").bitwiseAND(F.lit((1 << bits) - 1)) if row == 0 else F.shiftrightunsigned("name", 64 - bits)


def sketched(names: DataFrame, bits: int) -> DataFrame:
    """row, block, cells, counts: the sketches of the tasks, cut into blocks; of a block the cells that are not zero (uint16) and their counts (uint32)."""

    def sketch(names: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(names) if names else np.zeros(0, np.uint64)
        for row in range(ROWS):
            cells, counts = np.unique(every & np.uint64((1 << bits) - 1) if row == 0 else every >> np.uint64(64 - bits), return_counts=True)
            block = (cells // np.uint64(BLOCK)).astype(np.int64)
            found, first = np.unique(block, return_index=True)
            ends = np.append(first, len(cells)).astype(np.int32)
            binary = lambda x, size: pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends * np.int32(size)), pa.py_buffer(x)])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), row, np.int32)), pa.array(found), binary((cells % np.uint64(BLOCK)).astype(np.uint16), 2), binary(counts.astype(np.uint32), 4)],
                names=["row", "block", "cells", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[np.ndarray] = []
        for batch in batches:
            have.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, have)) > SKETCHED:
                yield from sketch(have)
                have.clear()
        yield from sketch(have)

    return names.mapInArrow(run, "row int, block long, cells binary, counts binary")


def merged(sketches: DataFrame) -> DataFrame:
    """row, cell, n: the cells of the sum of all sketches that are two or more. A block's cells are added up in one dense array."""

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for part in parts:
            for cells, counts in zip(part.column("cells"), part.column("counts"), strict=True):
                total[np.frombuffer(cells.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        found = np.flatnonzero(total > 1)
        row, block = (k.as_py() for k in key)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row, np.int32)), pa.array(block * BLOCK + found), pa.array(total[found])], names=["row", "cell", "n"])

    return sketches.groupBy("row", "block").applyInArrow(add, "row int, cell long, n long")


def by_sketch(spark: SparkSession, repeats: Repeats, texts: DataFrame, name: str) -> DataFrame:
    """The runs of the anchors that are estimated at two or more, settled if their whole span occurs again."""
    anchors = cut(spark, repeats.anchors(texts).select("name", "key", F.shiftright("place", 32).cast("int").alias("at")), f"{name}-anchors")
    bits = max(16, (max(1, anchors.count()) * CELLS - 1).bit_length())
    often = cut(spark, merged(sketched(anchors.select("name"), bits)), f"{name}-sketch")
    suspects = anchors
    for row in range(ROWS):
        # the least of an anchor's cells is two or more if all are
        found = meet(suspects.withColumn("cell", cell(row, bits)), often.filter(F.col("row") == row).drop("row"), ["cell"], "left_semi").drop("cell")
        suspects = cut(spark, found, f"{name}-row{row}")
    lists = cut(spark, suspects.groupBy("key").agg(F.collect_list("at").alias("ats")), f"{name}-suspects")
    release(spark)
    return flagged(cut(spark, repeats.spans(texts, lists), f"{name}-spans"))


def removed_words(spark: SparkSession, docs: DataFrame, n: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    texts = distinct_texts(spark, docs, "words")
    runs = Repeats(words_of, n, n // 2 + 1, (6, 1)).find(spark, texts, by_sketch, "words")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                out = []
                for text, found in zip(batch.column(1), batch.column(2), strict=True):
                    data = text.as_py().encode()
                    buf = np.frombuffer(data, np.uint8)
                    starts, ends, _ = K.spans(buf, np.array([0, len(buf)]))
                    gone = _gone(len(starts), found, n)
                    kept = b" ".join(data[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
                    out.append((len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                yield _batch(batch, out, ["n_words", "n_removed", "kept_sha256"])

    found = _per_row(spark, docs, texts, runs, rows, "n_words long, n_removed long, kept_sha256 string")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= n)
    return found.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, EMPTY).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def removed_bytes(spark: SparkSession, docs: DataFrame, n: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    from ledgerlens.llm.doubling import by_doubling

    texts = distinct_texts(spark, docs, "bytes")
    runs = Repeats(bytes_of, n, n // 2 + 1, (12, 1)).find(spark, texts, by_doubling, "bytes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                out = []
                for text, found in zip(batch.column(1), batch.column(2), strict=True):
                    buf = np.frombuffer(text.as_py().encode(), np.uint8)
                    gone = _gone(len(buf), found, n)
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((len(buf), int(gone.sum()), spans, hashlib.sha256(buf[~gone].tobytes()).hexdigest()))
                yield _batch(batch, out, ["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _per_row(spark, docs, texts, runs, rows, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= n)
    all_of_it = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(EMPTY)}
    return found.select("doc_id", "n_bytes", *[F.when(whole, value).otherwise(F.col(c)).alias(c) for c, value in all_of_it.items()])


def _gone(length: int, found: pa.Scalar, n: int) -> np.ndarray:
    if not found.is_valid:
        return np.zeros(length, bool)
    runs = found.values
    return covered(length, np.stack([runs.field(x).to_numpy() for x in ("s", "e")], 1), n)


def _batch(batch: pa.RecordBatch, out: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["digest", *names])


def _per_row(spark: SparkSession, docs: DataFrame, texts: DataFrame, runs: DataFrame, rows, schema: str) -> DataFrame:
    """The result of each text and how many rows have it, for each row that has it."""
    results = cut(spark, joined(texts, runs, "left").select("digest", "text", "runs").mapInArrow(rows, f"digest binary, {schema}"), "removed")
    release(spark)
    keyed = cut(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    copies = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    of_text = cut(spark, results.join(copies, "digest").withColumn("copies", F.col("n")), "results")
    return meet(keyed, of_text, ["digest"]).drop("digest")
