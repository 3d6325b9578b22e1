"""Operator 3: benchmark decontamination.

The test items are the indexed side: a BM25 inverted index whose postings stand in blocks with their
largest impact. Every passage of every training document is a query against it, and all items that
score over the threshold come back, by block-max WAND. A retrieved item counts as leaked into the passage
if both its question and its answer overlap with it.

Scores are shares of the score that an item reaches against itself, so one threshold serves items of any
length. Passages are as long as two of the longest items and begin at every item's length, so that each
occurrence of an item lies within one. Before WAND runs on a passage, the rare terms of the items are looked up
for all words of a batch at once: an item whose rare terms do not add up with the rest to the threshold cannot
reach it.

The index is broadcast in blocks of items of a checked size (`block_bytes` of text; in a task it takes some sixty times
that); a larger benchmark is queried block by block, with the statistics of all items.

An item without fields of its own counts its first two thirds as question and the rest as answer.

Defined results: null or empty texts and items match nothing; items and documents that are repeated give a
row each; further columns are not looked at; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import kernels as K

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of question and of answer that must be in it.
SCORE, OVERLAP = 0.6, 0.6
#: Words in a row that question and answer are compared by.
GRAM = 3
#: Postings in a block.
BLOCK = 16
#: What the rare terms of an item must bring, at least, of its score before WAND is asked.
RARE = 0.25

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, case folded, and the first word of each text."""
    buf, off = K.flat(texts)
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    if len(buf):
        after = np.zeros(len(buf), bool)
        after[1:] = buf[:-1] == 0xC3  # Latin-1 capitals
        low[after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32
    starts, ends, first = K.spans(low, off, _BREAK)
    return K.word_hashes(low, starts, ends, 0), first


class Index:
    """Postings of a block of items, in the order of the items' numbers."""

    def __init__(self, ids: list, words: list[np.ndarray], df: dict[int, int], count: int, mean: float, longest: int):
        self.ids, self.words, self.longest = ids, words, longest
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.rare: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, w in enumerate(words):
            tf: dict[int, int] = defaultdict(int)
            for t in w.tolist():
                tf[t] += 1
            raw = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in tf.items()}
            total, rest = sum(raw.values()), 0.0
            for t, s in sorted(raw.items(), key=lambda x: (x[1], x[0])):
                postings[t].append((i, s / total))
                rest += s / total
                if rest > SCORE - RARE:
                    self.rare[t].append((i, s / total))
        self.postings = {t: ([i for i, _ in p], [s for _, s in p]) for t, p in postings.items()}
        self.blocks = {t: [max(s[k : k + BLOCK]) for k in range(0, len(s), BLOCK)] for t, (_, s) in self.postings.items()}
        self.top = {t: max(b) for t, b in self.blocks.items()}
        self.rare_terms = np.array(sorted(self.rare), dtype=K.U)
        flat = [(k, i, s) for k, t in enumerate(self.rare_terms.tolist()) for i, s in self.rare[t]]
        self.rare_first = np.searchsorted([k for k, _, _ in flat], np.arange(len(self.rare_terms) + 1))
        self.rare_item = np.array([i for _, i, _ in flat], dtype=np.int64)
        self.rare_score = np.array([s for _, _, s in flat])
        self.grams = [self._grams(w) for w in words]

    @staticmethod
    def _grams(w: np.ndarray) -> tuple[set, set]:
        cut = -(-2 * len(w) // 3)
        return grams(w[:cut]), grams(w[cut:])

    def search(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items that score `least` or more; query holds different terms."""
        cursors = [[self.postings[t], self.blocks[t], self.top[t], 0] for t in query if t in self.postings]
        found = []
        slack = 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0][0][c[3]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= least - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][0][cursors[pivot][3]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][3]] == item:
                pivot += 1
            ahead = cursors[: pivot + 1]
            for c in ahead:  # to the block that may hold the item
                items = c[0][0]
                while c[3] < len(items) and items[min((c[3] // BLOCK + 1) * BLOCK, len(items)) - 1] < item:
                    c[3] = (c[3] // BLOCK + 1) * BLOCK
            within = [c for c in ahead if c[3] < len(c[0][0])]
            if sum(c[1][c[3] // BLOCK] for c in within) >= least - slack:
                score = 0.0
                for c in within:
                    items = c[0][0]
                    while c[3] < len(items) and items[c[3]] < item:
                        c[3] += 1
                    if c[3] < len(items) and items[c[3]] == item:
                        score += c[0][1][c[3]]
                        c[3] += 1
                if score >= least - slack:
                    found.append((item, score))
            else:
                # no item before the end of the nearest of these blocks, or before the next list's item, can score enough
                edge = min((c[0][0][min((c[3] // BLOCK + 1) * BLOCK, len(c[0][0])) - 1] for c in within), default=item)
                beyond = edge + 1 if pivot + 1 >= len(cursors) else min(edge + 1, cursors[pivot + 1][0][0][cursors[pivot + 1][3]])
                beyond = max(beyond, item + 1)
                for c in within:
                    items = c[0][0]
                    while c[3] < len(items) and items[c[3]] < beyond:
                        c[3] += 1
            cursors = [c for c in cursors if c[3] < len(c[0][0])]
        return found

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, first word of the passage, score, question overlap, answer overlap), the best passage of each text and item."""
        words, first = terms(texts)
        if not len(words) or not len(self.rare_terms):
            return []
        at = np.minimum(np.searchsorted(self.rare_terms, words), len(self.rare_terms) - 1)
        hit = np.flatnonzero(self.rare_terms[at] == words)
        at = at[hit]
        number = self.rare_first[at + 1] - self.rare_first[at]
        posting = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(self.rare_first[at], number)
        place = np.repeat(hit, number)
        text = np.searchsorted(first, place, side="right") - 1
        stride = max(1, self.longest)
        # a passage begins every stride words; a word is in the one that begins last before it and in the one before that
        own = (place - first[text]) // stride
        best: dict[tuple[int, int], tuple] = {}
        tried: dict[tuple[int, int], list] = {}
        both = [np.flatnonzero(own >= back) for back in (0, 1)]
        rows = np.concatenate(both)
        key = np.stack([text[rows], np.concatenate([own[both[0]], own[both[1]] - 1]), self.rare_item[posting[rows]]], 1)
        if not len(key):
            return []
        word, score = words[place[rows]], self.rare_score[posting[rows]]
        order = np.lexsort((word, key[:, 2], key[:, 1], key[:, 0]))
        key, word, score = key[order], word[order], score[order]
        new, edge = np.ones(len(key), bool), np.ones(len(key), bool)
        edge[1:] = (key[1:] != key[:-1]).any(1)
        new[1:] = edge[1:] | (word[1:] != word[:-1])  # each different term counts once
        sums = np.add.reduceat(np.where(new, score, 0.0), np.flatnonzero(edge))
        for t, p, _ in key[edge][sums >= RARE - 1e-9].tolist():
            self._passage(words, first, t, p, stride, tried, best)
        return [(t, i, *v) for (t, i), v in sorted(best.items())]

    def _passage(self, words, first, t: int, p: int, stride: int, tried: dict, best: dict) -> None:
        if (t, p) in tried:
            return
        start = int(first[t]) + p * stride
        passage = words[start : min(start + 2 * stride, int(first[t + 1]))]
        tried[t, p] = self.search(sorted(set(passage.tolist())), SCORE)
        have = None
        for item, score in tried[t, p]:
            have = grams(passage) if have is None else have
            q, a = (len(g & have) / len(g) if g else 1.0 for g in self.grams[item])
            if q >= OVERLAP and a >= OVERLAP and ((t, item) not in best or best[t, item][1] < score):
                best[t, item] = (p * stride, score, q, a)


def grams(w: np.ndarray) -> set:
    """Runs of up to GRAM words; of a shorter text the one run that it is."""
    n = min(GRAM, len(w))
    w = w.tolist()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def indexes(items: DataFrame, block_bytes: int = 4_000_000) -> Iterator[Index]:
    """The index of the items, in blocks of about so many bytes of text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = terms(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item_id", "terms"])

    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size, count = known.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    listed = known.mapInArrow(rows, "item_id long, terms array<long>").filter(F.size("terms") > 0)
    # passages are measured by the longest of all items, so that results do not depend on how items are dealt to blocks
    full, mean, longest = listed.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("terms")), F.lit(1.0)), F.coalesce(F.max(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes))
    df = listed.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()
    for k in range(blocks):
        block = listed.filter(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == k)
        own = block.orderBy("item_id", "terms").toPandas()
        if not len(own):
            continue
        needed = block.select(F.explode("terms").alias("term")).distinct()
        counts = {int(np.int64(r.term).view(np.uint64)): r["count"] for r in df.join(needed, "term", "left_semi").collect()}
        words = [np.array(w, dtype=np.int64).view(K.U) for w in own["terms"]]
        yield Index([None if x != x else int(x) for x in own["item_id"].astype(object)], words, counts, full, mean, longest)


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, passage (its first word), score, question_overlap, answer_overlap: one row per document and item that is in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"

    def found(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in K.pieces(whole):
                    rows = index.value.leaks(batch.column(1))
                    ids = batch.column(0).to_pylist()
                    columns = [[ids[r[0]] for r in rows], [index.value.ids[r[1]] for r in rows], *[[r[k] for r in rows] for k in range(2, 6)]]
                    kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(run, schema)

    parts = [found(spark.sparkContext.broadcast(index)) for index in indexes(items)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in whose text no item is."""
    for index in indexes(items):
        docs = _clean(docs, spark.sparkContext.broadcast(index))
    return docs


def _clean(docs: DataFrame, index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                bad = {r[0] for r in index.value.leaks(batch.column(batch.schema.get_field_index("text")))}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)]))

    return docs.mapInArrow(run, docs.schema)
