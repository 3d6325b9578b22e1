"""Operator 1: token counts.

Pieces are counted once per distinct pre-token, by the tokenizer's library; a document's
count is the sum over its pre-token frequencies. No ids are made for any document.

Two routes lead from a document's pre-tokens to their piece counts. The pre-tokens of the
highest corpus frequency, `frequent` of them at most, go to every task; what remains is
joined by key. Both hold counts made once from the same vocabulary table, so where the line
falls changes no result.

Defined results: a null or empty text has 0 bytes and 0 tokens; each row gets its own result,
rows that repeat a doc_id and null doc_ids included; further columns are not looked at.
"""

from __future__ import annotations

import functools
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, release

#: Fixed value: how the byte-level tokenizer cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these, the library and the regex module may class a code point by other Unicode versions.
_AGREED = re.compile("[^\x00-՗ -⁯]")
#: Entries of a task's own tally before it is passed on.
TALLY = 100_000


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> tuple[str, ...]:
    """The strings that the library takes for one token each, wherever they stand."""
    tokenizer = _tokenizer(path)
    if type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.normalizer is not None:
        raise ValueError("token counts by pre-token need a byte-level tokenizer without a normalizer")
    return tuple(sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True))


@functools.cache
def _patterns(special: tuple[str, ...]):
    return regex.compile(PATTERN), re.compile("|".join(map(re.escape, special)) or "(?!)")


def pre_tokens(text: str, path: str, special: tuple[str, ...]) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special tokens stand in it. The library is loaded only where it is needed."""
    pattern, specials = _patterns(special)
    parts = specials.split(text)
    found: list[str] = []
    for part in parts:
        if _AGREED.search(part):
            found += [part[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
        else:
            found += pattern.findall(part)
    return found, len(parts) - 1


def _rows(tally: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["piece", "n"])


def vocabulary(spark: SparkSession, docs: DataFrame, path: str, special: tuple[str, ...]) -> DataFrame:
    """piece, n (occurrences in the corpus), tokens (what the library makes of it)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen.update(pre_tokens(text.as_py(), path, special)[0])
                if len(seen) > TALLY:
                    yield _rows(seen)
                    seen.clear()
        yield _rows(seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                ids = tokenizer.encode_batch(part.column(0).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x.ids) for x in ids], pa.int32())], names=["piece", "n", "tokens"])

    pieces = docs.select("text").mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return cut(spark, pieces.mapInArrow(count, "piece string, n long, tokens int"), "vocabulary")


def bound_for(vocab: DataFrame, frequent: int) -> int:
    """The least corpus frequency that no more than `frequent` pre-tokens reach."""
    sizes = vocab.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).collect()
    total, least = 0, 2**62
    for row in sorted(sizes, key=lambda r: -r.b):
        total += row.k
        if total > frequent:
            break
        least = row.low
    return least


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = 1024, frequent: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    special = special_strings(path)
    vocab = vocabulary(spark, docs, path, special)
    release(spark)
    least = bound_for(vocab, frequent)
    known = dict(vocab.filter(F.col("n") >= least).select("piece", "tokens").toPandas().itertuples(index=False, name=None))
    shared = spark.sparkContext.broadcast(known)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            rows: list[tuple] = []
            for row, doc, text in zip(*batch.columns, strict=True):
                row, doc, text = row.as_py(), doc.as_py(), text.as_py()
                found, total = pre_tokens(text or "", path, special)
                counts = list(map(get, found))
                size = len((text or "").encode())
                if None in counts:
                    rest = Counter(p for p, c in zip(found, counts, strict=True) if c is None)
                    total += sum(c for c in counts if c is not None)
                    for piece, n in rest.items():
                        rows.append((row, doc, size, piece, n, total))
                        total = 0
                else:
                    # no such pre-token: the row number only deals these rows out evenly
                    rows.append((row, doc, size, f"\0{row}", 0, total + sum(counts)))
                if len(rows) > 20_000:
                    yield _table(rows)
                    rows = []
            yield _table(rows)

    rest = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(weigh, "row long, doc_id long, n_bytes long, piece string, k long, known long")
    rare = vocab.filter(F.col("n") < least).select("piece", "tokens")
    counted = F.sum(F.col("known") + F.col("k") * F.coalesce("tokens", F.lit(0)))
    return (
        rest.join(rare, "piece", "left")
        .groupBy("row", "doc_id", "n_bytes")
        .agg(counted.alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = ["row", "doc_id", "n_bytes", "piece", "k", "known"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
