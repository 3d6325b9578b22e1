"""Operator 2: removal of repeated runs of lines.

Line ids stand in a row for each document. Prefix doubling ranks the suffixes of all rows: each round sorts pairs of
ranks, of a line's own run and of the run that begins where it ends, drops the positions whose pair occurs once and ranks the
rest, until runs are as long as the threshold. Suffixes of equal rank are then the intervals of the suffix array whose
longest common prefix reaches the threshold. The first copy in each interval stays, in the order of doc_id and line,
and later ones are deleted; where members of intervals follow each other they make up the maximal repeated runs. The order of the
suffixes beyond the threshold would part no interval and is not made.

With `long`, shorter runs of over so many words are removed too, so long single lines and copies of documents of few
lines count. A maximal run is removed by its number of lines or words just if each of its lines lies in one of the runs
of `least` lines, or in a shorter one of over `long` words that is the whole of it, so these are all that is ranked.

Lines without a word are no part of a run and stay. Ranks are two 64-bit hashes of what they stand for.

Defined results: null and empty texts have no lines with words, nothing to remove, and the digest of an empty text;
rows with the same doc_id and text count as one document and get the same result; null doc_ids come
last in the order; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, meet, release, text_key, words

#: Lines in the shortest run that is removed.
MIN_LINES = 3
#: Shorter runs are removed too if they have more words.
LONG = 50
_SPACES = " \t\n\x0b\f\r"
_OWNER = ["id", "none", "key"]


def _owned(docs: DataFrame, *columns) -> DataFrame:
    """Who a row belongs to, by columns that joins can use: doc_id (0 if null), whether it is null, and the text's key."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), text_key(F.col("text")).alias("key"), *columns)


def line_ranks(docs: DataFrame, counted: bool = False) -> DataFrame:
    """id, none, key, number (among the lines with words), r1, r2, n (words, if counted) for every line with words."""
    numbered = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    named = F.transform(numbered, lambda x: F.struct(F.xxhash64(x).alias("r1"), F.xxhash64(F.lit(1), x).alias("r2"), *[F.size(words(x)).cast("long").alias("n")] * counted))
    rows = _owned(docs, F.posexplode(named).alias("number", "r"))
    return rows.select(*_OWNER, "number", "r.*").dropDuplicates([*_OWNER, "number"])


def _shared(spark: SparkSession, ranks: DataFrame, name: str) -> DataFrame:
    """The rows of a written table whose rank occurs more than once."""
    twice = cut(spark, ranks.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{name}-classes")
    return meet(ranks, twice, ["r1", "r2"], "left_semi")


def later_copies(spark: SparkSession, docs: DataFrame, least: int, long: int | None = None) -> DataFrame:
    """id, none, key, starts (number, lines): the runs of `least` lines, or of fewer with over `long` words, that have a copy before them."""
    counted = long is not None
    ranks, length = cut(spark, _shared(spark, cut(spark, line_ranks(docs, counted), "lines"), "lines"), "ranks1"), 1
    if counted:
        ranks = ranks.withColumn("last", F.col("n"))  # words of the run's last line
    runs = []
    while length < least:
        if counted:
            runs.append(ranks.filter(F.col("n") > long).select(*_OWNER, "number", F.lit(length).alias("lines"), "r1", "r2"))
        # shorter runs of every length count if words do
        step = 1 if counted else min(length, least - length)
        ahead = Window.partitionBy(*_OWNER).orderBy("number").rangeBetween(step, step)
        pairs = ranks.withColumn("next", F.first(F.struct("r1", "r2", *["last"] * counted)).over(ahead)).filter(F.col("next").isNotNull())
        size = [(F.col("n") + F.col("next.last")).alias("n"), F.col("next.last").alias("last")] if counted else []
        named = pairs.select(*_OWNER, "number", F.xxhash64("r1", F.lit(step), F.col("next.r1")).alias("r1"), F.xxhash64(F.lit(step), "r2", F.col("next.r2")).alias("r2"), *size)
        length += step
        ranks = cut(spark, _shared(spark, cut(spark, named, f"pairs{length}"), f"pairs{length}"), f"ranks{length}")
    found = ranks.select(*_OWNER, "number", F.lit(length).alias("lines"), "r1", "r2")
    for shorter in runs:
        found = found.unionByName(shorter)
    order = F.struct("none", "id", "key", "number")
    first = cut(spark, found.groupBy("lines", "r1", "r2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    late = meet(found, first, ["lines", "r1", "r2"]).filter(order != F.col("first"))
    return late.groupBy(*_OWNER).agg(F.collect_list(F.struct("number", "lines")).alias("starts"))


def removed_lines(spark: SparkSession, docs: DataFrame, least: int = MIN_LINES, long: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for every row of docs."""
    late = cut(spark, later_copies(spark, docs, least, long), "late")
    release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts in zip(*batch.columns, strict=True):
                gone = {s["number"] + k for s in starts.as_py() or () for k in range(s["lines"])}
                lines, kept, number = (text.as_py() or "").split("\n"), [], 0
                for line in lines:
                    worded = bool(line.strip(_SPACES))
                    if not (worded and number in gone):
                        kept.append(line)
                    number += worded
                out.append((doc.as_py(), number, len(gone), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    rows = _owned(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").join(late.hint("merge"), _OWNER, "left")
    return rows.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


#: The same in DuckDB's SQL: runs of three lines, or of one or two with over 50 words.
LINES_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
numbered AS (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
runs AS (
  SELECT doc_id, number, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n, lead(n, 1) OVER w AS m
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY number)),
copies AS (
  SELECT doc_id, number, 3 AS size, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, number) AS copy
  FROM runs WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, number, 2, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, number) FROM runs WHERE n + m > 50
  UNION ALL SELECT doc_id, number, 1, row_number() OVER (PARTITION BY a ORDER BY doc_id, number) FROM runs WHERE n > 50),
gone AS (
  SELECT DISTINCT doc_id, number + k AS number FROM copies, (VALUES (0), (1), (2)) t(k) WHERE copy > 1 AND k < size),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept_text
  FROM lines l LEFT JOIN numbered n ON n.doc_id = l.doc_id AND n.pos = l.pos
       LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.number = n.number
  WHERE g.number IS NULL GROUP BY l.doc_id)
SELECT d.doc_id,
       (SELECT count(*) FROM numbered n WHERE n.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
       sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
