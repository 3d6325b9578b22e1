"""Operator 4: mixing sources to target weights by systematic sampling.

Every source has a target in words. A document is expected target / source size times; the
expectations are summed up in an order within the source, a random offset is added to the sums, and a
document is emitted once for every whole number that its step crosses. The order runs by size class, so
that large and small documents are taken alike and the words taken come near the target.

The sums come from counts by (source, size class, salt) and from places within these, so that a source
with a third of all rows is spread over as many tasks as any other rows.

Defined results: a null or empty text has size 0 and adds no words; documents without a source form the
last source; the offset is a function of seed and source, so reruns agree; each row counts by itself, rows
that repeat a doc_id and null doc_ids included (all copies of one row share a salt); further columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, words

#: Fixed by the contract: weights by the sources' order, the words wanted against all words, and the most against a source's own.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Size classes in an octave; salts in a class, at least, and one for so many rows of the table.
CLASSES = 8
SALTS, SALT_ROWS = 64, 1_000_000


def targets(sized: DataFrame) -> DataFrame:
    """nosource, name, source_size, target: one row per source.

    A source whose fair part of what is left exceeds its bound stops there, and the rest is shared anew
    by weight. In the order of bound / weight one pass over running sums finds where that ends.
    """
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(Window.orderBy("nosource", "name")) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = sized.groupBy("nosource", "name").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    everywhere = Window.partitionBy()
    order = Window.orderBy(F.col("bound") / F.col("w"), "nosource", "name")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    return (
        sources.withColumn("bound", (MOST * F.col("source_size")).cast("double"))
        .withColumn("wanted", F.sum("source_size").over(everywhere) * SHARE)
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("full", F.col("bound") <= F.col("level") * F.col("w"))
        .withColumn("left", F.col("wanted") - F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))).over(everywhere), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(everywhere))
        .select("nosource", "name", "source_size", F.when(F.col("full"), F.col("bound")).otherwise(F.col("left") * F.col("w") / F.col("open")).alias("target"))
    )


def _copies(sized: DataFrame, seed: str) -> DataFrame:
    """sized with source_size, target and copies. A salt is a hash of doc_id; their number grows with the table."""
    salts = max(SALTS, sized.count() // SALT_ROWS)
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    classed = sized.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size") * CLASSES)).otherwise(-1).cast("int")).withColumn("salt", F.pmod(salt, F.lit(salts)))
    cell = ["nosource", "name", "class", "salt"]
    before = Window.partitionBy("nosource", "name").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = classed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("name"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rated = cells.join(targets(sized), ["nosource", "name"]).select(*cell, "before", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id"))
    at = F.col("before") + F.col("place")
    copies = F.floor(F.col("rate") * at + F.col("offset")) - F.floor(F.col("rate") * (at - 1) + F.col("offset"))
    return classed.withColumn("place", place).join(rated, cell).withColumn("copies", copies)


def _sized(docs: DataFrame, *more) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("nosource"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        *more,
    )


def mix(spark: SparkSession, docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of docs."""
    counted = _copies(cut(spark, _sized(docs), "mix"), seed)
    return counted.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    counted = _copies(_sized(docs, F.struct(*docs.columns).alias("row")), seed)
    return counted.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


#: The same in DuckDB's SQL.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source IS NULL AS nosource, coalesce(source, '') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
sources AS (
  SELECT nosource, name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY nosource, name) - 1) % 3 + 1)::INT] AS w, (2 * source_size)::DOUBLE AS bound FROM sources),
levels AS (
  SELECT *, (SELECT sum(source_size)::BIGINT FROM sources) * 1.5::DOUBLE AS wanted,
         (((SELECT sum(source_size)::BIGINT FROM sources) * 1.5::DOUBLE)
          - coalesce(sum(bound) OVER (ORDER BY bound / w, nosource, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / (sum(w) OVER (ORDER BY bound / w, nosource, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted),
filled AS (SELECT *, bound <= level * w AS is_full FROM levels),
rest AS (
  SELECT coalesce(sum(bound) FILTER (WHERE is_full), 0.0::DOUBLE) AS taken_up, sum(w) FILTER (WHERE NOT is_full) AS open_w FROM filled),
targets AS (
  SELECT nosource, name, source_size,
         CASE WHEN is_full THEN bound ELSE (wanted - taken_up) * w / open_w::DOUBLE END AS target
  FROM filled, rest),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY nosource, name
              ORDER BY CASE WHEN size > 0 THEN floor(log2(size) * 8)::INT ELSE -1 END, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT greatest(64, count(*) // 1000000) FROM sized), size, doc_id NULLS FIRST) AS place
  FROM sized),
rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix' || p.name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM placed p JOIN targets t USING (nosource, name))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (floor(rate * place + shift) - floor(rate * (place - 1) + shift))::BIGINT AS copies,
       ((floor(rate * place + shift) - floor(rate * (place - 1) + shift))::BIGINT * size)::BIGINT AS taken
FROM rated
"""
