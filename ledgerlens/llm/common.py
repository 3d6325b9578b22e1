"""What the corpus operators share: reading, digests, tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the operators' contracts: what separates words.
SPACES = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def digest(text: Column) -> Column:
    """16 bytes of the text's SHA-256: the identity of equal texts. Null and empty agree."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, so a lost executor costs no recomputation."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Empties the folders of tables that cut() wrote and that nothing reads any more: on disk is only what is still needed."""
    for folder in {unquote(file.rsplit("/", 1)[0]) for table in tables for file in table.inputFiles()}:
        spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(folder)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results have been written by cut()."""
    for _ in range(2):  # what Python lets go of in the first round, the JVM finds in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> Column:
    """64 bits of the text's digest as a number: what lists of positions are dealt out by."""
    return F.conv(F.hex(F.substring(digest(text), 1, 8)), 16, -10).cast("long")


#: Bytes of digests that a task remembers at most before it forgets them and may send a text twice.
REMEMBERED = 64_000_000
#: A key that more than one in HOT rows have is met in pieces; there are fewer than HOT of these.
HOT = 1024


def _without_own_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for one in batch.column(0).to_pylist():
            fresh.append(one not in seen)
            seen.add(one)
        yield batch.filter(pa.array(fresh, pa.bool_()))
        if len(seen) * 80 > REMEMBERED:  # a digest in a set takes about 80 bytes
            seen.clear()


def distinct_texts(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """A table (digest, key, text) with one row per different text, bucketed by key.

    The one shuffle of whole texts that the repeat finders need: later passes join it
    by key to lists of positions, which are dealt to its buckets, and the texts stay put.
    Each task drops its own copies first, so a text that a third of all rows have is sent once a task.
    Different texts have different keys: should 64 bits of two digests agree, the second gets another key.
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.select(digest(text).alias("digest"), text_key(text).alias("key"), text.alias("text"))
    same = F.row_number().over(Window.partitionBy("key").orderBy("digest"))
    table = f"{name}_{uuid.uuid4().hex}"
    (
        one.mapInArrow(_without_own_copies, "digest binary, key long, text string")
        .repartition(parts(spark), "key")
        .dropDuplicates(["key", "digest"])
        .withColumn("same", same)
        .select("digest", F.when(F.col("same") == 1, F.col("key")).otherwise(F.xxhash64("digest", "same")).alias("key"), "text")
        .write.option("compression", "zstd")
        .option("path", f"{shared_dir(spark)}/{table}")
        .bucketBy(parts(spark), "key")
        .saveAsTable(table)
    )
    release(spark)
    return spark.table(table)


def meet(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a written table that has one row for each key, and in n how many of the rows have it.

    The few keys that very many rows have stand in the table once for each of their pieces, and their rows are dealt
    out by piece too: no more than one in HOT rows is ever dealt to one task for a key, of however many rows.
    """
    total, most = table.agg(F.sum("n"), F.max("n")).first()
    if not most or most * HOT <= total:
        return rows.join(table.drop("n"), on, how)
    pieces = F.when(F.col("n") * HOT > total, F.ceil(F.col("n") * HOT / total)).otherwise(1).cast("int")
    hot = table.select(*on, pieces.alias("_pieces")).filter("_pieces > 1")  # fewer than HOT rows
    piece = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.coalesce("_pieces", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_piece", piece).drop("_pieces")
    copies = table.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n")
    return dealt.join(copies, [*on, "_piece"], how).drop("_piece")
