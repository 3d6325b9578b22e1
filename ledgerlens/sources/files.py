"""Contracts and deny lists as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C

CONTRACTS = "ref string, name string, algorithm bigint, reward bigint, difficulty bigint, active boolean"


def write_contracts(contracts: DataFrame, path: str) -> None:
    """One JSON object a contract, in as many files as there are partitions."""
    contracts.write.mode("overwrite").json(path)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """What was written; a line that is no object is left out, a field that does not fit is null."""
    rows = spark.read.schema(f"{CONTRACTS}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.filter("ref IS NOT NULL").drop("broken")


def read_denied(spark: SparkSession, path: str) -> DataFrame:
    """ref: references (72 hex digits) that files deny, each once.

    A file is one JSON list, or an object with it as refs; entries are references or objects with a ref. What is no
    reference, and a file that is no JSON, is left out. Read anew by each query, so an edited file counts from the next on.
    """
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json(F.coalesce(F.get_json_object("value", "$.refs"), F.col("value")), "array<string>")
    named = text.select(F.explode(entries).alias("entry")).select(F.coalesce(F.get_json_object("entry", "$.ref"), "entry").alias("entry"))
    return named.select(F.get(C.reference_candidates(F.col("entry")), F.lit(0)).alias("ref")).filter("ref IS NOT NULL").distinct()


def allowed(contracts: DataFrame, denied: DataFrame) -> DataFrame:
    """Contracts whose reference, in whatever form, is not denied."""
    key = F.get(C.reference_candidates(F.col("ref")), F.lit(0))
    return contracts.withColumn("key", key).join(denied.withColumnRenamed("ref", "key"), "key", "left_anti").drop("key")
