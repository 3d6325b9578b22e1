"""Names: the first claim wins, later ones are duplicates, in a tree of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions import fixed


def claims(tokens: DataFrame) -> DataFrame:
    """name (normalised), height, ref, claim: its place among all claims of the name, 1 for the one that holds."""
    named = tokens.select(F.trim(F.lower("name")).alias("name"), "height", "ref")
    return named.withColumn("claim", F.row_number().over(Window.partitionBy("name").orderBy("height", "ref")).cast("long"))


def canonical(tokens: DataFrame) -> DataFrame:
    """The claim of each name that holds; a partial aggregate instead of a window over all claims."""
    named = tokens.select(F.trim(F.lower("name")).alias("name"), F.struct("height", "ref").alias("c"))
    return named.groupBy("name").agg(F.min("c").alias("c")).select("name", "c.height", "c.ref")


def duplicates(tokens: DataFrame) -> DataFrame:
    return claims(tokens).filter("claim > 1")


def counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy(F.trim(F.lower("name")).alias("name")).agg(F.count(F.lit(1)).alias("claims"), (F.count(F.lit(1)) > 1).alias("has_duplicates"))


def available(asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Asked names that nobody has claimed."""
    wanted = asked.select(F.trim(F.lower("name")).alias("name")).distinct()
    return wanted.join(canonical(tokens), "name", "left_anti")


def edges(tokens: DataFrame) -> DataFrame:
    """name, depth, prefix, character, slot: one edge of the tree for each character of a name that holds."""
    characters = canonical(tokens).select("name", F.posexplode(F.split("name", "")).alias("depth", "character"))
    return characters.filter("character <> ''").select("name", F.col("depth").cast("long").alias("depth"), F.expr("substring(name, 1, depth)").alias("prefix"), "character", C.branch(F.col("character")).cast("long").alias("slot"))


def children(tokens: DataFrame, prefix: str) -> DataFrame:
    """The characters that follow a prefix in any name, in the order of their branches."""
    found = edges(tokens).filter(F.col("prefix") == prefix).groupBy("slot", "character").agg(F.count(F.lit(1)).alias("names"))
    return found.filter(F.col("slot") >= 0).orderBy("slot").limit(len(fixed.NAME_CHARACTERS))


def owned(names: DataFrame, owners: DataFrame, account: int) -> DataFrame:
    """Names whose reference is held by the account now; owners has ref, account, height, of which the last counts."""
    now = owners.groupBy("ref").agg(F.max_by("account", F.struct("height", "account")).alias("account")).filter(F.col("account") == account)
    return names.join(now, "ref", "left_semi")


def search(rows: DataFrame, text: str, fields: list[str], sort: str = "new", limit: int = 200) -> DataFrame:
    """Rows with the text in any of the fields, in any case."""
    found = rows.filter(F.lower(F.concat_ws(" ", *fields)).contains(text.lower()))
    by = [F.desc("height"), F.asc("ref")] if sort == "new" else [F.lower(fields[0]), F.desc("height"), F.asc("ref")]
    return found.orderBy(*by).limit(max(1, min(1000, limit)))
