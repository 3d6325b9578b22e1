"""Pages of ordered results: top rows by offset, and keyset pages whose cursor is the key of the next row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0, most: int = 500) -> DataFrame:
    """Rows offset to offset + limit of the order, which must be unique."""
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 1, most))


def keyset(df: DataFrame, keys: list[str], start: list | None = None, limit: int = 100, descending: bool = False) -> DataFrame:
    """A page from the row with the key `start` on, that row included; keys must be unique and never change."""
    if start is not None:
        key, at = F.struct(*keys), F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, start, strict=True)])
        df = df.filter(key <= at if descending else key >= at)
    return df.orderBy(*[F.desc(k) if descending else F.asc(k) for k in keys]).limit(limit)


def next_key(df: DataFrame, keys: list[str], start: list | None, limit: int, descending: bool = False) -> list | None:
    """The key that the next page begins with, None on the last page."""
    rows = keyset(df, keys, start, limit + 1, descending).select(*keys).tail(1)
    more = keyset(df, keys, start, limit + 1, descending).count() > limit
    return list(rows[0]) if rows and more else None


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark drops further rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """Adds the number of all rows, counted by a partial aggregate and joined as one row."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))
