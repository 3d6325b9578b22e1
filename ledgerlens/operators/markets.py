"""Prediction markets, from the outputs and inputs of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import covenants as V
from ledgerlens.functions import scripts as S


def prediction_markets(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """The markets that transactions open: outputs are (txid, height, vout, script), inputs (txid, prev, index).

    A transaction's first beacon counts. It must spend the output that the market is named by; its first output must be the
    market, whose code pushes that name as a singleton and holds both shares' names; the next two must anchor the shares.
    What is kept comes from the market's state; `agrees` says whether the beacon has the same.
    """
    told = outputs.filter(V.may_announce(F.col("script"))).withColumn("c", S.chunks("script")).withColumn("b", S.market_beacon(F.col("script"), F.col("c")))
    beacons = told.filter("b IS NOT NULL").groupBy("txid").agg(F.min_by("b", "vout").alias("b"), F.first("height").alias("height"))
    at = lambda i: F.max(F.when(F.col("vout") == i, F.col("script"))).alias(f"o{i}")
    first = outputs.filter("vout < 3").join(beacons.select("txid"), "txid", "left_semi").groupBy("txid").agg(at(0), at(1), at(2))
    spent = inputs.select("txid", F.concat("prev", S.index_bytes(F.col("index"))).alias("market"))
    named = beacons.withColumn("market", F.col("b.market")).join(spent, ["txid", "market"], "left_semi")
    rows = named.join(first, "txid").withColumn("s", V.market_state(F.col("o0")))
    own = F.contains(F.col("s.code"), F.concat(F.lit(bytes([S.SINGLETON])), F.col("market")))
    shares = F.contains(F.col("s.code"), F.col("b.yes")) & F.contains(F.col("s.code"), F.col("b.no"))
    anchored = V.anchors(F.col("o1"), F.col("b.yes"), F.col("market")) & V.anchors(F.col("o2"), F.col("b.no"), F.col("market"))
    agrees = (F.col("b.expiry") == F.col("s.expiry")) & (F.col("b.grace") == F.col("s.grace")) & (F.col("b.oracle") == F.col("s.oracle"))
    return rows.filter(own & shares & anchored).select(
        "market", "b.yes", "b.no", "s.expiry", "s.grace", "s.oracle", "s.status", "s.optimistic", "b.question", agrees.alias("agrees"), "txid", "height"
    )
