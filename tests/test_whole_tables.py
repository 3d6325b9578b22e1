"""Queries over whole tables answer for every account and every transaction."""

import pytest

from ledgerlens.operators import chain
from ledgerlens.plans import catalog, more, overlays  # noqa: F401
from ledgerlens.sources import tables as T


@pytest.mark.parametrize("name", ["utxo_list", "refs_by_outpoint", "history_numbered", "tx_num_to_height"])
def test_rows_for_all(spark, small, name):
    t, out = T.txs(spark, small), T.outputs(spark, small)
    want = {"utxo_list": out.filter("not spent"), "refs_by_outpoint": out, "history_numbered": t.filter(t.height < T.mempool_height()), "tx_num_to_height": t}[name].count()
    assert catalog.QUERIES[name](spark, small).count() == want > 0


def test_height_of_every_number(spark, small):
    heights = sorted(r.height for r in T.txs(spark, small).select("height").collect())
    found = sorted((r.number, r.height) for r in catalog.QUERIES["tx_num_to_height"](spark, small).collect())
    assert found == list(enumerate(heights))


def test_chains_of_any_length(spark):
    rows = spark.createDataFrame([(k, k - 1) for k in range(1000, 1130)] + [(5000, 1001), (7000, 1)], "tx long, parent long")
    found = {r.tx: r.depth for r in chain.depths(rows).collect()}
    assert found == {k: k - 1000 for k in range(1000, 1130)} | {5000: 2, 7000: 0}
