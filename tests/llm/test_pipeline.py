"""The pipeline's stages, each on what the one before it kept, against brute force."""

from collections import Counter

import corpus_pipeline
from ledgerlens.llm.common import cut
from ledgerlens.llm.mixing import mix
from tests.llm import brute
from tests.llm.conftest import COLUMNS, edge_rows, plain


def test_stages(spark, small):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = cut(spark, stage(spark, docs, small), "stage")
        assert name == "sharding" or docs.columns == seen[0].columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    raw, spoken, single, clean, mixture = seen
    assert {r.doc_id for r in spoken.collect()} == {r.doc_id for r in raw.collect() if any(c.isalpha() for c in r.text)}
    rows = spoken.select("doc_id", "text").collect()
    groups, _ = brute.groups([r.doc_id for r in rows], [r.text for r in rows])
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in groups}
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert plain(r for r in clean.collect()) == plain(r for r in single.collect() if not any(i in r.text for i in items))
    copies = {r.doc_id: r.copies for r in mix(spark, clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixture.collect()) == copies
    assert Counter(r.doc_id for r in docs.collect()) == copies and {"shard", "slot", "text"} <= set(docs.columns)


def test_stages_on_edges(spark, tmp_path):
    spark.createDataFrame(edge_rows(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "of no document at all, this item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in edge_rows()} and all(r.text for r in out)


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
