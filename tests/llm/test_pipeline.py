"""The stages against brute force on a small table; the classifier's decisions are taken as they are."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import mixing
from tests.llm.test_dedup import UPPER, brute_components


def test_stages_follow_from_each_other(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 9 == 0), 1) for i in range(60)], "doc_id long, toxic int, quality int")
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert after.columns == now.columns
        after.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = [r.doc_id for r in now.select("doc_id").collect()]
    texts = {i: t for i, t, *_ in rows}
    last = {}
    for i in kept["toxicity"]:
        key = (texts[i] or "").translate(UPPER)
        last[key] = max(i, last.get(key, i))
    assert sorted(kept["exact dedup"]) == sorted(last.values())
    left = [(i, texts[i]) for i in kept["exact dedup"]]
    assert sorted(kept["near dedup"]) == sorted(i for i, x in brute_components(left, 5).items() if x[2])
    before = spark.read.parquet(f"{tmp_path}/2")
    often = {r.doc_id: 1 if r.size == 0 else int(r.taken / r.size + 0.5) for r in mixing.mix(before).collect()}
    assert collections.Counter(kept["mixing"]) == +collections.Counter(often)
    assert sorted(kept["bpe"]) == sorted(kept["mixing"])
