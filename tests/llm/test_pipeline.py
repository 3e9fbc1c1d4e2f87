"""The pipeline's stages one by one on a small table, and on an empty one."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline as p
from folioscope.llm import queries
from folioscope.llm.words import pieces
from tests.llm.conftest import SCHEMA
from tests.llm.test_op5_op8 import noisy


def test_each_stage_does_its_work(spark, tmp_path) -> None:
    texts, labels = noisy(8, 500)
    items = [(1, "question one two three four five six seven eight nine ten answer eleven twelve thirteen")]
    texts = [(i, t + (" " + items[0][1] if i % 50 == 7 else "")) for i, t in texts]
    texts += [(1000 + i, texts[i][1]) for i in range(0, 100, 5)]
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = {i for i, q, t in labels if not q or t}
    bad |= {1000 + i for i in bad if i < 100 and i % 5 == 0}
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in p.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert name == "sharding" or out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen.append([r["doc_id"] for r in df.select("doc_id").collect()])
    everything = {d[0] for d in docs}
    good, near, clean, mixed, sharded = (set(x) for x in seen)
    assert everything - good <= bad and len(good & bad) <= 0.05 * len(bad)
    assert not {1000 + i for i in range(0, 100, 5)} & near and {i for i in good if i < 100 and i % 5} <= near
    assert near - clean == {i for i in near if i % 50 == 7 and i < 1000}
    assert mixed <= clean and len(seen[3]) > 0.9 * len(clean)
    assert sorted(seen[4]) == sorted(seen[3]) and sharded == mixed
    assert sorted(map(str, p.run(spark, str(tmp_path)).collect())) == sorted(map(str, df.collect()))


def test_empty_tables(spark, tmp_path) -> None:
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == (name == "op11_chat")  # which adds a conversation of its own


def test_texts_go_to_python_in_small_batches(spark) -> None:
    """What a worker and its executor hold beside the heap is bounded; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for before, after in (("10000", "1000"), ("0", "1000"), ("-1", "1000"), ("300", "300")):
            spark.conf.set(key, before)
            p.small_batches(spark)
            sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.record_batch({"n": [len(b)]}) for b in batches), "n long").collect()
            assert spark.conf.get(key) == after and max(r["n"] for r in sizes) == int(after) and sum(r["n"] for r in sizes) == 5000
    finally:
        spark.conf.unset(key)
    texts = pa.array(["word " * 2000] * 200 + ["x" * 300_000])
    assert [k for k in pieces(texts, True) if len(k.data) > 300_000] == []
