"""What a run leaves behind, and what it sends to the executors."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import contamination, registry, subword
from tessella.llm.common import map_batches, shared_dir

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_decontamination", "op6_sharding", "op9_ann", "op12_simhash"])
def test_session_options_stay(spark, name):
    options = lambda: {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    before = options()
    assert registry.queries()[name](spark, BASE).count() >= 0
    assert options() == before


def test_passed_stages_of_the_pipeline_go(spark):
    pytest.importorskip("corpus_pipeline").run(spark, BASE).count()
    left = {f.rsplit("-", 1)[0] for f in os.listdir(shared_dir(spark)) if f.startswith("pipeline-")}
    assert left == {"pipeline-secrets"}


def test_batches_have_few_rows(spark):
    import pyarrow as pa

    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    got = [r["n"] for r in map_batches(spark.range(0, 2500, 1, 1), sizes, "n long").collect()]
    assert sorted(got) == [500, 1000, 1000]


def test_long_items_are_cut_and_lose_no_window(spark):
    rng = random.Random(9)
    words = [str(rng.randint(0, 400)) for _ in range(3_000)]
    items = [(1, " ".join(words)), (2, "a b c"), (3, None)]
    docs = [(k, " ".join(words[a : a + 30]) + " tail " + str(k)) for k, a in enumerate(range(0, 2_900, 97))]
    held = spark.createDataFrame(items, "item_id long, text string")
    parts = [p for block in contamination.blocks(held, 400, 10) for p in block]
    assert len(parts) > 20 and max(len(t.split()) for _, t in parts) <= 109
    got = contamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), held, 10, 400).collect()
    for r in got:
        hit = {w for s in r["hit_spans"] for w in range(s["start"], s["end"])}
        assert hit == set(range(30)) and r["hit_items"] == [1]


def test_training_texts_are_bounded_by_bytes(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    texts, _ = subword.labelled_sample(docs, labels, "quality", 4, 2, subword.Spec(sample_bytes=500))
    assert len(texts) == 10
    assert subword.labelled_sample(docs, labels, "quality", 4, 2, subword.Spec(sample_bytes=50)) == ([], [])
