"""The pipeline's stages on a small table: what each keeps, its columns, and its behaviour on an empty table."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from massif.llm import registry
from massif.runtime import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("_norm", F.lit(1)).withColumn("kept", F.lit("x"))
    scratch = Scratch(spark, "test")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, sf_dir))
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    before, after = seen["exact_dedup"]
    norm = lambda df: {" ".join((r.text or "").split()) for r in df.collect()}
    assert norm(before) == norm(after)
    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(before, "doc_id")
    kept = labels.join(after.select("doc_id"), "doc_id", "left_semi")
    assert kept.where("quality = 1").count() >= 0.95 * labels.where("quality = 1").count()
    _, pieces = seen["packing"]
    assert pieces.select("doc_id").distinct().count() == seen["source_mixing"][1].count()


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name


def test_registry_names_every_operator():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in registry.queries() if k.startswith("op")}
    assert "pipeline" in registry.queries()
