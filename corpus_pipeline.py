"""The corpus pipeline: five stages from documents to packed sequences, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. doc_id may be null or repeat: stages that carry something to a row do so by a key of their own. Extra columns are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm import quality
from massif.llm.exact import exact_dedup
from massif.llm.mixing import mix, realise
from massif.llm.packing import pack
from massif.llm.simhash import near_dedup
from massif.runtime import Scratch, table


def _named(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """docs under names that no operator uses, the new name of a column, and the way back."""
    names = docs.columns
    own = {c: f"_c{i}" for i, c in enumerate(names)}
    return docs.toDF(*own.values()), own.__getitem__, lambda df: df.select(*[F.col(own[c]).alias(c) for c in names])


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """_named() with _row, which tells all rows apart, null and repeated ids included. The table is written, so that each reading sees the same keys."""
    df, own, back = _named(docs)
    return Scratch(docs.sparkSession, name).save(df.withColumn("_row", F.monotonically_increasing_id())), own, back


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more stay; null texts are scored as empty ones, rows that repeat alike. An empty table stays empty."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    df, own, back = _named(docs)
    return back(quality.score(df, model, own("text")).where("predicted = 1"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space the one with the smallest id stays, of rows of one id too; null texts equal empty ones. An empty table stays empty."""
    df, own, back = _named(docs)
    return back(exact_dedup(df, own("doc_id"), own("text")).where("kept"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by near fingerprints one stays: that of the smallest id, ids that are null last. Texts are read whole, one at a time; rows without a word link like any others. An empty table stays empty."""
    df, own, back = _keyed(docs, "deduped")
    gone = near_dedup(df, own("doc_id"), own("text"), "_row").where("NOT kept").select(F.col("key").alias("_row"))
    return back(df.join(gone, "_row", "left_anti"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with the words that the mix takes of it, repeated words in full; rows of which it takes none, null and empty texts among them, go. A long text is cut in the bytes of its column. An empty table stays empty."""
    df, own, back = _keyed(docs, "mixed")
    mixed = Scratch(spark, "mixed").save(mix(df, own("doc_id"), own("text"), own("source"), key_col="_row"))
    taken = mixed.select(F.col("key").alias("id"), "taken", "spans")
    return back(realise(df, taken, "_row", own("text"), own("n_chars") if "n_chars" in docs.columns else None))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens, with their ids as little-endian 16-bit numbers. A null text gives its end id alone, a long one as many pieces as it needs. An empty table gives no piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: The classifier, the fingerprints, the draws and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
