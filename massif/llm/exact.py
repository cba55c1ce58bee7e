"""Exact dedup by a content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts, an external sort inside each partition puts equal texts
side by side, and neighbours are compared in full. The splitter key is a fixed-width prefix and a hash of the text, so that
the sample taken by the driver stays small however long the texts are; the sort and the comparison use the whole text.

A text that very many rows share would fill one partition. Texts of more than `limit` copies, `max(1000, rows / 100000)`,
are therefore sorted in salted parts first, and only the first row of each part is sorted again. There are at most 100,000
such texts at any input size, so the table of them can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.runtime import Scratch, shuffle_partitions

#: A part of a text's copies larger than this, and than a 100,000th of all rows, is split.
MIN_HOT_ROWS = 1000
MAX_HOT_TEXTS = 100_000
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _sorted_groups(df: DataFrame, text: Column, extra: list[str], n: int) -> tuple[DataFrame, Window]:
    """Range-partition by (prefix, hash, *extra); the window below needs no further exchange."""
    dealt = df.repartitionByRange(n, "_prefix", "_hash", *extra).withColumn("_norm", normalised(text))
    return dealt, Window.partitionBy("_prefix", "_hash", *extra, "_norm")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of df with keep_id, group_size, kept and text_sha256.

    Equal means identical after each run of ASCII white space is one space; null is empty. The row with the smallest id of
    equal texts stays (ids that are null come last); of rows that share text and id one stays. An empty table gives an
    empty table. Columns of df named like the four new ones are replaced.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    cols = [c for c in df.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    payload = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row")
    norm = normalised(F.col(f"`{text_col}`"))
    keyed = df.select(
        payload,
        F.col(f"`{id_col}`").alias("_id"),
        F.substring(norm, 1, PREFIX_CHARS).alias("_prefix"),
        F.xxhash64(norm).alias("_hash"),
    )
    scratch = Scratch(spark, "exact")
    total = df.count()
    limit = max(MIN_HOT_ROWS, total // MAX_HOT_TEXTS)
    counts = df.select(F.xxhash64(norm).alias("_hash")).groupBy("_hash").agg(F.count("*").alias("_n"))
    hot = scratch.save(counts.where(F.col("_n") > limit).select("_hash", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")).coalesce(1))

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select(
            *[F.col("_row").getField(c).alias(c) for c in cols],
            F.col("_keep").alias("keep_id"),
            F.col("_size").alias("group_size"),
            F.col("_kept").alias("kept"),
            F.sha2(F.col("_norm"), 256).alias("text_sha256"),
        )

    def ranked(rows: DataFrame, extra: list[str], parts: int) -> DataFrame:
        dealt, key = _sorted_groups(rows, F.col("_row").getField(text_col), extra, parts)
        order = key.orderBy(F.col("_id").asc_nulls_last())
        whole = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return dealt.select(
            "*",
            (F.row_number().over(order) == 1).alias("_kept"),
            F.first("_id").over(order).alias("_keep"),
            F.count("*").over(whole).alias("_size"),
        )

    if hot.isEmpty():
        return finish(ranked(keyed, [], n))
    small = F.broadcast(hot)
    cold = finish(ranked(keyed.join(small, "_hash", "left_anti"), [], n))
    salted = keyed.join(small, "_hash").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    parts = ranked(salted, ["_salt"], n)
    # the first row of each part: at most 2 * MAX_HOT_TEXTS rows
    heads = parts.where("_kept").select("_prefix", "_hash", "_salt", F.col("_row").getField(text_col).alias("_text"), "_id", "_size")
    dealt, key = _sorted_groups(heads, F.col("_text"), [], n)
    whole = key.orderBy(F.col("_id").asc_nulls_last(), "_salt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = scratch.save(
        dealt.select(
            "_hash",
            "_salt",
            F.sha2("_norm", 256).alias("_sha"),
            F.first("_id").over(whole).alias("_all_keep"),
            F.first("_salt").over(whole).alias("_keep_salt"),
            F.sum("_size").over(whole).alias("_all_size"),
        )
    )
    warm = (
        parts.withColumn("_sha", F.sha2("_norm", 256))
        .join(F.broadcast(merged), ["_hash", "_salt", "_sha"])
        .withColumn("_kept", F.col("_kept") & (F.col("_salt") == F.col("_keep_salt")))
        .withColumn("_keep", F.col("_all_keep"))
        .withColumn("_size", F.col("_all_size"))
    )
    return cold.unionByName(finish(warm))
