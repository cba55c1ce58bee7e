"""Target-decoy error rates, over ranges of the score order rather than in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.operators.prefix import running_sums, suffix_min


def q_values(df: DataFrame, score: str, decoy: Column, places: int = 6) -> DataFrame:
    """(score, q): (decoys at or above + 1) / targets at or above, at most 1, then the least of it at or below; all 0 without decoys.

    Ties share a value, so counts are taken for each distinct score (rounded to `places`) first.
    """
    s = F.round(score, places).alias("score")
    t = df.groupBy(s).agg(F.sum((~decoy).cast("long")).alias("n_t"), F.sum(decoy.cast("long")).alias("n_d"))
    order = [F.desc("score")]
    t = running_sums(t, order, {"t": F.col("n_t"), "d": F.col("n_d")})
    t = t.withColumn("raw", F.least(F.lit(1.0), (F.col("d") + 1) / F.greatest(F.col("t"), F.lit(1))))
    any_decoy = t.agg(F.max("d").alias("all_d"))
    out = suffix_min(t, order, "raw", "q").join(F.broadcast(any_decoy))
    return out.select("score", F.when(F.col("all_d") == 0, 0.0).otherwise(F.col("q")).alias("q"))


def fdr_threshold(df: DataFrame, score: str, decoy: Column, most: float) -> DataFrame:
    """The least score whose q-value is at most `most`, never above 1; 1 if there is none."""
    return q_values(df, score, decoy).agg(F.coalesce(F.least(F.min(F.when(F.col("q") <= most, F.col("score"))), F.lit(1.0)), F.lit(1.0)).alias("threshold"))


def double_decoy(df: DataFrame, order: list[Column], decoy_peptide: Column, random_time: Column) -> DataFrame:
    """df with fdr: (1 + decoy peaks + max(0, decoy peptides - doubles)) / rows so far, six places, least from here on."""
    n = lambda c: c.cast("long")
    sums = {"_pk": n(random_time & ~decoy_peptide), "_pe": n(decoy_peptide & ~random_time), "_b": n(decoy_peptide & random_time), "_n": F.lit(1)}
    out = running_sums(df, order, sums)
    raw = F.round((1 + F.col("_pk") + F.greatest(F.lit(0), F.col("_pe") - F.col("_b"))) / F.col("_n"), 6)
    return suffix_min(out.withColumn("_raw", raw), order, "_raw", "fdr").select(*df.columns, "fdr")


def running_mean_fdr(df: DataFrame, order: list[Column], pep: Column) -> DataFrame:
    """df with fdr: the mean error probability of the rows so far."""
    out = running_sums(df, order, {"_p": pep, "_n": F.lit(1)})
    return out.withColumn("fdr", F.col("_p") / F.col("_n")).drop("_p", "_n")
