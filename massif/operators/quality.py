"""Design-table quality over wide tables brought to a long form of (row, name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that stand for an absent value.
ABSENT = ("", "not available", "not applicable", "n/a", "na", "null", "none")


def long_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value) of each cell, values as text."""
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, "name", "value")


def _clean(value: str = "value"):
    return F.lower(F.trim(F.coalesce(F.col(value), F.lit(""))))


def coverage(cells: DataFrame) -> DataFrame:
    """Per name: rows, filled, absent, distinct values (trimmed, whatever their case) and the share filled."""
    filled = ~_clean().isin(*ABSENT)
    out = cells.groupBy(F.lower(F.trim("name")).alias("name")).agg(
        F.count("*").alias("n_rows"), F.sum(filled.cast("long")).alias("n_filled"), F.count_distinct(F.when(filled, _clean())).alias("n_distinct")
    )
    return out.select("name", "n_rows", "n_filled", (F.col("n_rows") - F.col("n_filled")).alias("n_absent"), "n_distinct", F.round(F.col("n_filled") / F.col("n_rows"), 6).alias("fill_rate"))


def drift(cells: DataFrame) -> DataFrame:
    """(name, form, n_variants, n_rows): values of one name that differ only in case, blanks, dashes or underscores."""
    form = F.regexp_replace(_clean(), "[\\s_-]+", "")
    out = cells.where(~_clean().isin(*ABSENT)).groupBy("name", form.alias("form")).agg(F.count_distinct("value").alias("n_variants"), F.count("*").alias("n_rows"))
    return out.where("n_variants > 1")


def validate(df: DataFrame, key: str, required: list[str], rules: dict[str, str], unique: list[str]) -> DataFrame:
    """(issue, subject, n): missing required columns, rows that break a rule (SQL that must hold; null breaks it), repeated keys. Only issues that occur."""
    spark = df.sparkSession
    missing = spark.createDataFrame([("missing column", c, 1) for c in required if c not in df.columns], "issue string, subject string, n long")
    checks = [F.sum((~F.coalesce(F.expr(rule), F.lit(False))).cast("long")).alias(name) for name, rule in rules.items()]
    broken = df.agg(*checks).unpivot([], list(rules), "subject", "n").select(F.lit("broken rule").alias("issue"), "subject", "n")
    repeated = df.groupBy(*unique).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated key").alias("issue"), F.lit(",".join(unique)).alias("subject"), "n")
    return missing.unionByName(broken).unionByName(repeated).where("n > 0")
