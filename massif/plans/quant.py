"""Matrix quantification queries: lineitem rows as intensities, parts as peptides, brands as proteins."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import quant as Q
from massif.runtime import table


def long_matrix(spark, sf_dir, with_brand: bool = False):
    """(peptide, sample, grp, value): one row per part, return flag and line status."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    m = Q.rollup_sum(
        li.select(
            F.col("l_partkey").alias("peptide"),
            F.concat("l_returnflag", "l_linestatus").alias("sample"),
            F.col("l_returnflag").alias("grp"),
            F.col("l_extendedprice").alias("value"),
        ),
        ["peptide", "sample", "grp"],
        "value",
    )
    if with_brand:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("peptide"), F.col("p_brand").alias("brand"))
        m = m.join(part, "peptide")
    return m


def quant_pipeline(spark, sf_dir):
    """Roll up, normalise by global medians, collapse samples by mean, roll up to brands by median (ML5, AGG1-4)."""
    m = long_matrix(spark, sf_dir)
    norm = Q.normalise_global_median(m, "sample", "value")
    flat = Q.collapse_mean(norm, ["peptide", "grp"], "value", samples=Q.group_sizes(m, "grp", "sample"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("peptide"), F.col("p_brand").alias("brand"))
    out = Q.rollup_median(flat.join(part, "peptide"), ["brand", "grp"], "value")
    return out.select("brand", "grp", F.round("value", 4).alias("abundance"))


MATRIX_SQL = """
m AS (SELECT l_partkey AS peptide, l_returnflag || l_linestatus AS sample, l_returnflag AS grp, sum(l_extendedprice) AS value
      FROM lineitem GROUP BY 1, 2, 3)"""

NORM_SQL = MATRIX_SQL + """,
med AS (SELECT sample, median(log2(value)) AS mv, count(*) AS n FROM m WHERE value > 0 GROUP BY 1),
g AS (SELECT median(mv) AS gm FROM med WHERE n >= 2),
norm AS (SELECT m.peptide, m.sample, m.grp, CASE WHEN n >= 2 AND value > 0 THEN power(2, log2(value) - mv + gm) ELSE value END AS value
         FROM m LEFT JOIN med USING (sample) CROSS JOIN g)"""


def brand_matrix(spark, sf_dir):
    return long_matrix(spark, sf_dir, with_brand=True)


def rollup_sum(spark, sf_dir):
    return Q.rollup_sum(brand_matrix(spark, sf_dir), ["brand", "grp"], "value").select("brand", "grp", F.round("value", 4).alias("abundance"))


def rollup_median(spark, sf_dir):
    return Q.rollup_median(brand_matrix(spark, sf_dir), ["brand", "grp"], "value").select("brand", "grp", F.round("value", 4).alias("abundance"))


def collapse_sum(spark, sf_dir):
    return Q.collapse_sum(long_matrix(spark, sf_dir), ["peptide", "grp"], "value").select("peptide", "grp", F.round("value", 4).alias("abundance"))


def collapse_mean(spark, sf_dir):
    m = long_matrix(spark, sf_dir)
    return Q.collapse_mean(m, ["peptide", "grp"], "value", Q.group_sizes(m, "grp", "sample")).select("peptide", "grp", F.round("value", 4).alias("abundance"))


def norm_global_median(spark, sf_dir):
    return Q.normalise_global_median(long_matrix(spark, sf_dir), "sample", "value").select("peptide", "sample", F.round("value", 4).alias("abundance"))


def _channels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("peptide"), F.col("l_returnflag").alias("channel"), F.col("l_extendedprice").alias("value"))
    return Q.rollup_sum(li, ["run", "peptide", "channel"], "value")


def norm_reference_channel(spark, sf_dir):
    out = Q.normalise_reference_channel(_channels(spark, sf_dir), ["run", "peptide"], "channel", "value", ["A"])
    return out.select("run", "peptide", "channel", F.round("value", 6).alias("ratio"))


def combine_matrices(spark, sf_dir):
    m = long_matrix(spark, sf_dir).select("peptide", "sample", "value")
    return Q.combine_matrices(m, "peptide", "sample", "value").select("peptide", "sample", F.round("value", 4).alias("abundance"))


def unique_peptide_map(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("peptide"), F.col("l_suppkey").alias("protein"))
    return Q.unique_members(li, "peptide", "protein")


def top3_protein(spark, sf_dir):
    m = Q.collapse_sum(brand_matrix(spark, sf_dir), ["brand", "grp", "peptide"], "value")
    return Q.top_n_sum(m, ["brand", "grp"], "peptide", "value", 3).select("brand", "grp", F.round("value", 4).alias("abundance"))


def peptide_best_peak(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("peptide"), F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("intensity"), F.col("l_orderkey").alias("peak"))
    return Q.best_of(li, ["peptide", "grp"], "intensity", "peak")


def _half(spark, sf_dir, odd):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == odd)
    return li.groupBy(F.col("l_partkey").alias("peptide")).agg(F.sum("l_quantity").alias("value"))


def result_merge(spark, sf_dir):
    return Q.merge_results(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1), "peptide", "value")


def result_append_remove(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    return Q.remove_rows(li.unionAll(li.where("l_returnflag = 'R'")), li.where("l_returnflag IN ('N', 'R')"))


def group_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return Q.group_score(li, "l_suppkey", "l_partkey", "l_quantity").withColumnRenamed("l_suppkey", "protein")


def median_polish(spark, sf_dir):
    return Q.median_polish(brand_matrix(spark, sf_dir), "brand", "peptide", "sample", "value")


BRAND_SQL = MATRIX_SQL + ", bm AS (SELECT m.*, p_brand AS brand FROM m JOIN part ON p_partkey = peptide)"

QUERIES = {
    "quant_pipeline": (
        quant_pipeline,
        f"""WITH {NORM_SQL},
ns AS (SELECT grp, count(DISTINCT sample) AS k FROM m GROUP BY 1),
flat AS (SELECT peptide, grp, sum(value) / max(k) AS value FROM norm JOIN ns USING (grp) GROUP BY 1, 2)
SELECT p_brand AS brand, grp, round(median(value) FILTER (WHERE value > 0), 4) AS abundance
FROM flat JOIN part ON p_partkey = peptide GROUP BY 1, 2""",
    ),
    "rollup_sum": (rollup_sum, f"WITH {BRAND_SQL} SELECT brand, grp, round(sum(value), 4) AS abundance FROM bm GROUP BY 1, 2"),
    "rollup_median": (rollup_median, f"WITH {BRAND_SQL} SELECT brand, grp, round(median(value) FILTER (WHERE value > 0), 4) AS abundance FROM bm GROUP BY 1, 2"),
    "collapse_sum": (collapse_sum, f"WITH {MATRIX_SQL} SELECT peptide, grp, round(sum(value), 4) AS abundance FROM m GROUP BY 1, 2"),
    "collapse_mean": (
        collapse_mean,
        f"WITH {MATRIX_SQL}, ns AS (SELECT grp, count(DISTINCT sample) AS k FROM m GROUP BY 1) SELECT peptide, grp, round(sum(value) / max(k), 4) AS abundance FROM m JOIN ns USING (grp) GROUP BY 1, 2",
    ),
    "norm_global_median": (norm_global_median, f"WITH {NORM_SQL} SELECT peptide, sample, round(value, 4) AS abundance FROM norm"),
    "norm_reference_channel": (
        norm_reference_channel,
        """WITH c AS (SELECT l_suppkey AS run, l_partkey AS peptide, l_returnflag AS channel, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, avg(value) FILTER (WHERE channel = 'A' AND value > 0) OVER (PARTITION BY run, peptide) AS ref FROM c)
SELECT run, peptide, channel, round(CASE WHEN ref IS NULL THEN 0 WHEN channel = 'A' THEN 1 ELSE value / ref END, 6) AS ratio FROM r""",
    ),
    "combine_matrices": (
        combine_matrices,
        f"WITH {MATRIX_SQL} SELECT p.peptide, s.sample, round(coalesce(value, 0), 4) AS abundance FROM (SELECT DISTINCT peptide FROM m) p CROSS JOIN (SELECT DISTINCT sample FROM m) s LEFT JOIN m ON m.peptide = p.peptide AND m.sample = s.sample",
    ),
    "unique_peptide_map": (
        unique_peptide_map,
        "SELECT l_partkey AS peptide, min(l_suppkey) AS protein FROM lineitem WHERE l_quantity >= 45 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1",
    ),
    "top3_protein": (
        top3_protein,
        f"""WITH {BRAND_SQL}, s AS (SELECT brand, grp, peptide, sum(value) AS value FROM bm GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY brand, grp ORDER BY value DESC, peptide) AS k FROM s)
SELECT brand, grp, round(sum(value), 4) AS abundance FROM r WHERE k <= 3 GROUP BY 1, 2""",
    ),
    "peptide_best_peak": (
        peptide_best_peak,
        """SELECT peptide, grp, intensity, peak FROM (SELECT l_partkey AS peptide, l_returnflag AS grp, l_extendedprice AS intensity, l_orderkey AS peak,
row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey) AS k FROM lineitem) WHERE k = 1""",
    ),
    "result_merge": (
        result_merge,
        """WITH h AS (SELECT l_partkey AS peptide, l_linenumber % 2 AS odd, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
SELECT peptide, sum(value) AS value, count(*) AS n_runs FROM h GROUP BY 1""",
    ),
    "result_append_remove": (
        result_append_remove,
        """SELECT l_partkey, l_quantity, l_returnflag FROM (SELECT l_partkey, l_quantity, l_returnflag FROM lineitem UNION ALL SELECT l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R')
EXCEPT ALL SELECT l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag IN ('N', 'R')""",
    ),
    "group_score": (
        group_score,
        "SELECT protein, sum(s) AS score FROM (SELECT l_suppkey AS protein, l_partkey, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    ),
    "median_polish": (median_polish, None),
}
