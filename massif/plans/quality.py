"""Design-table quality queries and grouped algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import grouped as G
from massif.operators import quality as Q
from massif.plans.sequence import _formulas
from massif.runtime import table


def _cells(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(" not available ")).when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")).alias("nation"),
        F.concat(F.lit("Pool"), F.when(F.col("c_custkey") % 3 == 0, "_").when(F.col("c_custkey") % 3 == 1, "-").otherwise(" "), F.col("c_nationkey") % 4).alias("pool"),
    )
    return Q.long_form(c, "c_custkey", ["segment", "nation", "pool"])


def sdrf_coverage(spark, sf_dir):
    return Q.coverage(_cells(spark, sf_dir))


def sdrf_drift(spark, sf_dir):
    return Q.drift(_cells(spark, sf_dir))


def sdrf_validate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return Q.validate(c, "c_custkey", ["c_custkey", "c_region"], {"balance": "c_acctbal >= 0", "segment": "c_mktsegment <> ''"}, ["c_nationkey", "c_mktsegment"])


def mass_trace(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.floor(F.col("event_id") / 10).alias("scan"))
    return G.mass_traces(ev, ["user_id"], "value", "scan", 5.0, 50)


def trace_correct(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 10).alias("mass"), (F.col("event_id") % 9 + 1.0).alias("weight"))
    return G.trace_correct(ev, ["user_id"], "mass", "weight")


def isotope_distribution(spark, sf_dir):
    return G.isotope_rows(_formulas(spark, sf_dir).select("formula").distinct(), "formula", "formula")


def deconvolute(spark, sf_dir):
    f = G.isotope_rows(_formulas(spark, sf_dir), "p_partkey", "formula", 1e-3)
    f = f.withColumn("z", F.col("p_partkey") % 3 + 1).withColumn("mz", F.col("mass") / F.col("z") + G.PROTON)
    s = f.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("mz", "abundance"))).alias("p"))
    return G.deconvolute(s.select("p_partkey", F.col("p.mz").alias("mz"), F.col("p.abundance").alias("i")), "p_partkey", "mz", "i", 20.0, 3)


def bayes_foldchange(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice")
    return G.bayes_fold_change(li, "l_partkey", "l_returnflag", "l_extendedprice", "A", "R", 500)


CELLS_SQL = """cells AS (SELECT c_custkey, 'segment' AS name, CASE WHEN c_custkey % 5 = 0 THEN ' not available ' WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS value FROM customer
UNION ALL SELECT c_custkey, 'nation', CASE WHEN c_acctbal > 0 THEN c_nationkey::VARCHAR END FROM customer
UNION ALL SELECT c_custkey, 'pool', 'Pool' || CASE c_custkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE ' ' END || (c_nationkey % 4) FROM customer),
k AS (SELECT name, value, lower(trim(coalesce(value, ''))) AS v, lower(trim(coalesce(value, ''))) IN ('', 'not available', 'not applicable', 'n/a', 'na', 'null', 'none') AS absent FROM cells)"""

QUERIES = {
    "sdrf_coverage": (
        sdrf_coverage,
        f"""WITH {CELLS_SQL} SELECT name, count(*) AS n_rows, count(*) FILTER (WHERE NOT absent) AS n_filled, count(*) FILTER (WHERE absent) AS n_absent,
count(DISTINCT v) FILTER (WHERE NOT absent) AS n_distinct, round(count(*) FILTER (WHERE NOT absent) / count(*), 6) AS fill_rate FROM k GROUP BY 1""",
    ),
    "sdrf_drift": (
        sdrf_drift,
        f"""WITH {CELLS_SQL} SELECT name, regexp_replace(v, '[\\s_-]+', '', 'g') AS form, count(DISTINCT value) AS n_variants, count(*) AS n_rows FROM k WHERE NOT absent GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""",
    ),
    "sdrf_validate": (
        sdrf_validate,
        """SELECT * FROM (SELECT 'missing column' AS issue, 'c_region' AS subject, 1::BIGINT AS n UNION ALL SELECT 'broken rule', 'balance', count(*) FILTER (WHERE NOT coalesce(c_acctbal >= 0, false)) FROM customer
UNION ALL SELECT 'broken rule', 'segment', count(*) FILTER (WHERE NOT coalesce(c_mktsegment <> '', false)) FROM customer
UNION ALL SELECT 'repeated key', 'c_nationkey,c_mktsegment', count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)) WHERE n > 0""",
    ),
    "mass_trace": (mass_trace, None),
    "trace_correct": (trace_correct, None),
    "isotope_distribution": (isotope_distribution, None),
    "deconvolute": (deconvolute, None),
    "bayes_foldchange": (bayes_foldchange, None),
}
