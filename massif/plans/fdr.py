"""Target-decoy queries over events: value is the score, errors are the decoys."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import fdr, pep
from massif.runtime import table



def qvalue_target_decoy(spark, sf_dir):
    return fdr.q_values(table(spark, sf_dir, "events").select("value", "event_type"), "value", F.col("event_type") == "error", 2).select("score", F.round("q", 6).alias("q"))


def fdr_threshold(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("s"), "event_type")
    return fdr.fdr_threshold(ev, "s", F.col("event_type") == "error", 0.3).select(F.round("threshold", 6).alias("threshold"))


def double_decoy_fdr(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    out = fdr.double_decoy(ev, [F.desc("value"), F.col("event_id")], F.col("user_id") % 2 == 0, F.col("event_id") % 3 == 0)
    return out.select("event_id", F.round("fdr", 6).alias("fdr"))


def running_pep_fdr(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    out = fdr.running_mean_fdr(ev, [F.desc("value"), F.col("event_id")], 1 / (1 + F.col("value")))
    return out.select("event_id", F.round("fdr", 6).alias("fdr"))


def pep_gbt(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (F.col("event_id") % 13).alias("charge"))
    ev = ev.withColumn("score", F.col("value") + F.when(F.col("event_type") == "error", 0.0).otherwise(20.0))
    return pep.error_probabilities(ev, ["score", "charge"], F.col("event_type") == "error", "user_id", rounds=4).select("event_id", F.round("pep", 6).alias("pep"))


QUERIES = {
    "pep_gbt": (pep_gbt, None),
    "qvalue_target_decoy": (
        qvalue_target_decoy,
        """WITH t AS (SELECT round(value, 2) AS s, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS d FROM events GROUP BY 1),
c AS (SELECT s, sum(d) OVER (ORDER BY s DESC) AS d, sum(n - d) OVER (ORDER BY s DESC) AS t, sum(d) OVER () AS all_d FROM t)
SELECT s AS score, round(CASE WHEN all_d = 0 THEN 0 ELSE min(least(1.0, (d + 1)::DOUBLE / greatest(t, 1))) OVER (ORDER BY s DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END, 6) AS q FROM c""",
    ),
    "fdr_threshold": (
        fdr_threshold,
        """WITH t AS (SELECT round(value / 1000, 6) AS s, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS d FROM events GROUP BY 1),
c AS (SELECT s, sum(d) OVER (ORDER BY s DESC) AS d, sum(n - d) OVER (ORDER BY s DESC) AS t FROM t),
q AS (SELECT s, min(least(1.0, (d + 1)::DOUBLE / greatest(t, 1))) OVER (ORDER BY s DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM c)
SELECT round(coalesce(least(min(s) FILTER (WHERE q <= 0.3), 1.0), 1.0), 6) AS threshold FROM q""",
    ),
    "double_decoy_fdr": (
        double_decoy_fdr,
        """WITH f AS (SELECT event_id, value, user_id % 2 = 0 AS dp, event_id % 3 = 0 AS rt FROM events),
c AS (SELECT event_id, value, sum((rt AND NOT dp)::INT) OVER w AS pk, sum((dp AND NOT rt)::INT) OVER w AS pe, sum((dp AND rt)::INT) OVER w AS b, count(*) OVER w AS n
      FROM f WINDOW w AS (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(min(round((1 + pk + greatest(0, pe - b))::DOUBLE / n, 6)) OVER (ORDER BY value DESC, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS fdr FROM c""",
    ),
    "running_pep_fdr": (
        running_pep_fdr,
        "SELECT event_id, round(avg(1 / (1 + value)) OVER (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING), 6) AS fdr FROM events",
    ),
}
