"""Label-free quantification queries: suppliers as runs, parts as sequences, line items as peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import lfq as L
from massif.plans.sequence import _sequences
from massif.runtime import table


def _peaks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("run"), F.col("l_partkey").alias("sequence"), (F.col("l_quantity") + F.col("l_partkey") % 40).alias("rt"), F.col("l_extendedprice").alias("intensity"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak"), F.col("l_discount").alias("q"), F.col("l_returnflag").alias("flag"),
    )


def psm_peptide_join(spark, sf_dir):
    m = _peaks(spark, sf_dir).where("q < 0.02").select("sequence", "peak")
    p = table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("sequence"))
    return L.match_to_peptides(m, p, "sequence", "peak")


def mbr_donors(spark, sf_dir):
    return L.donors(_peaks(spark, sf_dir), "run", "sequence", "intensity", "q", 0.01)


def mbr_calibration(spark, sf_dir):
    return L.calibration_pairs(_peaks(spark, sf_dir), "run", "sequence", "rt", "intensity", 1, 2)


def mbr_anchor_shift(spark, sf_dir):
    p = _peaks(spark, sf_dir)
    pairs = L.calibration_pairs(p, "run", "sequence", "rt", "intensity", 1, 2).select("donor_rt", "acceptor_rt").distinct()
    t = p.where("run = 1")
    out = L.anchor_shift(t.groupBy("peak").agg(F.max("rt").alias("rt")), "peak", "rt", pairs)
    return out.select("peak", "n_anchors", F.round("shift", 4).alias("shift"), F.round("spread", 4).alias("spread"))


def peak_conflicts(spark, sf_dir):
    p = _peaks(spark, sf_dir).withColumn("kind", F.when(F.col("flag") == "R", "MSMS").otherwise("MBR")).withColumn("sequence", F.lpad(F.col("sequence").cast("string"), 6, "0"))
    p = p.withColumn("apex", F.floor(F.col("intensity") / 200).cast("long"))
    return L.resolve_peaks(p, ["run", "apex"], "kind", "sequence", "intensity", "peak")


def replicate_normalisation(spark, sf_dir):
    p = _peaks(spark, sf_dir).groupBy("sequence", "run").agg(F.sum("intensity").alias("value"))
    return L.replicate_factors(p, "sequence", "run", "value", 0).select("run", F.round("factor", 6).alias("factor"))


def normalise_to_100(spark, sf_dir):
    p = _peaks(spark, sf_dir).select("run", "peak", "sequence", "intensity")
    return L.share_of_group(p, ["run"], "intensity").select("run", "peak", "sequence", F.round("intensity", 8).alias("share"))


def median_deviation(spark, sf_dir):
    return L.deviation(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def fraction_ambiguity(spark, sf_dir):
    p = _peaks(spark, sf_dir).groupBy("sequence", "run").agg(F.sum("intensity").alias("value"), F.max("flag").alias("flag"))
    return L.fraction_rule(p, "sequence", "run", "value", F.col("flag") == "A").select("sequence", "run", F.round("value", 4).alias("value"))


def greedy_envelopes(spark, sf_dir):
    p = _peaks(spark, sf_dir).groupBy("run", "sequence").agg(F.max("intensity").alias("score"), F.collect_set((F.col("rt") % 50).cast("long")).alias("members"))
    return L.greedy_selection(p, ["run"], "score", "members").select("run", "sequence", "score")


def modified_forms(spark, sf_dir):
    return L.modified_forms(_sequences(spark, sf_dir), "seq", {"M": "Oxidation", "S": "Phospho"}).select("p_partkey", "form", "n_mods")


PEAKS_SQL = """p AS (SELECT l_suppkey % 10 AS run, l_partkey AS sequence, l_quantity + l_partkey % 40 AS rt, l_extendedprice AS intensity, l_orderkey * 10 + l_linenumber AS peak, l_discount AS q, l_returnflag AS flag FROM lineitem)"""
PAIRS_SQL = PEAKS_SQL + """,
b AS (SELECT run, sequence, arg_max(rt, (intensity, -rt)) AS rt FROM p WHERE run IN (1, 2) GROUP BY 1, 2),
c AS (SELECT d.sequence, d.rt AS donor_rt, a.rt AS acceptor_rt FROM b d JOIN b a ON d.sequence = a.sequence AND d.run = 1 AND a.run = 2)"""

QUERIES = {
    "psm_peptide_join": (
        psm_peptide_join,
        f"""WITH {PEAKS_SQL}, m AS (SELECT sequence, count(*) AS n, min(peak) AS f FROM p WHERE q < 0.02 GROUP BY 1)
SELECT p_partkey AS sequence, coalesce(n, 0) AS n_matches, f AS first_match FROM part LEFT JOIN m ON m.sequence = p_partkey WHERE p_size < 30""",
    ),
    "mbr_donors": (
        mbr_donors,
        f"""WITH {PEAKS_SQL}, g AS (SELECT sequence, run, max(intensity) AS score FROM p WHERE q < 0.01 GROUP BY 1, 2), r AS (SELECT DISTINCT run AS acceptor FROM p),
x AS (SELECT acceptor, g.*, row_number() OVER (PARTITION BY acceptor, sequence ORDER BY score DESC, run) AS k FROM g JOIN r ON run <> acceptor
WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.sequence = g.sequence AND o.run = acceptor))
SELECT acceptor, sequence, run AS donor, score FROM x WHERE k = 1""",
    ),
    "mbr_calibration": (mbr_calibration, f"WITH {PAIRS_SQL} SELECT sequence, donor_rt, acceptor_rt FROM c"),
    "mbr_anchor_shift": (
        mbr_anchor_shift,
        f"""WITH {PAIRS_SQL}, a AS (SELECT DISTINCT donor_rt, acceptor_rt - donor_rt AS s FROM c), t AS (SELECT peak, max(rt) AS rt FROM p WHERE run = 1 GROUP BY 1),
n AS (SELECT peak, s, row_number() OVER (PARTITION BY peak, donor_rt >= rt ORDER BY abs(donor_rt - rt), donor_rt, s) AS k FROM t JOIN a ON abs(donor_rt - rt) <= 0.5)
SELECT peak, count(*) AS n_anchors, round(median(s), 4) AS shift, round(stddev_samp(s), 4) AS spread FROM n WHERE k <= 3 GROUP BY 1""",
    ),
    "peak_conflicts": (
        peak_conflicts,
        f"""WITH {PEAKS_SQL}, k AS (SELECT run, floor(intensity / 200)::BIGINT AS apex, flag = 'R' AS own, lpad(sequence::VARCHAR, 6, '0') AS sequence, intensity, peak FROM p)
SELECT run, apex, CASE WHEN bool_or(own) THEN 'MSMS' ELSE 'MBR' END AS kind,
CASE WHEN bool_or(own) THEN array_to_string(list_sort(list(DISTINCT sequence) FILTER (WHERE own)), '|') ELSE arg_max(sequence, (intensity, -peak)) FILTER (WHERE NOT own) END AS sequence,
coalesce(max(intensity) FILTER (WHERE own), max(intensity) FILTER (WHERE NOT own)) AS intensity, count(*) AS n_peaks FROM k GROUP BY 1, 2""",
    ),
    "replicate_normalisation": (
        replicate_normalisation,
        f"""WITH {PEAKS_SQL}, v AS (SELECT sequence, run, sum(intensity) AS value FROM p GROUP BY 1, 2)
SELECT v.run, round(CASE WHEN v.run = 0 THEN 1 ELSE 1 / median(v.value / r.value) END, 6) AS factor FROM v JOIN v r ON r.sequence = v.sequence AND r.run = 0 GROUP BY 1""",
    ),
    "normalise_to_100": (normalise_to_100, f"WITH {PEAKS_SQL} SELECT run, peak, sequence, round(intensity / sum(intensity) OVER (PARTITION BY run) * 100, 8) AS share FROM p"),
    "median_deviation": (
        median_deviation,
        """WITH m AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS m FROM events)
SELECT event_type, round(max(m), 6) AS median, round(median(abs(value - m)), 6) AS mad FROM m GROUP BY 1""",
    ),
    "fraction_ambiguity": (
        fraction_ambiguity,
        f"""WITH {PEAKS_SQL}, v AS (SELECT sequence, run, sum(intensity) AS value, max(flag) AS flag FROM p GROUP BY 1, 2), t AS (SELECT sequence, arg_max(flag, (value, run)) = 'A' AS bad FROM v GROUP BY 1)
SELECT sequence, run, round(CASE WHEN bad THEN 0 ELSE value END, 4) AS value FROM v JOIN t USING (sequence)""",
    ),
    "greedy_envelopes": (greedy_envelopes, None),
    "modified_forms": (modified_forms, None),
}
