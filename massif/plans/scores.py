"""Score queries over part names and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import scores as S
from massif.plans.sequence import SEQ_SQL, _sequences
from massif.runtime import table


def cze_mobility(spark, sf_dir):
    s = _sequences(spark, sf_dir).withColumn("mu", S.mobility(F.col("seq"), 500.0 + F.col("p_partkey")))
    return s.select("p_partkey", F.round("mu", 6).alias("mu"), F.round(S.elution_minutes(F.col("mu")), 4).alias("minutes"))


def composite_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(S.composite(F.col("value") / 50, F.col("user_id") % 10), 6).alias("score"))


def rt_calibration(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("rt"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 20.0 + F.col("p_retailprice")).alias("irt"))
    return S.calibrate(p, "rt", "irt", "calibrated").select("p_partkey", F.round("calibrated", 4).alias("calibrated"))


def tic_normalisation(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return S.tic_normalised(ev, "user_id", "value", True).select("event_id", F.round("value", 6).alias("value"))


def mbr_score(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 7).cast("double").alias("rt_error"), (F.col("event_id") % 11).cast("double").alias("ppm_error"))
    return S.transfer_score(ev, {"value": (25.0, 10.0), "rt_error": (0.0, 2.0), "ppm_error": (0.0, 4.0)}).select("event_id", F.round("mbr_score", 6).alias("mbr_score"))


def _case(table_, letter):
    return "CASE " + letter + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + " ELSE 0 END"


CHARGE_SQL = (
    "1.0 + length(regexp_replace(seq, '[^RKH]', '', 'g')) + CASE WHEN length(seq) < 6 THEN 0 ELSE "
    + " + ".join([_case(t, f"substr(seq, {i + 1}, 1)") for i, t in enumerate(S.N_TERMINAL)] + [_case(t, f"substr(seq, length(seq) - {i}, 1)") for i, t in enumerate(S.C_TERMINAL)])
    + "".join(f" + CASE WHEN contains(substr(seq, 4, length(seq) - 5), '{k}') THEN {v} ELSE 0 END" for k, v in S.INTERNAL.items())
    + " END"
)

QUERIES = {
    "cze_mobility": (
        cze_mobility,
        f"""WITH {SEQ_SQL}, m AS (SELECT p_partkey, 3.069 + 386 * ln(1.0 + 0.35 * ({CHARGE_SQL})::DOUBLE) / power(500.0 + p_partkey, 0.411) AS mu FROM s)
SELECT p_partkey, round(mu, 6) AS mu, round(1e9 / (60 * 300000.0 * mu), 4) AS minutes FROM m""",
    ),
    "composite_score": (composite_score, "SELECT event_id, round(CASE WHEN user_id % 10 >= 3 THEN value / 50 * log2(1 + user_id % 10) END, 6) AS score FROM events"),
    "rt_calibration": (
        rt_calibration,
        """WITH p AS (SELECT p_partkey, p_retailprice AS rt, CASE WHEN p_partkey % 3 = 0 THEN p_size * 20.0 + p_retailprice END AS irt FROM part), f AS (SELECT regr_slope(irt, rt) AS a, regr_intercept(irt, rt) AS b FROM p)
SELECT p_partkey, round(a * rt + b, 4) AS calibrated FROM p, f""",
    ),
    "tic_normalisation": (
        tic_normalisation,
        """WITH t AS (SELECT user_id, sum(value) AS t FROM events GROUP BY 1), m AS (SELECT avg(t) AS m FROM t) SELECT event_id, round(value / t * m, 6) AS value FROM events JOIN t USING (user_id), m""",
    ),
    "mbr_score": (mbr_score, None),
}
