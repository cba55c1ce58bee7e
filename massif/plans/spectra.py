"""Spectrum queries: embeddings as intensity arrays, events as peaks (scan = user, m/z = event id, intensity = value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import spectra as S
from massif.runtime import table


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    a, b = e.select("vec_id", F.col("v").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    return a.join(b, "vec_id")


def _similarity(name, normalised):
    def query(spark, sf_dir):
        p = _pairs(spark, sf_dir)
        if normalised:
            p = p.select("vec_id", S.sum_normalised(F.col("a")).alias("a"), S.sum_normalised(F.col("b")).alias("b"))
        return p.select("vec_id", F.round(S.SIMILARITIES[name](F.col("a"), F.col("b")), 6).alias("similarity"))

    return query


PAIRS_SQL = """e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings),
r AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"""
NORMED_SQL = PAIRS_SQL.replace("r AS (", "raw AS (") + """,
r AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b FROM raw)"""
Z = "list_zip(a, b)"
DOT, AA, BB = "list_dot_product(a, b)", "list_dot_product(a, a)", "list_dot_product(b, b)"
SQ = f"list_sum(list_transform({Z}, lambda z: (z[1] - z[2]) ** 2))"
H = "list_sum(list_transform({0}, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END))"
SIMILARITY_SQL = {
    "cosine": (False, f"{DOT} / sqrt({AA} * {BB})"),
    "angle": (False, f"1 - 2 * acos(least(1.0, {DOT} / sqrt({AA} * {BB}))) / pi()"),
    "euclid": (True, f"1 - sqrt({SQ})"),
    "braycurtis": (True, f"1 - list_sum(list_transform({Z}, lambda z: abs(z[1] - z[2]))) / (list_sum(a) + list_sum(b))"),
    "pearson": (False, "(SELECT corr(z[1], z[2]) FROM (SELECT unnest(list_transform(list_zip(a, b), lambda z: [z[1], z[2]])) AS z))"),
    "dot": (True, DOT),
    "entropy": (True, f"1 - (2 * {H.format(f'list_transform({Z}, lambda z: (z[1] + z[2]) / 2)')} - {H.format('a')} - {H.format('b')}) / ln(4)"),
    "kl": (True, f"list_sum(list_transform({Z}, lambda z: z[1] * ln(z[1] / z[2])))"),
    "searle": (True, f"ln(1 / {SQ})"),
}


def _peaks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("scan"), F.col("event_id").alias("mz"), F.col("value").alias("intensity"))


def peak_topk_window(spark, sf_dir):
    return S.top_k_per_window(_peaks(spark, sf_dir), "scan", "mz", "intensity", 1000.0, 2).select("scan", "mz", "intensity", "window")


def basepeak_filter(spark, sf_dir):
    return S.base_peak_filter(_peaks(spark, sf_dir), "scan", "intensity", 0.25)


def xcorr_preprocess(spark, sf_dir):
    return S.xcorr_preprocess(_peaks(spark, sf_dir).where("intensity >= 0"), "scan", "mz", "intensity").select("scan", "bin", F.round("value", 4).alias("value"))


def peak_windows(spark, sf_dir):
    p = _peaks(spark, sf_dir).withColumn("mz", F.col("mz").cast("double"))
    wide = S.filter_windows(p, "scan", "mz", "intensity", 300.0, 1e7, ratio=0.1, width=700.0, k=3, normalise=True).withColumn("mode", F.lit("width"))
    many = S.filter_windows(p, "scan", "mz", "intensity", 0.0, 10000.0, n_windows=12, k=2).withColumn("mode", F.lit("number"))
    whole = S.filter_windows(p, "scan", "mz", "intensity", 100.0, 5000.0, ratio=0.5, normalise=True).withColumn("mode", F.lit("whole"))
    out = wide.unionAll(many).unionAll(whole)
    return out.select("mode", "scan", "mz", F.round("intensity", 6).alias("intensity"), "window")


def xcorr_spectrum(spark, sf_dir):
    p = _peaks(spark, sf_dir).select("scan", (150 + (F.col("mz") * 37 + F.col("scan") * 11) % 1500 + (F.col("mz") % 10) / 10.0).alias("mz"), "intensity", (400.0 + F.col("scan") % 500).alias("precursor"))
    return S.xcorr_spectrum(p, "scan", "mz", "intensity", "precursor", 150.0, 1650.0).select("scan", F.round("mz", 4).alias("mz"), F.round("value", 5).alias("value"))


def _order_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    a = o.select("o_custkey", F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("e"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("y"), F.col("o_totalprice").alias("t"))
    return a.join(b, "o_custkey").where("x < y")


def tolerance_ppm(spark, sf_dir):
    return _order_pairs(spark, sf_dir).where(S.within_ppm(F.col("e"), F.col("t"), 20000)).select("x", "y")


def tolerance_abs(spark, sf_dir):
    return _order_pairs(spark, sf_dir).where(S.within_abs(F.col("e"), F.col("t"), 500)).select("x", "y")


def tolerance_notch(spark, sf_dir):
    return _order_pairs(spark, sf_dir).where(S.within_notch(F.col("e") / 1000, F.col("t") / 1000, 2000, 2)).select("x", "y")


def minmax_clip(spark, sf_dir):
    return S.min_max_clip(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


def percentile_clip(spark, sf_dir):
    return S.percentile_clip(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", 0.1)


def below_threshold(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") > 25, F.col("value")).otherwise(0.0).alias("value"))
    return S.below_threshold(ev, ["user_id"], "value", 0.2)


def _clip(method):
    def query(spark, sf_dir):
        return S.clip_groups(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "value", method)

    return query


def spectral_greedy_match(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    mz = F.transform("a", lambda x, i: 300 + i * 0.01)
    shifted = F.transform("b", lambda x, i: 300.002 + i * 0.01)
    p = p.select("vec_id", mz.alias("t_mz"), F.col("a").alias("t_int"), shifted.alias("e_mz"), F.col("b").alias("e_int"))
    return S.greedy_match(p, "vec_id", 40.0)


PAIR_SQL = "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE "
NOTCHES = " OR ".join(f"abs((a.o_totalprice / 1000 + {k} * {S.C13_STEP} - b.o_totalprice / 1000) / (b.o_totalprice / 1000)) * 1e6 <= 2000" for k in range(-2, 3))

QUERIES = {
    **{f"similarity_{k}": (_similarity(k, n), f"WITH {NORMED_SQL if n else PAIRS_SQL} SELECT vec_id, round({x}, 6) AS similarity FROM r") for k, (n, x) in SIMILARITY_SQL.items()},
    "peak_topk_window": (
        peak_topk_window,
        """SELECT scan, mz, intensity, "window" FROM (SELECT user_id AS scan, event_id AS mz, value AS intensity, ceil(event_id / 1000.0)::BIGINT AS "window",
row_number() OVER (PARTITION BY user_id, ceil(event_id / 1000.0) ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 2""",
    ),
    "basepeak_filter": (
        basepeak_filter,
        "SELECT scan, mz, intensity FROM (SELECT user_id AS scan, event_id AS mz, value AS intensity, max(value) OVER (PARTITION BY user_id) AS top FROM events) WHERE intensity > 0.25 * top",
    ),
    "xcorr_preprocess": (
        xcorr_preprocess,
        """WITH b AS (SELECT user_id AS scan, round(event_id / 1.0005079)::BIGINT AS bin, max(sqrt(value)) AS v FROM events WHERE value >= 0 GROUP BY 1, 2),
w AS (SELECT scan, bin, v - (sum(v) OVER (PARTITION BY scan ORDER BY bin RANGE BETWEEN 75 PRECEDING AND 75 FOLLOWING) - v) / 150 AS value FROM b)
SELECT scan, bin, round(value, 4) AS value FROM w WHERE value > 1e-4""",
    ),
    "peak_windows": (
        peak_windows,
        """WITH e AS (SELECT user_id AS scan, event_id::DOUBLE AS mz, value AS y, max(value) OVER (PARTITION BY user_id) AS top FROM events),
w AS (SELECT 'width' AS mode, scan, mz, y, greatest(ceil(mz / 700.0::DOUBLE), 1)::BIGINT AS win, true AS norm, 3 AS k FROM e WHERE mz BETWEEN 300 AND 1e7 AND y > 1e-9 AND y > 0.1::DOUBLE * top
UNION ALL SELECT 'number', scan, mz, y, greatest(ceil(mz / (10000.0::DOUBLE / 12)), 1)::BIGINT, false, 2 FROM e WHERE mz BETWEEN 0 AND 10000 AND y > 1e-9
UNION ALL SELECT 'whole', scan, mz, y, 1, true, 1000000000 FROM e WHERE mz BETWEEN 100 AND 5000 AND y > 1e-9 AND y > 0.5::DOUBLE * top),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, scan, win ORDER BY y DESC, mz) AS n, max(y) OVER (PARTITION BY mode, scan, win) AS m FROM w)
SELECT mode, scan, mz, round(CASE WHEN norm THEN y / m * 50 ELSE y END, 6) AS intensity, win AS "window" FROM r WHERE n <= k""",
    ),
    "xcorr_spectrum": (
        xcorr_spectrum,
        """WITH e AS (SELECT user_id AS scan, 150 + (event_id * 37 + user_id * 11) % 1500 + (event_id % 10) / 10.0::DOUBLE AS mz, value AS y, 400.0::DOUBLE + user_id % 500 AS p FROM events),
b AS (SELECT scan, round_even((mz - 150) / 1.0005079::DOUBLE, 0)::BIGINT AS bin, max(sqrt(y)) AS v FROM e
  WHERE round_even((mz - 150) / 1.0005079::DOUBLE, 0) BETWEEN 0 AND 1499 AND (mz <= round_even((p - 1.5) / 1.0005079::DOUBLE, 0) OR mz >= round_even((p + 1.5) / 1.0005079::DOUBLE, 0)) AND y >= 0 GROUP BY 1, 2),
t AS (SELECT *, max(v) OVER (PARTITION BY scan) AS top, bin * 1.0005079::DOUBLE + 150 * 1.0005079::DOUBLE AS at_mz FROM b),
s AS (SELECT scan, bin, at_mz, v / max(v) OVER (PARTITION BY scan, ceil(at_mz / 150.0::DOUBLE)) * 50 AS v FROM t WHERE v > 0.05::DOUBLE * top AND v > 0),
c AS (SELECT scan, at_mz, v - sum(v) OVER (PARTITION BY scan ORDER BY bin RANGE BETWEEN 75 PRECEDING AND 75 FOLLOWING) / (least(bin + 75, 1499) - greatest(bin - 75, 0) + 1) AS value FROM s)
SELECT scan, round(at_mz, 4) AS mz, round(value, 5) AS value FROM c WHERE value > 1e-4""",
    ),
    "tolerance_ppm": (tolerance_ppm, PAIR_SQL + "abs((a.o_totalprice - b.o_totalprice) / b.o_totalprice) * 1e6 <= 20000"),
    "tolerance_abs": (tolerance_abs, PAIR_SQL + "abs(a.o_totalprice - b.o_totalprice) <= 500"),
    "tolerance_notch": (tolerance_notch, PAIR_SQL + f"({NOTCHES})"),
    "minmax_clip": (
        minmax_clip,
        """SELECT event_id, event_type, value FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) WHERE value > lo AND value < hi""",
    ),
    "percentile_clip": (
        percentile_clip,
        "SELECT event_id, event_type, value FROM (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM events) WHERE value > m * (1 - 0.55) AND value < m * 1.55",
    ),
    "below_threshold": (
        below_threshold,
        """WITH e AS (SELECT event_id, user_id, CASE WHEN value > 25 THEN value ELSE 0 END AS value FROM events)
SELECT event_id, user_id, CASE WHEN avg((value > 0)::INT) OVER (PARTITION BY user_id) <= 0.2 THEN 0 ELSE value END AS value FROM e""",
    ),
    "sigma_clip": (_clip(S.sigma_kept), None),
    "averaged_sigma_clip": (_clip(S.averaged_sigma_kept), None),
    "winsorised_clip": (_clip(S.winsorised_kept), None),
    "spectral_greedy_match": (spectral_greedy_match, None),
}
