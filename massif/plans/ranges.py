"""Range, nearest, trace and window queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import ranges as R
from massif.runtime import table


def range_join_ppm(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    p = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", (F.col("l_extendedprice") * 2).alias("price"))
    return R.ppm_join(o, p, "o_totalprice", "price", 20.0).select("o_orderkey", "l_orderkey")


def nearest_lookup(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    grid = table(spark, sf_dir, "part").select((F.col("p_size") * 3.5).alias("point")).distinct()
    return R.nearest(ev, "value", grid, "point").select("event_id", F.round("nearest", 4).alias("nearest"))


def _hours(spark, sf_dir):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    ev = table(spark, sf_dir, "events").select("user_id", hour.alias("hour"), "value")
    return ev.groupBy("user_id", "hour").agg(F.max("value").alias("intensity"))


def xic_islands(spark, sf_dir):
    return R.islands(_hours(spark, sf_dir), ["user_id"], "hour", 1).select("user_id", "hour", F.col("island").cast("long"))


def xic_summary(spark, sf_dir):
    x = R.islands(_hours(spark, sf_dir), ["user_id"], "hour", 1).withColumn("mz", F.col("hour") * 1.0)
    out = R.summarise_islands(x.where("intensity > 0"), ["user_id"], "hour", "mz", "intensity")
    return out.select("user_id", F.col("island").cast("long"), "start", "end", "apex", "apex_intensity", "n_points", F.round("mean_mz", 3).alias("mean_mz"))


def precursor_backfill(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = R.backfill(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "event_id", "precursor")
    return out.where("event_type = 'purchase'").select("event_id", "precursor")


def scan_averaging_sliding(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.sliding_average(ev, ["user_id"], "event_id", "value", 5, 4).select("user_id", "window", "center", F.round("mean", 6).alias("mean"))


def boxcar_smooth(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.boxcar(ev, ["user_id"], "event_id", "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


def mz_binning_average(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") % 7 + 1).cast("double").alias("i"))
    return R.binned_average(ev, "user_id", "value", "i", 0.5).select("bin", F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"))


HOURS_SQL = "h AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS hour, max(value) AS intensity FROM events GROUP BY 1, 2)"
ISLANDS_SQL = HOURS_SQL + """,
n AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) > 2 THEN 1 ELSE 0 END AS new FROM h),
i AS (SELECT user_id, hour, intensity, sum(new) OVER (PARTITION BY user_id ORDER BY hour)::BIGINT AS island FROM n)"""

QUERIES = {
    "range_join_ppm": (
        range_join_ppm,
        """SELECT o_orderkey, l_orderkey FROM orders JOIN lineitem ON l_linenumber = 1 AND abs(o_totalprice - l_extendedprice * 2) / (l_extendedprice * 2) * 1e6 <= 20.0""",
    ),
    "nearest_lookup": (
        nearest_lookup,
        """WITH g AS (SELECT DISTINCT p_size * 3.5::DOUBLE AS point FROM part)
SELECT event_id, round((SELECT arg_min(point, (abs(point - value), -point)) FROM g), 4) AS nearest FROM events""",
    ),
    "xic_islands": (xic_islands, f"WITH {ISLANDS_SQL} SELECT user_id, hour, island FROM i"),
    "xic_summary": (
        xic_summary,
        f"""WITH {ISLANDS_SQL} SELECT user_id, island, min(hour) AS start, max(hour) AS "end", arg_max(hour, (intensity, -hour)) AS apex, max(intensity) AS apex_intensity,
count(*) AS n_points, round(sum(hour * intensity) / sum(intensity), 3) AS mean_mz FROM i WHERE intensity > 0 GROUP BY 1, 2""",
    ),
    "precursor_backfill": (
        precursor_backfill,
        """SELECT event_id, precursor FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS precursor FROM events) WHERE event_type = 'purchase'""",
    ),
    "scan_averaging_sliding": (
        scan_averaging_sliding,
        """WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS k, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) AS m,
lag(event_id, 2) OVER w AS center FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, k - 5 AS "window", center, round(m, 6) AS mean FROM r WHERE k >= 5""",
    ),
    "boxcar_smooth": (
        boxcar_smooth,
        """SELECT event_id, round(m, 6) AS smooth FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE n = 5""",
    ),
    "mz_binning_average": (
        mz_binning_average,
        """WITH h AS (SELECT min(value) AS lo, count(DISTINCT user_id) AS n FROM events)
SELECT floor((value - lo) / 0.5)::BIGINT AS bin, round(avg(value), 6) AS mz, round(sum(event_id % 7 + 1) / max(n), 6) AS intensity FROM events, h GROUP BY 1""",
    ),
}
