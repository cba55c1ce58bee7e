"""Scan, peak and text-helper queries over events, embeddings, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import scans as S
from massif.plans.sequence import SEQ_SQL, _sequences
from massif.runtime import table


def _scans(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3 + 1).alias("level"), "value", "user_id")


def scan_filters(spark, sf_dir):
    return S.scans(_scans(spark, sf_dir), "level", "event_id", "value", [1, 2], (100, 5000), (10.0, 40.0)).select("event_id", "level", "value")


def _arrays(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x, i: (i + 1) * 10.0).alias("mz"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("i"))


def peaks_in_range(spark, sf_dir):
    p = _arrays(spark, sf_dir).select("vec_id", F.explode(S.peaks_where(F.col("mz"), F.col("i"), 100.0, 300.0, 0.1)).alias("p"))
    return p.select("vec_id", "p.mz", F.round("p.intensity", 6).alias("intensity"))


def peak_indices(spark, sf_dir):
    return _arrays(spark, sf_dir).select("vec_id", F.explode(S.indices_within(F.col("mz"), F.lit(105.0), 150000.0)).alias("place")).select("vec_id", F.col("place").cast("long"))


def tolerance_parse(spark, sf_dir):
    text = F.concat(F.lit("±"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, " PPM").when(F.col("p_size") % 3 == 1, " Absolute").otherwise(" other"))
    t = table(spark, sf_dir, "part").select("p_partkey", S.parse_tolerance(text).alias("t"))
    return t.select("p_partkey", "t.value", "t.unit")


def range_relations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lo, hi = F.col("l_partkey") % 20, F.col("l_partkey") % 20 + F.col("l_quantity").cast("long")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.range_relation(lo, hi, F.lit(10), F.lit(30)).alias("relation"))


def motif_sites(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", F.explode(S.motif_positions(F.col("seq"), "N[^P][ST]")).alias("site")).select("p_partkey", F.col("site").cast("long"))


def xic_simple(spark, sf_dir):
    return S.closest_per_scan(_scans(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "value", "event_id", 25.0, 4000.0).select("user_id", F.col("value").alias("mz"), F.col("event_id").cast("double").alias("intensity"))


def peptide_position(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    return s.select("p_partkey", S.first_occurrence(F.substring("seq", 4, 3), F.col("seq")).cast("long").alias("place"))


def sample_group_results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    return S.sample_groups(li, ["l_suppkey"], "l_returnflag", "l_linestatus", "l_quantity")


def local_extrema(spark, sf_dir):
    return S.extrema(_scans(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("event_id", "kind")


def valley_bounds(spark, sf_dir):
    return S.valley_bounds(_scans(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


def top_n_peaks(spark, sf_dir):
    return S.top_by_quantile(_scans(spark, sf_dir).select("user_id", "event_id", F.floor("value").alias("value")), "user_id", "value", 5)


def most_intense_peaks(spark, sf_dir):
    return S.most_intense(_scans(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "value", 7)


def sequence_checks(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    return s.select("p_partkey", S.is_sequence(F.col("seq")).alias("valid"), S.sanitised(F.col("seq")).alias("clean"), F.size(S.all_places(F.col("seq"), "L")).cast("long").alias("n_l"))


def file_stems(spark, sf_dir):
    path = F.concat(F.lit("C:\\data/run.v1_"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".raw").otherwise(".mzML.gz"))
    return table(spark, sf_dir, "part").select("p_partkey", S.file_stem(path).alias("stem"))


def flag_bytes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", S.flags(k % 2 == 0, k % 3 == 0, k % 5 == 0).cast("long").alias("flags"), S.loss_kind(F.when(k % 4 == 0, 18.01).when(k % 4 == 1, 17.03).when(k % 4 == 2, 0.0).otherwise(50.0)).alias("loss"))


def text_checksums(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


def fragment_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price"))
    return S.closest_match(o, "o_orderkey", "o_totalprice", li, "l_orderkey", "price", 50.0).select("o_orderkey", "l_orderkey")


def truncation_products(spark, sf_dir):
    return S.truncations(_sequences(spark, sf_dir), "seq", 4, 5).select("p_partkey", "end", F.col("removed").cast("long"), "product")


def parameter_grid(spark, sf_dir):
    return S.parameter_grid(spark, bins=[1, 2, 5], overlap=[0, 4], mode=["sum", "mean"])


def multiset_equality(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return S.same_rows(li, li.orderBy("l_quantity"))


def shared_extrema(spark, sf_dir):
    s = _scans(spark, sf_dir)
    x = S.extrema(s.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").where("kind = 'max'")
    return S.shared_extrema(x, "user_id", "event_id", 40.0, 0.3).withColumn("n_runs", F.col("n_runs").cast("long"))


def binned_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", (F.col("event_id") % 100).alias("i"))
    return S.merged_bins(e, "value", "i", 50.0).select(F.round("mz", 6).alias("mz"), "intensity", "n")


QUERIES = {
    "scan_filters": (scan_filters, "SELECT event_id, event_id % 3 + 1 AS level, value FROM events WHERE event_id % 3 + 1 IN (1, 2) AND event_id BETWEEN 100 AND 5000 AND value BETWEEN 10 AND 40"),
    "peaks_in_range": (
        peaks_in_range,
        """WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)
SELECT vec_id, (k * 10)::DOUBLE AS mz, round(abs(v::DOUBLE), 6) AS intensity FROM x WHERE k BETWEEN 10 AND 30 AND abs(v::DOUBLE) >= 0.1""",
    ),
    "peak_indices": (
        peak_indices,
        """WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) SELECT vec_id, k - 1 AS place FROM x WHERE abs(k * 10 - 105.0) / 105.0 * 1e6 <= 150000""",
    ),
    "tolerance_parse": (
        tolerance_parse,
        """SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size::DOUBLE END AS value, CASE p_size % 3 WHEN 0 THEN 'ppm' WHEN 1 THEN 'absolute' END AS unit FROM part""",
    ),
    "range_relations": (
        range_relations,
        """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 20 AS lo, l_partkey % 20 + l_quantity::BIGINT AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lo = 10 AND hi = 30 THEN 'equal' WHEN lo <= 10 AND hi >= 30 THEN 'super' WHEN lo >= 10 AND hi <= 30 THEN 'sub' WHEN least(hi, 30) < greatest(lo, 10) THEN 'none'
WHEN (least(hi, 30) - greatest(lo, 10)) * 2 >= 20 THEN 'majority' ELSE 'overlap' END AS relation FROM r""",
    ),
    "motif_sites": (
        motif_sites,
        f"""WITH {SEQ_SQL}, x AS (SELECT p_partkey, seq, unnest(range(1, length(seq) + 1)) AS i FROM s) SELECT p_partkey, i AS site FROM x WHERE regexp_matches(substr(seq, i, 3), '^N[^P][ST]$')""",
    ),
    "xic_simple": (
        xic_simple,
        """WITH n AS (SELECT user_id, arg_min(value, (abs(value - 25), value)) AS mz, arg_min(event_id, (abs(value - 25), value)) AS i FROM events WHERE abs(value - 25) / 25 * 1e6 <= 4000 GROUP BY 1)
SELECT u.user_id, n.mz, coalesce(n.i, 0)::DOUBLE AS intensity FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n USING (user_id)""",
    ),
    "peptide_position": (peptide_position, f"WITH {SEQ_SQL} SELECT p_partkey, nullif(instr(seq, substr(seq, 4, 3)), 0) AS place FROM s"),
    "sample_group_results": (
        sample_group_results,
        "SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n_matches, sum(l_quantity) AS intensity FROM lineitem GROUP BY 1, 2, 3",
    ),
    "local_extrema": (
        local_extrema,
        """WITH w AS (SELECT event_id, value, lag(value) OVER k AS a, lead(value) OVER k AS b FROM events WINDOW k AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN value > a THEN 'max' ELSE 'min' END AS kind FROM w WHERE (value > a AND value > b) OR (value < a AND value < b)""",
    ),
    "valley_bounds": (
        valley_bounds,
        """WITH a AS (SELECT user_id, arg_max(event_id, (value, -event_id)) AS apex FROM events GROUP BY 1), r AS (SELECT e.user_id, event_id, value, apex FROM events e JOIN a USING (user_id)),
l AS (SELECT *, min(value) OVER w < 0.6 * value AS rise FROM r WHERE event_id <= apex WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC)),
l2 AS (SELECT *, max(rise::INT) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS stop FROM l),
u AS (SELECT *, min(value) OVER w < 0.6 * value AS rise FROM r WHERE event_id >= apex WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
u2 AS (SELECT *, max(rise::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM u)
SELECT a.user_id, apex, (SELECT min(event_id) FROM l2 WHERE l2.user_id = a.user_id AND stop = 0) AS start, (SELECT max(event_id) FROM u2 WHERE u2.user_id = a.user_id AND stop = 0) AS "end" FROM a""",
    ),
    "top_n_peaks": (
        top_n_peaks,
        "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, floor(value)::BIGINT AS value, rank() OVER (PARTITION BY user_id ORDER BY floor(value) DESC) AS r FROM events) WHERE r <= 5",
    ),
    "most_intense_peaks": (
        most_intense_peaks,
        """WITH v AS (SELECT user_id, list_sort(list(value::DOUBLE)) AS l, count(*) AS n FROM events GROUP BY 1), h AS (SELECT *, greatest(0, 1 - 7::DOUBLE / n) AS p FROM v), g AS (SELECT *, (n + 1 / 3::DOUBLE) * p + 1 / 3::DOUBLE AS h FROM h),
c AS (SELECT user_id, CASE WHEN p = 0 OR n = 1 OR h < 1 THEN l[1] WHEN h >= n THEN l[n] ELSE l[floor(h)::INT] + (h - floor(h)) * (l[floor(h)::INT + 1] - l[floor(h)::INT]) END AS cut FROM g)
SELECT user_id, event_id, value FROM events JOIN c USING (user_id) WHERE value >= cut""",
    ),
    "sequence_checks": (
        sequence_checks,
        f"""WITH {SEQ_SQL} SELECT p_partkey, regexp_matches(seq, '^[ACDEFGHIKLMNOPQRSTUVWY]+$') AS valid, regexp_replace(seq, '[^ACDEFGHIKLMNOPQRSTUVWY]', 'X', 'g') AS clean,
length(seq) - length(replace(seq, 'L', '')) AS n_l FROM s""",
    ),
    "file_stems": (file_stems, "SELECT p_partkey, 'run.v1_' || p_partkey AS stem FROM part"),
    "flag_bytes": (
        flag_bytes,
        """SELECT p_partkey, (p_partkey % 2 = 0)::BIGINT + 2 * (p_partkey % 3 = 0)::BIGINT + 4 * (p_partkey % 5 = 0)::BIGINT AS flags,
CASE p_partkey % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'ammonia' WHEN 2 THEN 'none' ELSE 'other' END AS loss FROM part""",
    ),
    "text_checksums": (text_checksums, "SELECT item_id, sha256(text) AS digest, octet_length(encode(text)) AS n_bytes FROM benchmark"),
    "fragment_match": (
        fragment_match,
        """WITH l AS (SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
m AS (SELECT o_orderkey, arg_min(l_orderkey, (abs(o_totalprice - price), l_orderkey)) AS l_orderkey FROM orders JOIN l ON abs(o_totalprice - price) / price * 1e6 <= 50 GROUP BY 1)
SELECT o.o_orderkey, m.l_orderkey FROM orders o LEFT JOIN m USING (o_orderkey)""",
    ),
    "truncation_products": (
        truncation_products,
        f"""WITH {SEQ_SQL}, c AS (SELECT p_partkey, seq, unnest([1, 2, 3, 4]) AS i FROM s),
x AS (SELECT p_partkey, 'N' AS "end", i::BIGINT AS removed, substr(seq, i + 1) AS product FROM c UNION ALL SELECT p_partkey, 'C', i, left(seq, greatest(length(seq) - i, 0)) FROM c)
SELECT * FROM x WHERE length(product) >= 5""",
    ),
    "parameter_grid": (parameter_grid, "SELECT bins, overlap, mode FROM (SELECT unnest([1, 2, 5]) AS bins), (SELECT unnest([0, 4]) AS overlap), (SELECT unnest(['sum', 'mean']) AS mode)"),
    "multiset_equality": (multiset_equality, "SELECT true AS equal"),
    "shared_extrema": (
        shared_extrema,
        """WITH w AS (SELECT user_id, event_id, value, lag(value) OVER k AS a, lead(value) OVER k AS b FROM events WINDOW k AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT user_id, event_id FROM w WHERE value > a AND value > b), g AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (ORDER BY event_id) > 40 THEN 1 ELSE 0 END AS new FROM x),
c AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS c FROM g), n AS (SELECT count(DISTINCT user_id) AS n FROM x)
SELECT min(event_id) AS first, max(event_id) AS last, count(DISTINCT user_id) AS n_runs FROM c, n GROUP BY c, n HAVING count(DISTINCT user_id) >= 0.3 * n""",
    ),
    "binned_merge": (
        binned_merge,
        """WITH g AS (SELECT value, event_id % 100 AS i, CASE WHEN value > lag(value) OVER (ORDER BY value) * (1 + 50.0::DOUBLE * 1e-6::DOUBLE) THEN 1 ELSE 0 END AS new FROM events),
c AS (SELECT *, sum(new) OVER (ORDER BY value RANGE UNBOUNDED PRECEDING) AS c FROM g)
SELECT round(median(value), 6) AS mz, sum(i)::BIGINT AS intensity, count(*) AS n FROM c GROUP BY c""",
    ),
}
