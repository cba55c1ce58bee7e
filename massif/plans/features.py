"""Queries of features, designs, annotation texts, coverage, formulas and decoys."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import annotations as A
from massif.functions import chemistry as C
from massif.operators import features as X
from massif.operators import ranges as R
from massif.operators import sequence as S
from massif.plans.sequence import MASS_SQL, SEQ_SQL, _sequences
from massif.runtime import table


def design_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    m = e.select("vec_id", F.concat(F.lit("/runs/day/r"), F.col("vec_id") % 3, F.lit(".raw")).alias("path"), F.slice("embedding", 1, 4).alias("intensities"))
    design = spark.createDataFrame([(f"r{f}.raw", c, f"s{(f * 4 + c) % 5}") for f in range(3) for c in range(4)], "file string, channel int, sample string")
    return X.by_design(m, "path", "intensities", design).select("vec_id", "sample", F.col("channel").cast("long"), F.round(F.col("intensity").cast("double"), 6).alias("intensity"))


def unaveraged_scans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return X.left_out(e, e.where("value > 30"), ["user_id"])


def _grid(spark, sf_dir, mode):
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    grid = table(spark, sf_dir, "part").select((F.col("p_size") * 3.5).alias("point")).distinct()
    return R.nearest(ev, "value", grid, "point", mode).select("event_id", F.round("nearest", 4).alias("nearest"))


def nearest_previous(spark, sf_dir):
    return _grid(spark, sf_dir, "previous")


def nearest_next(spark, sf_dir):
    return _grid(spark, sf_dir, "next")


def feature_intensity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature"), "l_linenumber", "l_extendedprice", (F.col("l_partkey") + F.col("l_quantity") / 1000).alias("mass"))
    p = table(spark, sf_dir, "part")
    ids = p.select(F.col("p_partkey").alias("feature"), (F.col("p_partkey") + F.col("p_size") / 1000).alias("mass"))
    ids = ids.unionAll(p.select("p_partkey", F.col("p_partkey") + F.col("p_size") / 2000))
    out = X.feature_intensity(li, ids, "feature", "l_linenumber", "l_extendedprice", "mass")
    return out.select("feature", "apex_intensity", F.round("integrated", 2).alias("integrated"), "n_charges", F.round("mass_error", 4).alias("mass_error"))


def feature_filter(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_retailprice").alias("mz"), (F.col("p_size") % 5).alias("charge"), (F.col("p_partkey") % 50).alias("rt_start"), (F.col("p_partkey") % 50 + 5).alias("rt_end")
    )
    return X.features_in(f, (920.0, 1400.0), (10.0, 20.0), (1, 3)).select("p_partkey", "mz")


def group_merge(spark, sf_dir):
    m = table(spark, sf_dir, "part").select("p_brand", F.array("p_size", F.col("p_size") % 7).alias("sizes"), F.array("p_type").alias("kinds"), F.col("p_retailprice").alias("score"), "p_partkey")
    out = X.merged_groups(m, "p_brand", ["sizes", "kinds"], "score", "p_partkey")
    return out.select("p_brand", "name", F.array_join("kinds", ",").alias("kinds"), "score")


def isobaric_groups(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("base"), (F.col("l_extendedprice") / 10000).alias("mass"), F.concat(F.lit("f"), F.col("l_suppkey")).alias("form"))
    return X.isobaric_groups(f, "base", "mass", "form", 0).select("base", "mass", F.array_join("forms", ",").alias("forms"))


def similarity_prefilter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: (i + 1) * 10.0).alias("mz"), F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("i"))
    return e.select("vec_id", F.explode(X.prefiltered(F.col("mz"), F.col("i"))).alias("p")).select("vec_id", "p.mz", F.round("p.intensity", 6).alias("intensity"))


def trace_smoothing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("value")).alias("value"))
    out = R.smooth_trace(e, ["user_id"], "event_id", "value", 5)
    return out.select("event_id", F.round("weighted", 5).alias("weighted"), F.round("plain", 5).alias("plain"))


def fragment_coverage(spark, sf_dir):
    s = _sequences(spark, sf_dir).where("length(seq) > 1")
    i = F.sequence(F.lit(1), F.length("seq") - 1)
    n = F.filter(i, lambda x: (x * 7 + F.col("p_partkey")) % 3 != 0)
    c = F.filter(F.sequence(F.lit(2), F.length("seq")), lambda x: (x * 5 + F.col("p_partkey")) % 4 < 2)
    return s.select("p_partkey", F.array_join(S.fragment_coverage(F.length("seq"), n, c).cast("array<string>"), ",").alias("covered"))


def polymer_coverage(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    hits = S.residue_hits(F.col("seq"), F.array(F.substring("seq", 1, 2), F.substring("seq", 4, 3), F.lit("LE"), F.lit("AA")))
    return s.select("p_partkey", F.array_join(hits.cast("array<string>"), "").alias("hits"))


def decoy_peptide(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", S.decoy_peptide(F.col("seq"), "KR").alias("decoy"))


def rna_digest(spark, sf_dir):
    s = _sequences(spark, sf_dir).select("p_partkey", F.translate("seq", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGUACGUACGUACGUACGUACGUAC").alias("seq"))
    out = S.rna_digest(s, "seq", "G", 1, 2)
    return out.select("p_partkey", F.col("start").cast("long"), F.col("end").cast("long"), F.col("missed").cast("long"), "oligo", "five", "three")


def formula_arithmetic(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("C"), F.col("p_size"), F.lit("H"), F.col("p_size") * 2, F.lit("O2")).alias("a"))
    a, b = C.composition(F.col("a")), C.composition(F.lit("H4O2"))
    text = C.composition_text
    return p.select("p_partkey", text(C.combined(a, b)).alias("added"), text(C.combined(a, b, -1)).alias("removed"), text(C.combined(a, a)).alias("doubled"), C.contains(a, b).alias("contains"))


PRODUCTS = list(A.SHIFTS)


def product_shifts(spark, sf_dir):
    kinds = F.array(*map(F.lit, PRODUCTS))
    ions = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(kinds, ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(PRODUCTS) + 1).cast("int")).alias("product"))
    return ions.select("l_orderkey", "l_linenumber", "product", F.round(A.product_shift(F.col("product")), 5).alias("shift"))


WAYS = ("CID", "LowCID", "ETD", "EThcD")


def dissociation_fragments(spark, sf_dir):
    s, out = _sequences(spark, sf_dir), None
    for k, way in enumerate(WAYS):
        types = [A.product_types(way, end, losses=True) for end in ("first", "last")]
        own = S.fragments(s.where(F.col("p_partkey") % len(WAYS) == k), "seq", *types).select("p_partkey", "ion", F.col("number").cast("long"), F.round("mass", 4).alias("mass"))
        out = own if out is None else out.unionAll(own)
    return out


def sequence_texts(spark, sf_dir):
    s = _sequences(spark, sf_dir).where("length(seq) > 6")
    part = lambda a, b=1 << 20: F.substr(F.col("seq"), F.lit(a), F.lit(b))
    full = F.concat(F.lit("[Common:Acetyl]"), part(1, 3), F.lit("[Bio:Phospho]"), part(4, 2), F.lit("[Common:Oxidation]"), part(6))
    odd = F.concat(part(1, 3), F.lit("[1 nucleotide substitution: "), part(3, 1), F.lit("->Z on "), part(3, 1), F.lit("]"), part(4, 2), F.lit("[2+ nucleotide substitution: "), part(5, 1), F.lit("->W on "), part(5, 1), F.lit("]"), part(6))
    shifts = A.with_mass_shifts(full, {"Acetyl": 42.010565, "Phospho": 79.966331, "Oxidation": 15.994915})
    return s.select("p_partkey", A.essential_sequence(full, ["Common"]).alias("essential"), shifts.alias("shifts"), A.substituted(odd).alias("substituted"))


def annotation_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    glycans = A.localised_glycans(F.concat(F.lit("["), key, F.lit(",H5N2,0.25][7,H3,0.75]")))
    date = A.modified_date(F.when(F.col("p_size") % 3 == 0, F.lit("soon")).otherwise(F.lit("2020-02-09")), F.to_date(F.lit("1999-01-01")))
    header = A.uniprot_header(key, F.col("p_brand"), F.col("p_name"), F.lit("Homo"), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.lit("9606")))
    return p.select(
        "p_partkey", A.signed_mass(F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("-")).otherwise(F.lit("+")), F.col("p_size").cast("string"), F.lit(".5"))).alias("mass"), date.cast("string").alias("day"),
        header.alias("header"), F.size(glycans).cast("long").alias("n_glycans"), F.aggregate(glycans, F.lit(0.0), lambda s, g: s + g["site"] * g["probability"]).alias("mean_site"),
    )


def array_helpers(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("v"))
    none = F.when(F.col("l_orderkey") % 2 == 0, F.col("v"))
    return e.select("l_orderkey", F.array_join(F.slice("v", 2, 2).cast("array<string>"), ",").alias("part"), A.all_same(F.col("v")).alias("same"), A.null_or_empty(none).alias("none"))


GRID_SQL = "g AS (SELECT DISTINCT p_size * 3.5::DOUBLE AS point FROM part)"

QUERIES = {
    "design_join": (
        design_join,
        """WITH d AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS channel, embedding FROM embeddings)
SELECT vec_id, 's' || ((vec_id % 3 * 4 + channel) % 5) AS sample, channel::BIGINT AS channel, round(embedding[channel + 1]::DOUBLE, 6) AS intensity FROM d WHERE len(embedding) > channel""",
    ),
    "unaveraged_scans": (unaveraged_scans, "SELECT event_id, user_id, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 30)"),
    "nearest_previous": (nearest_previous, f"WITH {GRID_SQL} SELECT event_id, round(coalesce((SELECT max(point) FROM g WHERE point <= value), (SELECT min(point) FROM g)), 4) AS nearest FROM events"),
    "nearest_next": (nearest_next, f"WITH {GRID_SQL} SELECT event_id, round(coalesce((SELECT min(point) FROM g WHERE point >= value), (SELECT max(point) FROM g)), 4) AS nearest FROM events"),
    "feature_intensity": (
        feature_intensity,
        """WITH e AS (SELECT l_partkey AS f, max(l_extendedprice) AS i, sum(l_extendedprice) AS s, count(DISTINCT l_linenumber) AS n, arg_max(l_partkey + l_quantity / 1000, (l_extendedprice, l_quantity)) AS m FROM lineitem GROUP BY 1),
d AS (SELECT p_partkey AS f, p_partkey + p_size / 1000 AS d FROM part UNION ALL SELECT p_partkey, p_partkey + p_size / 2000 FROM part),
x AS (SELECT f, (m - d) / d * 1e6 AS x FROM e JOIN d USING (f)), b AS (SELECT f, arg_min(x, (abs(x), x)) AS x FROM x GROUP BY 1)
SELECT f AS feature, i AS apex_intensity, round(s, 2) AS integrated, n AS n_charges, round(x, 4) AS mass_error FROM e LEFT JOIN b USING (f)""",
    ),
    "feature_filter": (feature_filter, "SELECT p_partkey, p_retailprice AS mz FROM part WHERE p_retailprice BETWEEN 920 AND 1400 AND p_size % 5 BETWEEN 1 AND 3 AND p_partkey % 50 + 5 >= 10 AND p_partkey % 50 <= 20"),
    "group_merge": (
        group_merge,
        """WITH s AS (SELECT p_brand, p_size AS z FROM part UNION SELECT p_brand, p_size % 7 FROM part), n AS (SELECT p_brand, string_agg(z::VARCHAR, '|' ORDER BY z) AS name FROM s GROUP BY 1)
SELECT p_brand, name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS kinds, arg_min(p_retailprice, p_partkey) AS score FROM part JOIN n USING (p_brand) GROUP BY 1, 2""",
    ),
    "isobaric_groups": (
        isobaric_groups,
        """SELECT l_partkey AS base, round(l_extendedprice / 10000, 0) AS mass, array_to_string(list_sort(list(DISTINCT 'f' || l_suppkey)), ',') AS forms
FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1""",
    ),
    "similarity_prefilter": (
        similarity_prefilter,
        """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) SELECT vec_id, (k * 10)::DOUBLE AS mz, round(v, 6) AS intensity FROM x WHERE k >= 30 AND v > 0""",
    ),
    "trace_smoothing": (
        trace_smoothing,
        """WITH e AS (SELECT event_id, user_id, CASE WHEN user_id % 10 = 0 THEN 0::DOUBLE ELSE value END AS v FROM events),
w AS (SELECT event_id, v, row_number() OVER k - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN sum(v) OVER r = 0 THEN 'nan'::DOUBLE ELSE sum(v * v) OVER r / sum(v) OVER r END AS q, avg(v) OVER r AS a FROM e
WINDOW k AS (PARTITION BY user_id ORDER BY event_id), r AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_id, round(CASE WHEN p >= 2 AND p < n - 2 THEN q ELSE v END, 5) AS weighted, round(CASE WHEN p >= 2 AND p < n - 2 THEN a ELSE v END, 5) AS plain FROM w""",
    ),
    "fragment_coverage": (
        fragment_coverage,
        f"""WITH {SEQ_SQL}, l AS (SELECT p_partkey AS k, length(seq) AS len FROM s WHERE length(seq) > 1), n AS (SELECT k, len, unnest(range(1, len)) AS x FROM l), nn AS (SELECT * FROM n WHERE (x * 7 + k) % 3 <> 0),
c AS (SELECT k, len, unnest(range(2, len + 1)) AS x FROM l), cc AS (SELECT * FROM c WHERE (x * 5 + k) % 4 < 2), f AS (SELECT k, min(x) AS x FROM nn GROUP BY 1), later AS (SELECT nn.* FROM nn JOIN f ON nn.k = f.k AND nn.x > f.x),
r AS (SELECT k, 1 AS x FROM nn WHERE x = 1 UNION SELECT k, 1 FROM cc WHERE x = 2 UNION SELECT k, len FROM nn WHERE x = len - 1 UNION SELECT k, len FROM cc WHERE x = len
UNION SELECT a.k, a.x FROM later a JOIN nn b ON a.k = b.k AND b.x = a.x - 1 UNION SELECT a.k, a.x FROM later a JOIN cc b ON a.k = b.k AND b.x = a.x
UNION SELECT a.k, a.x + 1 FROM later a JOIN cc b ON a.k = b.k AND b.x = a.x + 2 UNION SELECT a.k, a.x FROM cc a JOIN cc b ON a.k = b.k AND b.x = a.x + 1)
SELECT l.k AS p_partkey, coalesce(string_agg(x::VARCHAR, ',' ORDER BY x), '') AS covered FROM l LEFT JOIN r ON l.k = r.k GROUP BY 1""",
    ),
    "polymer_coverage": (
        polymer_coverage,
        f"""WITH {SEQ_SQL}, p AS (SELECT p_partkey AS k, seq, unnest([1, 2, 3, 4]) AS j FROM s), q AS (SELECT k, seq, CASE j WHEN 1 THEN left(seq, 2) WHEN 2 THEN substr(seq, 4, 3) WHEN 3 THEN 'LE' ELSE 'AA' END AS p FROM p),
i AS (SELECT p_partkey AS k, unnest(range(1, length(seq) + 1)) AS i FROM s), h AS (SELECT q.k, i.i AS lo, i.i + length(p) - 1 AS hi FROM q JOIN i ON q.k = i.k AND p <> '' AND substr(seq, i.i, length(p)) = p),
n AS (SELECT i.k, i.i, count(h.lo) AS n FROM i LEFT JOIN h ON i.k = h.k AND i.i BETWEEN lo AND hi GROUP BY 1, 2)
SELECT p_partkey, coalesce(string_agg(n::VARCHAR, '' ORDER BY i), '') AS hits FROM s LEFT JOIN n ON k = p_partkey GROUP BY 1""",
    ),
    "decoy_peptide": (
        decoy_peptide,
        f"""WITH {SEQ_SQL}, x AS (SELECT p_partkey AS k, unnest(range(1, length(seq) + 1)) AS i, seq FROM s), y AS (SELECT k, i, substr(seq, i, 1) AS c FROM x),
f AS (SELECT k, i, c, row_number() OVER (PARTITION BY k ORDER BY i) AS up, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS down FROM y WHERE c NOT IN ('K', 'R')),
z AS (SELECT a.k, a.i, b.c FROM f a JOIN f b ON a.k = b.k AND a.up = b.down UNION ALL SELECT k, i, c FROM y WHERE c IN ('K', 'R'))
SELECT p_partkey, coalesce(string_agg(c, '' ORDER BY i), '') AS decoy FROM s LEFT JOIN z ON k = p_partkey GROUP BY 1""",
    ),
    "rna_digest": (
        rna_digest,
        f"""WITH {SEQ_SQL}, t AS (SELECT p_partkey AS k, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGUACGUACGUACGUACGUACGUAC') AS q FROM s), c AS (SELECT k, q, unnest(range(1, length(q))) AS p FROM t),
b AS (SELECT k, q, p FROM c WHERE substr(q, p, 1) = 'G' UNION SELECT k, q, 0 FROM t UNION SELECT k, q, length(q) FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS i FROM b),
d AS (SELECT x.k, x.q, x.p + 1 AS st, y.p AS en, y.i - x.i - 1 AS missed FROM n x JOIN n y ON x.k = y.k AND y.i IN (x.i + 1, x.i + 2))
SELECT k AS p_partkey, st AS start, en AS "end", missed, substr(q, st, en - st + 1) AS oligo, CASE WHEN st = 1 THEN 'whole' ELSE 'OH' END AS five, CASE WHEN en = length(q) THEN 'whole' ELSE 'PO4' END AS three
FROM d WHERE en - st + 1 >= 2""",
    ),
    "formula_arithmetic": (
        formula_arithmetic,
        """SELECT p_partkey, 'C' || p_size || 'H' || (p_size * 2 + 4) || 'O4' AS added, 'C' || p_size || CASE WHEN p_size = 2 THEN '' ELSE 'H' || (p_size * 2 - 4) END AS removed,
'C' || p_size * 2 || 'H' || p_size * 4 || 'O4' AS doubled, p_size >= 2 AS contains FROM part""",
    ),
    "product_shifts": (
        product_shifts,
        f"""WITH m AS (SELECT 12.0::DOUBLE AS c, 1.00782503223::DOUBLE AS h, 14.00307400443::DOUBLE AS n, 15.99491461957::DOUBLE AS o),
x(product, nc, nh, nn, no) AS (VALUES ('a', -1, 0, 0, -1), ('aStar', -1, -3, -1, -1), ('aDegree', -1, -2, 0, -2), ('b', 0, 0, 0, 0), ('bAmmoniaLoss', 0, -3, -1, 0), ('bWaterLoss', 0, -2, 0, -1), ('c', 0, 3, 1, 0), ('x', 1, 0, 0, 2),
('y', 0, 2, 0, 1), ('yAmmoniaLoss', 0, -1, -1, 1), ('yWaterLoss', 0, 0, 0, 0), ('zDot', 0, -1, -1, 1), ('zPlusOne', 0, 1, -1, 1)),
y AS (SELECT product, nc * c + nh * h + nn * n + no * o + CASE WHEN product = 'zDot' THEN 0.00054857990946::DOUBLE + 1.007276466879::DOUBLE ELSE 0 END AS shift FROM x, m),
l AS (SELECT l_orderkey, l_linenumber, list_extract({PRODUCTS!r}, CAST((l_orderkey * 7 + l_linenumber) % {len(PRODUCTS)} + 1 AS INT)) AS product FROM lineitem)
SELECT l_orderkey, l_linenumber, product, round(coalesce(shift, 0), 5) AS shift FROM l LEFT JOIN y USING (product)""",
    ),
    "dissociation_fragments": (
        dissociation_fragments,
        f"""WITH {SEQ_SQL}, x AS (SELECT p_partkey, length(seq) AS n, seq, unnest(range(1, length(seq) + 1)) AS i FROM s), m AS (SELECT p_partkey, n, i, substr(seq, i, 1) AS r, {MASS_SQL}[substr(seq, i, 1)] AS m FROM x),
b AS (SELECT p_partkey, n, i, r, sum(m) OVER w AS up, count(*) FILTER (WHERE m IS NULL) OVER w AS bu, sum(m) OVER v AS down, count(*) FILTER (WHERE m IS NULL) OVER v AS bd FROM m
  WINDOW w AS (PARTITION BY p_partkey ORDER BY i), v AS (PARTITION BY p_partkey ORDER BY i DESC)),
t(way, ion, first, shift) AS (VALUES (0, 'b', true, 0.0::DOUBLE), (0, 'bWaterLoss', true, -18.01056468403), (0, 'bAmmoniaLoss', true, -17.02654910112), (0, 'y', false, 18.01056468403), (0, 'yWaterLoss', false, 0), (0, 'yAmmoniaLoss', false, 0.98401558291),
  (1, 'b', true, 0), (1, 'bWaterLoss', true, -18.01056468403), (1, 'bAmmoniaLoss', true, -17.02654910112), (1, 'y', false, 18.01056468403), (1, 'yWaterLoss', false, 0), (1, 'yAmmoniaLoss', false, 0.98401558291), (1, 'aStar', true, -45.02146372), (1, 'aDegree', true, -46.0054793036),
  (2, 'c', true, 17.02654910112), (2, 'zDot', false, 1.99184063), (3, 'b', true, 0), (3, 'bWaterLoss', true, -18.01056468403), (3, 'bAmmoniaLoss', true, -17.02654910112), (3, 'y', false, 18.01056468403), (3, 'yWaterLoss', false, 0), (3, 'yAmmoniaLoss', false, 0.98401558291),
  (3, 'c', true, 17.02654910112), (3, 'zDot', false, 1.99184063))
SELECT p_partkey, ion, CASE WHEN first THEN i ELSE n - i + 1 END AS number, round(CASE WHEN first THEN up ELSE down END + shift, 4) AS mass FROM b JOIN t ON way = p_partkey % 4
WHERE CASE WHEN first THEN i < n AND bu = 0 ELSE i > 1 AND bd = 0 AND NOT (ion = 'zDot' AND r = 'P') END""",
    ),
    "sequence_texts": (
        sequence_texts,
        f"""WITH {SEQ_SQL} SELECT p_partkey, '[Common:Acetyl]' || left(seq, 5) || '[Common:Oxidation]' || substr(seq, 6) AS essential,
'[+42.010565]' || left(seq, 3) || '[+79.966331]' || substr(seq, 4, 2) || '[+15.994915]' || substr(seq, 6) AS shifts, left(seq, 2) || 'Z' || substr(seq, 4, 1) || 'W' || substr(seq, 6) AS substituted FROM s WHERE length(seq) > 6""",
    ),
    "annotation_texts": (
        annotation_texts,
        """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (p_size + 0.5::DOUBLE) AS mass, CASE WHEN p_size % 3 = 0 THEN '1999-01-01' ELSE '2020-02-09' END AS day,
'mz|' || p_partkey || '|' || p_brand || ' ' || p_name || ' OS=Homo' || CASE WHEN p_size % 2 = 0 THEN ' OX=9606' ELSE '' END || ' GN=' || p_type AS header, 2::BIGINT AS n_glycans, p_partkey * 0.25::DOUBLE + 5.25::DOUBLE AS mean_site FROM part""",
    ),
    "array_helpers": (
        array_helpers,
        """WITH v AS (SELECT l_orderkey, list_sort(list(l_suppkey)) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(v[2:3], ',') AS part, len(list_distinct(v)) <= 1 AS same, l_orderkey % 2 <> 0 AS none FROM v""",
    ),
}
