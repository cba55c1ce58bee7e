"""Sequence, formula and modification queries: upper-case letters of part names as sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import chemistry as C
from massif.operators import modifications as M
from massif.operators import notation as N
from massif.operators import sequence as S
from massif.runtime import table


def _sequences(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.upper(F.concat("p_name", "p_type", "p_name")), "[^A-Z]", "").alias("seq"))
    return p.withColumn("seq", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("M"), F.col("seq"))).otherwise(F.col("seq")))


def _digest(missed):
    def query(spark, sf_dir):
        out = S.digest(_sequences(spark, sf_dir), "seq", "KR", "P", missed, 3)
        return out.select("p_partkey", F.col("start").cast("long"), F.col("end").cast("long"), F.col("missed").cast("long"), "peptide")

    return query


def digest_semi(spark, sf_dir):
    out = S.digest_semi(_sequences(spark, sf_dir), "seq", "KR", "P", 0, 3)
    return out.select("p_partkey", F.col("start").cast("long"), F.col("end").cast("long"), "peptide")


FIXED = [M.Mod("Carbamidomethyl", "Common", "C", "Anywhere.", 57.021464)]
VARIABLE = [M.Mod("Oxidation", "Common", "M", "Anywhere.", 15.994915), M.Mod("Phospho", "Common", "S", "Anywhere.", 79.966331), M.Mod("Acetyl", "Common", "X", "N-terminal.", 42.010565)]


def modified_digest(spark, sf_dir):
    out = M.modified_digest(_sequences(spark, sf_dir), "seq", "KR", FIXED, VARIABLE, "P", missed=0, min_length=3, initiator="retain", most_mods=2, most_forms=100000)
    return out.select("p_partkey", F.col("start").cast("long"), F.col("end").cast("long"), "full_sequence", F.col("n_variable").cast("long"), F.col("n_fixed").cast("long"), F.round("mass", 4).alias("mass"))


KNOWN = [N.Known("Oxidation", "Common", "M", mass=15.994915, formula="O", unimod=35), N.Known("Phospho", "Bio", "S", mass=79.966331, formula="HO3P", unimod=21), N.Known("Acetyl", "Common", "X", "N-terminal.", 42.010565, "C2H2O", 1), N.Known("Odd", "Other", "X")]


def sequence_conversion(spark, sf_dir):
    """Named sequences in four notations, and back from masses; a third has a modification at its first end, some a kind of their own that no notation but names can hold."""
    s = _sequences(spark, sf_dir).where("seq <> ''")
    head = F.when(F.col("p_partkey") % 3 == 0, "[Common:Acetyl on X]").otherwise("")
    tail = F.when(F.col("p_partkey") % 5 == 0, "-[Other:Odd on X]").otherwise("")
    named = F.concat(head, F.replace(F.replace("seq", F.lit("S"), F.lit("S[Bio:Phospho on S]")), F.lit("M"), F.lit("M[Common:Oxidation on M]")), tail)
    s = s.withColumn("named", named)
    made = {way: N.convert(F.col("named"), way, KNOWN, "named", mode) for way, mode in (("mass", "remove"), ("unimod", "null"), ("proforma", "remove"), ("primary", "null"))}
    out = s.select("p_partkey", *[c.alias(way) for way, c in made.items()])
    back = N.convert(F.col("mass.text"), "named", KNOWN)
    return out.select("p_partkey", *[F.col(f"{way}.text").alias(way) for way in made], F.size("mass.lost").cast("long").alias("n_lost"), back.getField("text").alias("back"))


def decoy_reverse(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", S.decoy_reverse(F.col("seq")).alias("decoy"))


def decoy_slide(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", S.decoy_slide(F.col("seq")).alias("decoy"))


def fragment_masses(spark, sf_dir):
    out = S.fragments(_sequences(spark, sf_dir), "seq", ("b",), ("y",))
    return out.select("p_partkey", "ion", F.col("number").cast("long"), F.round("mass", 4).alias("mass"))


def peptide_mass(spark, sf_dir):
    return _sequences(spark, sf_dir).select("p_partkey", F.round(S.peptide_mass(F.col("seq")), 4).alias("mass"))


def _formulas(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("H"), s, F.lit("C"), s + 3, F.lit("NO"), s % 7 + 2, F.when(s % 2 == 0, F.lit("S")).otherwise(F.lit(""))).alias("formula"))


def formula_parse(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", F.explode(C.atoms(F.col("formula"))).alias("a")).select("p_partkey", F.col("a.element").alias("element"), F.col("a.count").cast("long").alias("n"))


def formula_mass(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", F.round(C.formula_mass(F.col("formula")), 4).alias("mass"))


def formula_hill(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", C.hill(F.col("formula")).alias("hill"))


def mz_from_mass(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_size") % 5 + 1).alias("z"))
    mz = C.to_mz(F.col("p_retailprice"), F.col("z"))
    return p.select("p_partkey", F.round(mz, 6).alias("mz"), F.round(C.to_mass(mz, F.col("z")), 6).alias("mass"))


def electrospray_series(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(C.electrospray(F.col("p_retailprice"), 1, 5)).alias("e"))
    return p.select("p_partkey", F.col("e.charge").cast("long").alias("charge"), F.round("e.mz", 6).alias("mz"))


def _modified(spark, sf_dir):
    n = F.upper("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.when(F.col("p_size") % 3 == 0, F.lit("[Common:Acetyl on X]")).otherwise(F.lit("")), F.substring(n, 1, 3), F.lit("[Mod:"), F.col("p_type"), F.lit("]"), F.substring(n, 4, 2)).alias("full"),
    )


def strip_mods(spark, sf_dir):
    return _modified(spark, sf_dir).select("p_partkey", S.base_sequence(F.col("full")).alias("base"))


def parse_mods(spark, sf_dir):
    return _modified(spark, sf_dir).select("p_partkey", F.explode(S.modifications(F.col("full"))).alias("position", "mod")).select("p_partkey", F.col("position").cast("long"), "mod")


def _intervals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")
    start = (F.col("l_linenumber") * 7).cast("long")
    return li.select(F.col("l_orderkey").alias("protein"), start.alias("start"), F.least(F.lit(100), start + F.col("l_quantity").cast("long")).alias("end"), F.lit(100).cast("long").alias("length"), "l_extendedprice", "l_partkey")


def coverage_fraction(spark, sf_dir):
    return S.coverage(_intervals(spark, sf_dir), "protein", "start", "end", "length").select("protein", "covered", F.round("fraction", 6).alias("fraction"))


def site_occupancy(spark, sf_dir):
    i = _intervals(spark, sf_dir).withColumn("site", F.when(F.col("l_partkey") % 4 == 0, F.col("start") + 1))
    out = S.occupancy(i, ["protein"], "start", "end", "site", "l_extendedprice")
    return out.select("protein", "position", "n_modified", "n_total", F.round("fraction", 6).alias("fraction"), F.round("stoichiometry", 6).alias("stoichiometry"))


def proteoform_level(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", S.proteoform_level(k % 2 == 0, k % 3 == 0, k % 5 < 3, k % 7 < 4).alias("level"))


def envelope_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.abs(F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate("abcd")])
    return e.select("vec_id", F.round(S.envelope_score(F.col("a"), F.col("b") * 50, F.col("c"), F.col("d")), 6).alias("score"))


SEQ_SQL = """s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE '' END || regexp_replace(upper(p_name || p_type || p_name), '[^A-Z]', '', 'g') AS seq FROM part)"""
SITES_SQL = SEQ_SQL + """,
c AS (SELECT p_partkey, seq, unnest(range(1, length(seq))) AS p FROM s),
k AS (SELECT p_partkey, seq, p FROM c WHERE substr(seq, p, 1) IN ('K', 'R') AND substr(seq, p + 1, 1) <> 'P'
      UNION SELECT p_partkey, seq, 0 FROM s UNION SELECT p_partkey, seq, length(seq) FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p) AS i FROM k),
d AS (SELECT a.p_partkey, a.seq, a.p + 1 AS st, b.p AS en, b.i - a.i - 1 AS missed FROM n a JOIN n b ON a.p_partkey = b.p_partkey AND b.i > a.i)"""
MASS_SQL = "map {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in C.RESIDUES.items()) + "}"
FORMULA_SQL = "f AS (SELECT p_partkey, 'H' || p_size || 'C' || (p_size + 3) || 'NO' || (p_size % 7 + 2) || CASE WHEN p_size % 2 = 0 THEN 'S' ELSE '' END AS formula, p_size AS s FROM part)"
MOD_SQL = """f AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '[Common:Acetyl on X]' ELSE '' END || substr(upper(p_name), 1, 3) || '[Mod:' || p_type || ']' || substr(upper(p_name), 4, 2) AS full_seq FROM part)"""
INTERVAL_SQL = """i AS (SELECT l_orderkey AS protein, l_linenumber * 7 AS st, least(100, l_linenumber * 7 + l_quantity::BIGINT) AS en, l_extendedprice AS v, CASE WHEN l_partkey % 4 = 0 THEN l_linenumber * 7 + 1 END AS site FROM lineitem)"""


def digest_sql(missed: int) -> str:
    return f"""WITH {SITES_SQL},
e AS (SELECT p_partkey, seq, st, en, missed FROM d WHERE missed <= {missed} UNION ALL SELECT p_partkey, seq, 2, en, missed FROM d WHERE missed <= {missed} AND st = 1 AND seq LIKE 'M%')
SELECT p_partkey, st AS start, en AS "end", missed, substr(seq, st, en - st + 1) AS peptide FROM e WHERE en - st + 1 >= 3"""


QUERIES = {
    "digest_full": (_digest(0), digest_sql(0)),
    "digest_missed": (_digest(2), digest_sql(2)),
    "digest_semi": (
        digest_semi,
        f"""WITH {SITES_SQL}, m AS (SELECT * FROM d WHERE missed = 0),
e AS (SELECT p_partkey, seq, st, unnest(range(st, en + 1)) AS en FROM m UNION SELECT p_partkey, seq, unnest(range(st, en + 1)), en FROM m)
SELECT p_partkey, st AS start, en AS "end", substr(seq, st, en - st + 1) AS peptide FROM e WHERE en - st + 1 >= 3""",
    ),
    "modified_digest": (
        modified_digest,
        f"""WITH {SITES_SQL}, q AS (SELECT p_partkey, seq, st, en FROM d WHERE missed = 0 AND en - st + 1 >= 3),
r AS (SELECT p_partkey, st, en, unnest(range(st, en + 1)) AS i, seq FROM q), l AS (SELECT p_partkey, st, en, i, substr(seq, i, 1) AS c FROM r),
v AS (SELECT p_partkey, st, en, i - st + 2 AS place FROM l WHERE c IN ('M', 'S') UNION ALL SELECT p_partkey, st, en, 1 FROM q WHERE st <= 2),
f AS (SELECT p_partkey, st, en, 0 AS a, 0 AS b FROM q UNION ALL SELECT p_partkey, st, en, place, 0 FROM v UNION ALL SELECT x.p_partkey, x.st, x.en, x.place, y.place FROM v x JOIN v y ON x.p_partkey = y.p_partkey AND x.st = y.st AND x.en = y.en AND x.place < y.place)
SELECT f.p_partkey, f.st AS start, f.en AS "end", CASE WHEN 1 IN (a, b) THEN '[Common:Acetyl]' ELSE '' END || string_agg(c || CASE WHEN i - f.st + 2 IN (a, b) THEN CASE c WHEN 'M' THEN '[Common:Oxidation]' ELSE '[Common:Phospho]' END WHEN c = 'C' THEN '[Common:Carbamidomethyl]' ELSE '' END, '' ORDER BY i) AS full_sequence,
(a > 0)::BIGINT + (b > 0)::BIGINT AS n_variable, count(*) FILTER (WHERE c = 'C') AS n_fixed,
round(CASE WHEN count(*) = count({MASS_SQL}[c]) THEN {C.WATER} + sum({MASS_SQL}[c] + CASE WHEN i - f.st + 2 IN (a, b) THEN CASE c WHEN 'M' THEN 15.994915::DOUBLE ELSE 79.966331::DOUBLE END WHEN c = 'C' THEN 57.021464::DOUBLE ELSE 0 END) + CASE WHEN 1 IN (a, b) THEN 42.010565::DOUBLE ELSE 0 END END, 4) AS mass
FROM f JOIN l ON l.p_partkey = f.p_partkey AND l.st = f.st AND l.en = f.en GROUP BY f.p_partkey, f.st, f.en, a, b""",
    ),
    "sequence_conversion": (
        sequence_conversion,
        f"""WITH {SEQ_SQL}, t AS (SELECT p_partkey, seq, translate(seq, 'SM', chr(1) || chr(2)) AS x, p_partkey % 3 = 0 AS h, p_partkey % 5 = 0 AS o FROM s WHERE seq <> ''),
f AS (SELECT *, replace(replace(x, chr(1), 'S[+79.966331]'), chr(2), 'M[+15.994915]') AS m, replace(replace(x, chr(1), 'S[UNIMOD:21]'), chr(2), 'M[UNIMOD:35]') AS u, replace(replace(x, chr(1), 'S[Phospho]'), chr(2), 'M[Oxidation]') AS p,
  replace(replace(x, chr(1), 'S[Bio:Phospho on S]'), chr(2), 'M[Common:Oxidation on M]') AS n FROM t)
SELECT p_partkey, CASE WHEN h THEN '[+42.010565]' ELSE '' END || m AS mass, CASE WHEN NOT o THEN CASE WHEN h THEN '[UNIMOD:1]' ELSE '' END || u END AS unimod, CASE WHEN h THEN '[Acetyl]-' ELSE '' END || p || CASE WHEN o THEN '-[Odd]' ELSE '' END AS proforma,
seq AS "primary", o::BIGINT AS n_lost, CASE WHEN h THEN '[Common:Acetyl on X]' ELSE '' END || n AS back FROM f""",
    ),
    "decoy_reverse": (decoy_reverse, f"WITH {SEQ_SQL} SELECT p_partkey, CASE WHEN seq LIKE 'M%' THEN 'M' || reverse(substr(seq, 2)) ELSE reverse(seq) END AS decoy FROM s"),
    "decoy_slide": (
        decoy_slide,
        f"""WITH {SEQ_SQL}, b AS (SELECT p_partkey, CASE WHEN seq LIKE 'M%' THEN 'M' ELSE '' END AS h, CASE WHEN seq LIKE 'M%' THEN substr(seq, 2) ELSE seq END AS body FROM s),
x AS (SELECT p_partkey, h, body, length(body) AS n, unnest(range(0, length(body))) AS i FROM b),
y AS (SELECT *, ((CASE WHEN i % 2 = 0 THEN i + 20 ELSE i - 20 END) % (2 * n) + 2 * n) % (2 * n) AS f FROM x)
SELECT p_partkey, max(h) || string_agg(substr(body, (CASE WHEN f < n THEN f ELSE 2 * n - 1 - f END)::INT + 1, 1), '' ORDER BY i) AS decoy FROM y GROUP BY 1""",
    ),
    "fragment_masses": (
        fragment_masses,
        f"""WITH {SEQ_SQL}, x AS (SELECT p_partkey, length(seq) AS n, seq, unnest(range(1, length(seq) + 1)) AS i FROM s),
m AS (SELECT p_partkey, n, i, {MASS_SQL}[substr(seq, i, 1)] AS m FROM x),
b AS (SELECT p_partkey, n, i, m, sum(m) OVER w AS up, count(*) FILTER (WHERE m IS NULL) OVER w AS bu, sum(m) OVER v AS down, count(*) FILTER (WHERE m IS NULL) OVER v AS bd FROM m
  WINDOW w AS (PARTITION BY p_partkey ORDER BY i), v AS (PARTITION BY p_partkey ORDER BY i DESC))
SELECT p_partkey, 'b' AS ion, i AS number, round(up, 4) AS mass FROM b WHERE i < n AND bu = 0 UNION ALL SELECT p_partkey, 'y', n - i + 1, round(down + {C.WATER}, 4) FROM b WHERE i > 1 AND bd = 0""",
    ),
    "peptide_mass": (
        peptide_mass,
        f"""WITH {SEQ_SQL}, x AS (SELECT p_partkey, {MASS_SQL}[unnest(string_split(seq, ''))] AS m FROM s)
SELECT p_partkey, round(CASE WHEN count(*) = count(m) THEN sum(m) + {C.WATER} END, 4) AS mass FROM x GROUP BY 1""",
    ),
    "formula_parse": (
        formula_parse,
        f"""WITH {FORMULA_SQL} SELECT p_partkey, e[1] AS element, CASE WHEN e[2] = '' THEN 1 ELSE e[2]::BIGINT END AS n FROM
(SELECT p_partkey, unnest(list_transform(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*'), lambda t: [regexp_extract(t, '([A-Z][a-z]?)', 1), regexp_extract(t, '[0-9]+')])) AS e FROM f)""",
    ),
    "formula_mass": (
        formula_mass,
        f"""WITH {FORMULA_SQL} SELECT p_partkey, round(s::DOUBLE * {C.ISOTOPES['H'][0][0]} + (s + 3)::DOUBLE * 12.0 + {C.ISOTOPES['N'][0][0]}::DOUBLE + (s % 7 + 2) * {C.ISOTOPES['O'][0][0]}
+ CASE WHEN s % 2 = 0 THEN {C.ISOTOPES['S'][0][0]} ELSE 0 END, 4) AS mass FROM f""",
    ),
    "formula_hill": (
        formula_hill,
        f"WITH {FORMULA_SQL} SELECT p_partkey, 'C' || (s + 3) || 'H' || CASE WHEN s = 1 THEN '' ELSE s::VARCHAR END || 'N' || 'O' || (s % 7 + 2) || CASE WHEN s % 2 = 0 THEN 'S' ELSE '' END AS hill FROM f",
    ),
    "mz_from_mass": (
        mz_from_mass,
        f"SELECT p_partkey, round(p_retailprice / (p_size % 5 + 1) + {C.PROTON}, 6) AS mz, round(p_retailprice, 6) AS mass FROM part",
    ),
    "electrospray_series": (
        electrospray_series,
        f"SELECT p_partkey, charge, round(p_retailprice / charge + {C.PROTON}, 6) AS mz FROM part, (SELECT unnest(range(1, 6)) AS charge)",
    ),
    "strip_mods": (strip_mods, f"WITH {MOD_SQL} SELECT p_partkey, regexp_replace(full_seq, '\\[[^\\]]*\\]', '', 'g') AS base FROM f"),
    "parse_mods": (
        parse_mods,
        """SELECT p_partkey, 3::BIGINT AS position, 'Mod:' || p_type AS mod FROM part UNION ALL SELECT p_partkey, 0, 'Common:Acetyl on X' FROM part WHERE p_size % 3 = 0""",
    ),
    "coverage_fraction": (
        coverage_fraction,
        f"""WITH {INTERVAL_SQL}, u AS (SELECT DISTINCT protein, unnest(range(st, en + 1)) AS r FROM i)
SELECT protein, count(*) AS covered, round(count(*) / 100.0, 6) AS fraction FROM u GROUP BY 1""",
    ),
    "site_occupancy": (
        site_occupancy,
        f"""WITH {INTERVAL_SQL}, p AS (SELECT DISTINCT protein, site AS pos FROM i WHERE site IS NOT NULL)
SELECT protein, pos::BIGINT AS position, count(*) FILTER (WHERE site = pos) AS n_modified, count(*) AS n_total, round(count(*) FILTER (WHERE site = pos) / count(*), 6) AS fraction,
round(coalesce(sum(v) FILTER (WHERE site = pos), 0) / sum(v), 6) AS stoichiometry FROM i JOIN p USING (protein) WHERE pos BETWEEN st AND en GROUP BY 1, 2""",
    ),
    "proteoform_level": (
        proteoform_level,
        """WITH b AS (SELECT p_partkey, p_partkey % 2 = 0 AS l, p_partkey % 3 = 0 AS m, p_partkey % 5 < 3 AS s, p_partkey % 7 < 4 AS g FROM part),
u AS (SELECT *, (NOT l)::INT + (NOT m)::INT + (NOT s)::INT + (NOT g)::INT AS u FROM b)
SELECT p_partkey, CASE u WHEN 0 THEN '1' WHEN 2 THEN '3' WHEN 3 THEN '4' WHEN 4 THEN '5' ELSE CASE WHEN NOT l THEN '2A' WHEN NOT m THEN '2B' WHEN NOT s THEN '2C' ELSE '2D' END END AS level FROM u""",
    ),
    "envelope_score": (
        envelope_score,
        """SELECT vec_id, round(1 / (1 + exp(-(3.4494 * abs(embedding[1]::DOUBLE) - 1.6341 * abs(embedding[2]::DOUBLE) * 50 + 4.7795 * abs(embedding[3]::DOUBLE) + 2.1883 * abs(embedding[4]::DOUBLE) + 4.3142))), 6) AS score FROM embeddings""",
    ),
}
