"""Library queries: parts and orders as library entries, customers as traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import library as L
from massif.runtime import table


def library_window_query(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", "p_type")
    return L.window_query(p, {"p_retailprice": (950.0, 1050.0), "p_size": (10, 30)}, F.col("p_type") == "PROMO").select("p_partkey", "p_retailprice", "p_size")


def _sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 4).alias("source"), F.col("o_orderkey").alias("entry"), F.round(F.col("o_totalprice") / 1e6, 3).alias("mz"), (F.col("o_orderkey") % 97 / 100).alias("q"))


def library_merge_keepfirst(spark, sf_dir):
    return L.merge_keep_first(_sources(spark, sf_dir), ["key"], "source", "entry").select("key", "source", "entry")


def library_merge_keeplast(spark, sf_dir):
    return L.merge_keep_last(_sources(spark, sf_dir), ["key"], "source").select("key", "source", "entry")


def library_merge_lowestq(spark, sf_dir):
    return L.merge_lowest_q(_sources(spark, sf_dir), ["key"], "mz", "q", ["entry"], 0.0205).select("key", "entry", "mz", "q")


def library_update(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("rt"), F.col("p_size").alias("n"))
    old = p.where("p_partkey % 3 <> 0")
    new = p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("rt") * 1.1 + 5 + F.col("n")).alias("rt"), (51 - F.col("n")).alias("n"))
    return L.update(old, new, "p_partkey", "rt", "n").select("p_partkey", F.round("rt", 4).alias("rt"), "n", "status")


def library_stats(spark, sf_dir):
    return L.statistics(table(spark, sf_dir, "part").select("p_retailprice", "p_size", "p_type", "p_brand"), "p_retailprice", "p_size", F.col("p_type") == "PROMO", "p_brand")


def _traces(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", (F.col("c_acctbal") + 2000).alias("mass"), (F.col("c_custkey") % 3).alias("charge"), (F.col("c_custkey") % 50).alias("start"), (F.col("c_custkey") % 50 + 20).alias("end")
    )


def connected_features(spark, sf_dir):
    t = _traces(spark, sf_dir)
    links = L.feature_links(t, "c_custkey", "mass", "charge", "start", "end", 20000.0, ["c_nationkey"])
    return L.features(t, links, "c_custkey").select("c_custkey", "feature")


def protein_db_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_name")
    out = L.merge_groups(p, ["p_brand", "p_type"], ["p_size"], ["p_name"])
    return out.select("p_brand", "p_type", F.array_join(F.transform("p_size", lambda x: x.cast("string")), ",").alias("sizes"), "p_name")


def doc_library_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.lit(1).alias("source"), F.col("doc_id").alias("entry"))
    b = table(spark, sf_dir, "benchmark").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.lit(0).alias("source"), F.col("item_id").alias("entry"))
    return L.merge_keep_first(d.unionByName(b), ["key"], "source", "entry")


SOURCES_SQL = """e AS (SELECT o_custkey AS key, o_orderkey % 4 AS source, o_orderkey AS entry, round(o_totalprice / 1e6, 3) AS mz, o_orderkey % 97 / 100 AS q FROM orders)"""

QUERIES = {
    "library_window_query": (
        library_window_query,
        "SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice BETWEEN 950 AND 1050 AND p_size BETWEEN 10 AND 30 AND p_type <> 'PROMO'",
    ),
    "library_merge_keepfirst": (
        library_merge_keepfirst,
        f"WITH {SOURCES_SQL} SELECT key, source, entry FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, entry) AS k FROM e) WHERE k = 1",
    ),
    "library_merge_keeplast": (
        library_merge_keeplast,
        f"WITH {SOURCES_SQL} SELECT key, source, entry FROM (SELECT *, max(source) OVER (PARTITION BY key) AS last FROM e) WHERE source = last",
    ),
    "library_merge_lowestq": (
        library_merge_lowestq,
        f"""WITH {SOURCES_SQL}, g AS (SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY key ORDER BY mz, entry) > 0.0205 THEN 1 ELSE 0 END AS gap FROM e),
r AS (SELECT *, sum(gap) OVER (PARTITION BY key ORDER BY mz, entry) AS run FROM g)
SELECT key, entry, mz, q FROM (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY q, entry) AS k FROM r) WHERE k = 1""",
    ),
    "library_update": (
        library_update,
        """WITH o AS (SELECT p_partkey, p_retailprice AS rt, p_size AS n FROM part WHERE p_partkey % 3 <> 0),
w AS (SELECT p_partkey, p_retailprice * 1.1 + 5 + p_size AS rt, 51 - p_size AS n FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT regr_slope(o.rt, w.rt) AS a, regr_intercept(o.rt, w.rt) AS b FROM o JOIN w USING (p_partkey))
SELECT p_partkey, round(CASE WHEN w.n IS NULL OR o.n >= w.n THEN o.rt ELSE a * w.rt + b END, 4) AS rt, CASE WHEN w.n IS NULL OR o.n >= w.n THEN o.n ELSE w.n END AS n,
CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL OR o.n >= w.n THEN 'retained' ELSE 'replaced' END AS status FROM o FULL JOIN w USING (p_partkey), f""",
    ),
    "library_stats": (
        library_stats,
        """SELECT sum((p_type <> 'PROMO')::INT)::BIGINT AS n_targets, sum((p_type = 'PROMO')::INT)::BIGINT AS n_decoys, min(p_retailprice) AS min_mz, max(p_retailprice) AS max_mz,
min(p_size) AS min_rt, max(p_size) AS max_rt, count(DISTINCT p_brand) AS n_groups FROM part""",
    ),
    "connected_features": (
        connected_features,
        """WITH RECURSIVE t AS (SELECT c_custkey AS id, c_nationkey AS n, c_acctbal + 2000 AS m, c_custkey % 3 AS z, c_custkey % 50 AS s, c_custkey % 50 + 20 AS e FROM customer),
l AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.n = b.n AND a.id <> b.id AND a.z <> b.z AND a.s <= b.e AND b.s <= a.e AND (greatest(a.m, b.m) - least(a.m, b.m)) / least(a.m, b.m) * 1e6 <= 20000),
r AS (SELECT id, id AS root FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT id AS c_custkey, min(root) AS feature FROM r GROUP BY 1""",
    ),
    "protein_db_merge": (
        protein_db_merge,
        "SELECT p_brand, p_type, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes, min(p_name) AS p_name FROM part GROUP BY 1, 2",
    ),
    "doc_library_dedup": (
        doc_library_dedup,
        """WITH e AS (SELECT sha256(coalesce(text, '')) AS key, 1 AS source, doc_id AS entry FROM documents UNION ALL SELECT sha256(coalesce(text, '')), 0, item_id FROM benchmark)
SELECT key, source, entry FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, entry) AS k FROM e) WHERE k = 1""",
    ),
}
