"""The numbered queries, and those among them that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm import hmm, licenses, quality
from massif.llm.exact import exact_dedup
from massif.llm.jaccard import near_components
from massif.llm.lines import line_dedup
from massif.llm.mixing import mix
from massif.llm.negatives import hard_negatives
from massif.llm.packing import pack
from massif.llm.phrases import remove_repeats
from massif.llm.rules import judge
from massif.llm.simhash import near_dedup
from massif.llm.tandem import periodic_runs
from massif.runtime import table


def op8_exact_dedup(spark, sf_dir):
    out = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t"""

def op9_license_scan(spark, sf_dir):
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "sentence_ids", "n_known", F.array_join("licences", " ").alias("licences"), "n_matches")


def license_sql() -> str:
    """The scan as DuckDB SQL, from the same fixed tables: one step a rule, each on what the ones before have left."""
    known = ", ".join(f"('{s}', '{letter}')" for s, letter in licenses.LETTERS.items())
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    letter = lambda x: f"m[regexp_replace({norm(x)}, '{licenses.OPENING}', 'under ')]"
    steps = ["r0 AS (SELECT doc_id, ids, ids AS l, CAST([] AS VARCHAR[]) AS f, 0 AS n FROM ids)"]
    for i, (name, letters) in enumerate(licenses.RULES):
        p = licenses.rule_pattern(letters)
        hits = f"len(regexp_extract_all(l, '{p}'))"
        steps.append(f"r{i + 1} AS (SELECT doc_id, ids, regexp_replace(l, '{p}', '{licenses.USED}', 'g') AS l, CASE WHEN {hits} > 0 THEN list_append(f, '{name}') ELSE f END AS f, n + {hits} AS n FROM r{i})")
    return f"""
WITH known(sentence, letter) AS (VALUES {known}),
m AS (SELECT map(list(sentence), list(letter)) AS m FROM known),
parts AS (SELECT doc_id, text, m, string_split(regexp_replace(coalesce(text, ''), '([.;:!?])[ \t\r\n]+|\n[ \t\r]*\n', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents, m),
sentences AS (SELECT doc_id, text, m, list_filter(flatten(list_transform(p, lambda s: CASE WHEN {letter('s')} IS NOT NULL THEN [s] ELSE string_split(s, chr(10)) END)), lambda s: {norm('s')} <> '') AS p FROM parts),
ids AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '{licenses.HINT}') THEN array_to_string(list_transform(p, lambda s: coalesce({letter('s')}, '.')), '') ELSE '' END AS ids FROM sentences),
{", ".join(steps)}
SELECT doc_id, ids AS sentence_ids, CAST(length(replace(ids, '.', '')) AS INT) AS n_known, array_to_string(list_sort(list_distinct(f)), ' ') AS licences, CAST(n AS INT) AS n_matches FROM r{len(licenses.RULES)}"""


def op10_simhash_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_hmm_scores(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"), edits=2, chars_per_edit=12).withColumnRenamed("id", "doc_id")


def op4_repeated_passages(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op7_packing(spark, sf_dir):
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)
    return out.drop("ids").withColumnRenamed("id", "doc_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, told by the crc32 of their ids, end in words that repeat with a period.

    With h that checksum, g = floor(h / 10), n words and a = g % n, each word i >= a becomes word a + (i - a) % p with
    p = 1 + floor((n - a) / (3 + g % 8)). Rows with a null id keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    w = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != "")).alias("w"))
    g = F.floor(F.col("h") / 10)
    w = w.withColumns({"n": F.size("w"), "g": g}).withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return w.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    out = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    return out.drop("starts", "lengths", "periods").withColumnRenamed("id", "doc_id")


def op12_jaccard_join(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": (pipeline, None),
    "op1_quality_classifier": (op1_quality_classifier, None),
    "op2_hmm_scores": (op2_hmm_scores, None),
    "op3_line_dedup": (op3_line_dedup, None),
    "op4_repeated_passages": (op4_repeated_passages, None),
    "op5_mixing": (op5_mixing, None),
    "op6_quality_rules": (op6_quality_rules, None),
    "op7_packing": (op7_packing, None),
    "op8_exact_dedup": (op8_exact_dedup, OP8_SQL),
    "op9_license_scan": (op9_license_scan, license_sql()),
    "op10_simhash_near_dedup": (op10_simhash_near_dedup, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_jaccard_join": (op12_jaccard_join, None),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
