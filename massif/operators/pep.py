"""Posterior error probabilities from gradient-boosted trees."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_probabilities(df: DataFrame, features: list[str], decoy: Column, group: str, folds: int = 3, rounds: int = 10, depth: int = 3) -> DataFrame:
    """df with pep: 1 less the probability of being a target, from trees trained on the other folds.

    Rows of one group (donor or peptide) are all in one fold. Missing features count as 0. Training and scoring are Spark jobs; nothing is collected.
    """
    ready = df.select("*", (~decoy).cast("double").alias("_label"), F.pmod(F.xxhash64(group), F.lit(folds)).alias("_fold"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)])
    ready = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_features").transform(ready).persist()
    parts = []
    for k in range(folds):
        trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=rounds, maxDepth=depth, seed=1, predictionCol="_p")
        trees = trees.setProbabilityCol("_prob").setRawPredictionCol("_raw")
        model = trees.fit(ready.where(F.col("_fold") != k))
        parts.append(model.transform(ready.where(F.col("_fold") == k)).withColumn("pep", 1 - vector_to_array("_prob")[1]))
    return reduce(DataFrame.unionByName, parts).select(*df.columns, "pep")
