"""Gradient-boosted trees over columns of numbers, fitted on a bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 20_000
ROUNDS, DEPTH, SEED = 20, 4, 11


def bounded_sample(rows: DataFrame, key: Column, most: int = SAMPLE_ROWS) -> DataFrame:
    """About ``most`` rows, all if there are fewer, chosen by a hash of the key."""
    total = rows.count()
    if total <= most:
        return rows
    share = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1_000_000))
    return rows.where(share < int(1_000_000 * most / total))


def fit_trees(sample: DataFrame) -> GBTClassificationModel | None:
    """Fit on (features array<double>, label double); None if there are not two labels."""
    rows = sample.select(array_to_vector("features").alias("features"), "label")
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, seed=SEED).fit(rows)


def with_probability(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """Replace ``features`` by ``probability`` of label 1."""
    vectors = rows.withColumn("features", array_to_vector("features"))
    scored = model.transform(vectors)
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "prediction"
    )
