"""Boosted trees on the feature table with pyspark.ml."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ordinals
from .metrics import with_weights

#: Parameters of both models.
TREES = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.02, "subsamplingRate": 0.4, "featureSubsetStrategy": "0.4", "seed": 42}
RESULT = ["symbol", "Datetime", "position", "part", "actual_d", "predicted_d", "confidence", "actual_p", "predicted_p"]


def split(rows: DataFrame, test_share: float = 0.2, by_time: bool = False) -> DataFrame:
    """rows with part: the last ceil(share * n) rows in (symbol, time) order are test,
    or with by_time those of each symbol. Each row is numbered where it is, so that
    repeated (symbol, Datetime) stay as many rows as they are."""
    names = rows.columns
    apart = rows.select("symbol", "Datetime", F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    numbered = ordinals(apart, whole=not by_time)
    if by_time:
        n = rows.groupBy("symbol").agg(F.count("*").alias("__n"))
        numbered = numbered.join(n, "symbol")
        train = F.col("position") < F.col("__n") - F.ceil(F.col("__n") * test_share)
    else:
        n = rows.count()
        train = F.col("global_position") < n - math.ceil(test_share * n)
    return numbered.select(*[F.col("__row").getField(c).alias(c) for c in names], F.when(train, "train").otherwise("test").alias("part"))


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def fit(train: DataFrame, features: list[str], **changes):
    """(classifier of target_d on balanced weights, regressor of target_p)."""
    options = TREES | changes
    rows = assemble(with_weights(train), features).select("features", F.col("target_d").cast("double").alias("target_d"), "target_p", "weight").persist()
    try:
        tree = GBTClassifier(labelCol="target_d", featuresCol="features", **options).setRawPredictionCol("margins")
        classifier = OneVsRest(classifier=tree, labelCol="target_d", featuresCol="features", weightCol="weight", predictionCol="predicted_d", rawPredictionCol="margins", parallelism=3).fit(rows)
        regressor = GBTRegressor(labelCol="target_p", featuresCol="features", predictionCol="predicted_p", **options).fit(rows)
    finally:
        rows.unpersist()
    return classifier, regressor


def predict(models, rows: DataFrame, features: list[str]) -> DataFrame:
    """The result table: actual and predicted class, confidence (the largest of the
    normalised logistic margins), actual and predicted return."""
    classifier, regressor = models
    valued = classifier.transform(regressor.transform(assemble(rows, features)))
    odds = F.transform(vector_to_array("margins"), lambda m: 1 / (1 + F.exp(-2 * m)))
    confidence = F.array_max("odds") / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return valued.withColumn("odds", odds).select("symbol", "Datetime", "position", "part", F.col("target_d").cast("int").alias("actual_d"), F.col("predicted_d").cast("int").alias("predicted_d"), confidence.alias("confidence"), F.col("target_p").alias("actual_p"), "predicted_p")


def importances(models, features: list[str], spark) -> DataFrame:
    """Mean importance of each feature over the classifier's models, largest first."""
    trees = models[0].models
    rows = [(name, float(sum(t.featureImportances[i] for t in trees) / len(trees))) for i, name in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
