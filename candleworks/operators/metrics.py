"""Class weights, classification and regression metrics, fit diagnosis.

A table of predictions has actual_d, predicted_d, actual_p, predicted_p and part
(train or test). All metrics come from small grouped sums, the rates and errors of all
parts from one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div, flag


def class_distribution(df: DataFrame, label: str = "target_d") -> DataFrame:
    """Rows of each class, most frequent first."""
    return df.groupBy(label).count().orderBy(F.desc("count"), label)


def balanced_weights(train: DataFrame, label: str = "target_d") -> DataFrame:
    """n / (classes * rows of the class), for each class."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def with_weights(train: DataFrame, label: str = "target_d") -> DataFrame:
    """train with its class weight; the weights are one row for each class."""
    return train.join(F.broadcast(balanced_weights(train, label).select(label, "weight")), label)


def moments(predictions: DataFrame) -> DataFrame:
    """accuracy, mae, rmse and r2 of each part, from one pass: counts, sums and the mean
    and squared distance from it of the actual values, which merge from partition to
    partition. r2 of a constant: 1 without error, else 0."""
    e = F.col("actual_p") - F.col("predicted_p")
    one = predictions.groupBy("part").agg(
        F.avg(flag(F.col("actual_d") == F.col("predicted_d"))).alias("accuracy"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("__e"),
        (F.var_pop(F.when(e.isNotNull(), F.col("actual_p"))) * F.count(e)).alias("__y"),
    )
    r2 = F.when(F.col("__y") > 0, 1 - div(F.col("__e"), F.col("__y"))).when(F.col("__e") == 0, 1.0).otherwise(0.0)
    return one.select("part", "accuracy", "mae", "rmse", r2.alias("r2"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return moments(predictions).select("part", "accuracy")


def cells(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(F.col("actual_d").alias("actual"), F.col("predicted_d").alias("predicted")).agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each class, "macro avg" and "weighted
    avg"; 0 where nothing is divided by."""
    n = cells(predictions)
    label = F.explode(F.array("actual", "predicted")).alias("label")
    exploded = n.select("actual", "predicted", "n", label).where(F.col("actual").isNotNull())
    exploded = exploded.dropDuplicates(["actual", "predicted", "label"])
    by = exploded.groupBy("label").agg(
        F.sum(F.when((F.col("actual") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("actual") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
    )
    ratio = lambda a, b: F.coalesce(div(a, b), F.lit(0.0))
    by = by.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    by = by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    rows = by.select(F.col("label").cast("string").alias("label"), *names, "support")
    macro = by.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = by.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    return rows.unionByName(macro).unionByName(weighted)


def confusion(predictions: DataFrame, labels=None) -> DataFrame:
    """Counts by actual (rows) and predicted class (columns), zeros filled: of the labels
    given, or of all that occur as either. Classes are few; null is none."""
    spark = predictions.sparkSession
    if labels is None:
        either = predictions.select(F.explode(F.array("actual_d", "predicted_d")).alias("label")).where("label is not null")
        labels = sorted(r.label for r in either.distinct().collect())
    frame = spark.createDataFrame([(int(x),) for x in labels], "actual_d int")
    table = predictions.groupBy("actual_d").pivot("predicted_d", list(labels)).count()
    out = frame.join(table, "actual_d", "left").na.fill(0)
    return out.select("actual_d", *[F.col(f"`{x}`").alias(f"predicted_{x}") for x in labels])


def regression(predictions: DataFrame) -> DataFrame:
    """mae, rmse and r2 for each part."""
    return moments(predictions).select("part", "mae", "rmse", "r2")


def diagnosis(predictions: DataFrame, accuracy_gap: float = 0.20, r2_gap: float = 0.50, least: float = 0.50) -> DataFrame:
    """One row: both parts' accuracy and r2, and what they say of the fit."""
    both = moments(predictions)
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{part}_{c}")
    one = both.agg(*[of(p, c) for p in ("train", "test") for c in ("accuracy", "r2")])
    gap = (F.col("train_accuracy") - F.col("test_accuracy") > accuracy_gap) | (F.col("train_r2") - F.col("test_r2") > r2_gap)
    poor = (F.col("train_accuracy") < least) & (F.col("test_accuracy") < least)
    return one.withColumn("diagnosis", F.when(gap, "Overfit").when(poor, "Underfit").otherwise("Seems healthy"))
