"""Feature table to models, predictions and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import metrics, model
from ..sources.bars import not_empty
from .features import FEATURE_COLUMNS, model_table


@dataclass
class Outcome:
    models: tuple
    predictions: DataFrame
    accuracy: DataFrame
    report: DataFrame
    confusion: DataFrame
    regression: DataFrame
    diagnosis: DataFrame
    importances: DataFrame


def train_and_evaluate(features: DataFrame, **changes) -> Outcome:
    """Split, weigh, fit, predict and score; `changes` are tree parameters."""
    rows = model.split(not_empty(model_table(features), "rows with features and targets"))
    models = model.fit(rows.where("part = 'train'"), FEATURE_COLUMNS, **changes)
    results = model.predict(models, rows, FEATURE_COLUMNS)
    test = results.where("part = 'test'")
    return Outcome(models, results, metrics.accuracy(results), metrics.class_report(test), metrics.confusion(test), metrics.regression(results), metrics.diagnosis(results), model.importances(models, FEATURE_COLUMNS, features.sparkSession))
