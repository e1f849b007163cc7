"""Models, metrics, chart tables, and the driver's entry."""

import importlib
import json
import math

import pytest
from pyspark.sql import functions as F

from candleworks import queries
from candleworks.operators import chart, metrics, model
from candleworks.plans.chart import chart_tables, write_chart
from candleworks.plans.features import FEATURE_COLUMNS, model_table
from candleworks.plans.training import train_and_evaluate
from candleworks.sources.bars import kept, new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    return kept(queries.features(spark, SF))


def test_training_job(spark, features):
    outcome = train_and_evaluate(features, maxIter=2)
    rows = outcome.predictions.collect()
    assert len(FEATURE_COLUMNS) == 44 and len(rows) == features.count() == model_table(features).count()
    assert all(1 / 3 - 1e-9 <= r.confidence <= 1 and r.predicted_d in (0, 1, 2) for r in rows)
    assert {r.part: r.accuracy for r in outcome.accuracy.collect()}["train"] > 0.4
    assert outcome.diagnosis.first().diagnosis in ("Overfit", "Underfit", "Seems healthy")
    found = outcome.importances.collect()
    assert sorted(r.feature for r in found) == sorted(FEATURE_COLUMNS) and sum(r.importance for r in found) == pytest.approx(1)
    assert [r.importance for r in found] == sorted((r.importance for r in found), reverse=True)


def test_split_is_ordered_and_weights_balance(features):
    rows = model.split(features)
    test = rows.where("part = 'test'")
    n = features.count()
    assert test.count() == -(-n // 5)
    assert rows.where("part = 'train'").agg(F.max("symbol")).first()[0] <= test.agg(F.min("symbol")).first()[0]
    weighted = metrics.with_weights(features)
    by = weighted.groupBy("target_d").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(n / len(by)) for r in by)


def test_metrics_of_constants(spark):
    schema = "part string, actual_d int, predicted_d int, actual_p double, predicted_p double"
    same = spark.createDataFrame([("train", 1, 1, 2.0, 2.0), ("train", 1, 0, 2.0, 2.0), ("test", 1, 1, 2.0, 3.0)], schema)
    r2 = {r.part: r.r2 for r in metrics.regression(same).collect()}
    assert r2 == {"train": 1.0, "test": 0.0}
    report = {r.label: r for r in metrics.class_report(same).collect()}
    assert report["0"].precision == 0 and report["0"].support == 0 and report["1"].recall == pytest.approx(2 / 3)


def test_confusion_takes_all_labels_that_occur(spark):
    schema = "actual_d int, predicted_d int"
    table = metrics.confusion(spark.createDataFrame([(0, 7), (0, 0), (2, 0), (2, None)], schema))
    assert table.columns == ["actual_d", "predicted_0", "predicted_2", "predicted_7"]
    assert sorted(map(tuple, table.collect())) == [(0, 1, 0, 1), (2, 1, 0, 0), (7, 0, 0, 0)]


def test_predictions_and_importances_come_from_the_trees(spark, features):
    """Recomputed from the fitted trees, one by one."""
    rows = kept(model.split(model_table(features)))
    classifier, regressor = model.fit(rows.where("part = 'train'"), FEATURE_COLUMNS, maxIter=4)
    found = {(r.symbol, r.position): r for r in model.predict((classifier, regressor), rows, FEATURE_COLUMNS).collect()}
    margin = lambda m, x: sum(w * t.predict(x) for w, t in zip(m.treeWeights, m.trees, strict=True))
    for r in model.assemble(rows, FEATURE_COLUMNS).limit(40).collect():
        got = found[r.symbol, r.position]
        odds = [1 / (1 + math.exp(-2 * margin(m, r.features))) for m in classifier.models]
        assert got.confidence == pytest.approx(max(odds) / sum(odds)) and got.predicted_d == odds.index(max(odds))
        assert got.predicted_p == pytest.approx(margin(regressor, r.features)) and (got.actual_d, got.part) == (r.target_d, r.part)
    table = {r.feature: r.importance for r in model.importances((classifier, regressor), FEATURE_COLUMNS, spark).collect()}
    for i, name in enumerate(FEATURE_COLUMNS):
        assert table[name] == pytest.approx(sum(m.featureImportances[i] for m in classifier.models) / 3)


def test_split_keeps_repeated_bars(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", i) for i in range(6)] + [("b", "2024-01-02", 9)] * 4, "symbol string, Datetime string, position int").withColumn("Datetime", F.col("Datetime").cast("timestamp"))
    for by_time, test in ((False, 2), (True, 3)):
        found = model.split(rows, by_time=by_time)
        assert found.columns == [*rows.columns, "part"] and found.count() == 10 and found.where("part = 'test'").count() == test


def test_chart_tables(spark, features):
    tables = chart_tables(features, "view", 100)
    rows = tables["rows"].collect()
    assert tables["default"].first().symbol == "view"
    assert max(r.n for r in tables["rows"].groupBy("symbol").agg(F.count("*").alias("n")).collect()) <= 100
    assert {"symbol", "time", "swingHigh", "supportAnchor1Position", "resistanceAnchor2Price"} <= set(rows[0].asDict())
    kinds = {r.kind for r in tables["markers"].collect()}
    assert kinds <= {"SH", "SL", "BO", "BD"} and kinds
    anchors = {(r.symbol, r.side): r for r in chart.latest_anchors(tables["rows"]).collect()}
    for r in tables["rays"].collect():
        a = anchors[r.symbol, r.side]
        slope = (a.anchor2Price - a.anchor1Price) / (a.anchor2Position - a.anchor1Position)
        assert r.value == pytest.approx(a.anchor1Price + slope * (r.position - a.anchor1Position))
    parts = chart.payload_json(features, "view", 5).collect()
    whole = {r.field: json.loads(r.json) for r in parts if r.symbol is None}
    assert whole == {"symbols": sorted({r.symbol for r in rows}), "defaultSymbol": "view", "defaultCandleCount": 5, "candleCountOptions": [100, 200, 300, 500, 1000]}
    series, records = {}, chart.records(features)
    for r in sorted((r for r in parts if r.field == "series"), key=lambda r: (r.symbol, r.page)):
        page = json.loads(r.json)
        assert 0 < len(page) <= 5 and all(x["position"] // 5 == r.page for x in page)
        series.setdefault(r.symbol, []).extend(page)
    assert sorted(series) == whole["symbols"]
    for symbol, one in series.items():
        want = [r.position for r in records.where(F.col("symbol") == symbol).orderBy("position").collect()]
        assert [x["position"] for x in one] == want and "supportAnchor1Price" in one[0]
    with pytest.raises(ValueError, match="symbols"):
        chart.payload_json(features.limit(0), "view")
    path = new_path(spark)
    write_chart(features, path)
    assert spark.read.json(path).count() == features.count()
    with pytest.raises(ValueError):
        chart.records(features.drop("swing_low"))


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["m11_distances", "m12_breakouts", "n01_records", "k05_latest_anchors", "u02_markers", "p02_model_table"])
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
