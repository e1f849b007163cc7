"""CSV by name with refused rows; the layout of a folder for each symbol."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candleworks.sources import bars as source
from tests.test_candles import walk_bars

HEAD = "symbol,Datetime,Close,High,Low,Open,Note,Volume"


def written(tmp_path, *lines, head=HEAD, name="a.csv"):
    (tmp_path / name).write_text("\n".join([head, *lines]) + "\n")
    return str(tmp_path)


def test_csv_is_matched_by_name(spark, tmp_path):
    path = written(tmp_path, "A,2024-01-01 10:00:00+05:30,4,3,2,1,\"x, y\",7", "007,2024-01-01T11:00:00,NaN,,2.5,1e3,,8.0", ",2024-01-01, 1 ,1,1,1,,")
    rows = source.read_csv(spark, path).orderBy("Datetime").collect()
    assert rows[1][:7] == (dt.datetime(2024, 1, 1, 4, 30), 1.0, 3.0, 2.0, 4.0, 7, "A")
    assert rows[2][1:] == (1000.0, None, 2.5, None, 8, "007")
    assert rows[0][1:] == (1.0, 1.0, 1.0, 1.0, None, None)
    with pytest.raises(ValueError, match="Open, Volume"):
        source.read_csv(spark, written(tmp_path / ".." / tmp_path.name, "1", head="Datetime,High,Low,Close,symbol"))


def test_refused_rows(spark, tmp_path):
    good = "A,2024-01-01,4,3,2,1,n,7"
    bad = ["A,soon,4,3,2,1,n,7", "A,2024-01-02,x,3,2,?,n,7", "A,2024-01-03,4,3,2,1,n,7.5", "A,2024-01-04,4,3", "A,2024-01-05,4,3,2,1,n,7,8,9"]
    path = written(tmp_path, good, *bad)
    rows = source.checked_csv(spark, path).collect()
    assert [r.refused for r in rows] == [None, "Datetime", "Open,Close", "Volume", "record", "record"]
    assert [r.record for r in rows if r.refused == "record"] == bad[3:]
    with pytest.raises(Exception, match="refused"):
        source.read_csv(spark, path).collect()
    aside = source.new_path(spark)
    assert source.read_csv(spark, path, aside).count() == 1
    assert sorted(r.refused for r in spark.read.json(aside).collect()) == ["Datetime", "Open,Close", "Volume", "record", "record"]
    assert source.read_csv(spark, path, source.new_path(spark)).select("symbol").count() == 1


def test_files_with_another_header_are_not_mixed_up(spark, tmp_path):
    written(tmp_path, "A,2024-01-01,4,3,2,1,n,7")
    path = written(tmp_path, "A,2024-01-01,4,3,2,1,n,7", head=HEAD.replace("Close,High", "High,Close"), name="b.csv")
    with pytest.raises(Exception, match="(?i)header"):
        source.checked_csv(spark, path).collect()


def test_symbols_keep_their_text_and_prune_the_scan(spark):
    bars = walk_bars(spark, ("007", "600519", "1e3", "A/B=c", "true"), n=5)
    bars = bars.union(bars.limit(2).withColumn("symbol", F.lit(None).cast("string")))
    path = source.new_path(spark)
    source.write(bars, path)
    found = source.read_table(spark, path)
    assert found.schema["symbol"].dataType.typeName() == "string"
    columns = source.BAR_COLUMNS
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, bars.select(*columns).collect()))
    one = source.one_symbol(spark, path, "007")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.split("PartitionFilters: ")[1:])
    assert "007" in filters.split("]")[0] and one.count() == 5
    assert [r.Datetime for r in one.collect()] == sorted(r.Datetime for r in one.collect())
