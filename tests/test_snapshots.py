import random
from datetime import date, timedelta

import pytest

from tallyfold.operators import portfolio as pf
from tallyfold.operators.snapshots import Snapshots
from tests.test_portfolio import TRADES


def fills(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        q = float(rng.choice([-3, -2, -1, 1, 2, 3]))
        key = rng.choice([(1, 1), (rng.randrange(4), rng.randrange(9)), (None, 2)])
        out.append((*key, date(2020, 1, 1) + timedelta(rng.randrange(400)), "SELL" if q < 0 else "BUY", abs(q), q, 5.0, i, 1, 1, 5.0))
    return out


DAYS = [date(2019, 12, 31), date(2020, 1, 1), date(2020, 3, 15), date(2020, 5, 31), date(2020, 6, 1), date(2020, 12, 31), date(2021, 2, 10)]


@pytest.mark.parametrize("period", ["month", "year"])
def test_every_date_equals_the_positions_of_all_fills(spark, rows, tmp_path, period):
    own = fills(1, 240)
    kept, seen = Snapshots(spark, str(tmp_path), period), []

    def check():
        df = spark.createDataFrame(seen, TRADES)
        for day in DAYS:
            assert rows(kept.positions(day)) == rows(pf.positions(df, day)), day

    for batch, until in enumerate((date(2020, 2, 20), date(2020, 5, 5), date(2020, 12, 24))):
        seen += own[batch * 80 : batch * 80 + 80]  # each batch has fills of all periods, so all but the first are late
        kept.add(spark.createDataFrame(own[batch * 80 : batch * 80 + 80], TRADES), batch)
        check()
        kept.close(until)
        check()
    assert len(kept.closed()) == (3 if period == "month" else 1)


def test_a_repeated_batch_counts_once_and_a_closed_period_stays(spark, rows, tmp_path):
    own = fills(2, 100)
    kept = Snapshots(spark, str(tmp_path))
    kept.add(spark.createDataFrame(own[:50], TRADES), 0)
    kept.close(date(2020, 4, 1))
    for _ in range(2):
        kept.add(spark.createDataFrame(own[50:], TRADES), 1)
        kept.close(date(2020, 4, 30))
    for day in DAYS:
        assert rows(kept.positions(day)) == rows(pf.positions(spark.createDataFrame(own, TRADES), day))


def test_only_the_fills_after_the_snapshot_are_read(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path))
    kept.add(spark.createDataFrame(fills(3, 200), TRADES), 0)
    kept.close(date(2020, 5, 1))
    found = kept.positions(date(2020, 7, 4))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(period") == 2
    read = kept._read("fills", "account_id long, period date, batch long").where("period > DATE '2020-05-01' AND period <= DATE '2020-07-01'")
    assert {f.split("period=")[1][:10] for f in read.select("_metadata.file_path").distinct().toPandas()["file_path"]} == {"2020-06-01", "2020-07-01"}


def test_no_fills_and_no_dates(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path))
    assert kept.positions(date(2020, 1, 1)).count() == 0 and kept.closed() == []
    kept.close(date(2020, 1, 1))
    assert kept.positions(date(2020, 2, 1)).count() == 0 and kept.closed() == [date(2020, 1, 1)]
    with pytest.raises(ValueError, match="no trade date"):
        kept.add(spark.createDataFrame([(1, 1, None, "BUY", 1.0, 1.0, 1.0, 1, 1, 1, 1.0)], TRADES), 0)


def test_a_folder_with_most_fills_is_written_by_many_tasks(spark, tmp_path):
    own = spark.range(0, 200_000, numPartitions=8).selectExpr("id % 5000 AS account_id", "id % 7919 AS instrument_id", "DATE '2020-03-05' AS trade_date", "1D AS signed_quantity")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        kept = Snapshots(spark, str(tmp_path))
        kept.add(own, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    read = spark.read.parquet(f"{tmp_path}/fills")
    assert read.count() == 200_000 and len(read.inputFiles()) > 3
