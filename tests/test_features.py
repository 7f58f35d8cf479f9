import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickwatch.operators.features import build_features, model_view, rolling_stats, with_z_scores
from tickwatch.operators.returns import with_log_return
from tickwatch.schema import FEATURE
from tickwatch.sources.events import message_id

Z_COLUMNS = ("price, rolling_price_mean, rolling_price_std, log_return, rolling_log_return_mean, "
             "rolling_log_return_std, volume, rolling_volume_mean, rolling_volume_std").split(", ")

Z_CASES = [
    ((100, 90, 5, 0.05, 0.02, 0.01, 100, 80, 20), (2.0, 3.0, 1.0)),
    ((100, 90, 0, 0.05, 0.02, 0.0, 100, 80, 0), (0.0, 0.0, 0.0)),
    ((80, 90, 5, -0.03, 0.02, 0.01, 50, 80, 20), (-2.0, -5.0, -1.5)),
]


@pytest.mark.parametrize("values, expected", Z_CASES)
def test_z_scores(spark, values, expected):
    row = with_z_scores(spark.createDataFrame(
        [tuple(float(v) for v in values)], ", ".join(f"{c} double" for c in Z_COLUMNS))).first()
    got = (row["z_score_price"], row["z_score_log_return"], row["z_score_volume"])
    assert got == pytest.approx(expected, abs=1e-6)


def events(spark, rows):
    frame = spark.createDataFrame(
        rows, "event_id bigint, second bigint, symbol string, price double, volume double, log_return double, is_anomaly boolean")
    return frame.withColumn("event_time", F.timestamp_seconds("second")).drop("second")


def test_window_values(spark):
    rows = [
        (1, 0, "a", 10.0, 1.0, 0.0, False), (2, 30, "a", 12.0, 3.0, 0.2, True),
        (3, 59, "a", 14.0, 5.0, 0.1, False), (4, 60, "a", 99.0, 9.0, 0.3, None),
        (5, 10, "b", 5.0, 2.0, 0.0, None), (6, 10, None, 7.0, 2.0, 0.0, False),
    ]
    stats = {(r["symbol"], r["window"]["start"].minute): r for r in rolling_stats(events(spark, rows)).collect()}
    assert len(stats) == 4
    first = stats[("a", 0)]
    assert (first["price"], first["volume"], first["log_return"]) == (14.0, 5.0, 0.1)
    assert first["rolling_price_mean"] == pytest.approx(12.0)
    assert first["rolling_price_std"] == pytest.approx(2.0)
    assert first["is_anomaly"] == 1
    single = stats[("a", 1)]
    assert single["rolling_price_std"] == 0.0 and single["is_anomaly"] is None
    assert stats[("b", 0)]["is_anomaly"] is None


def test_last_value_follows_time_then_id_not_input_order(spark):
    rows = [(9, 5, "a", 3.0, 1.0, 0.0, False), (7, 5, "a", 2.0, 1.0, 0.0, False), (8, 1, "a", 1.0, 1.0, 0.0, False)]
    for shuffled in (rows, rows[::-1]):
        assert rolling_stats(events(spark, shuffled)).first()["price"] == 3.0


def test_ties_without_an_id_go_to_the_same_values(spark):
    rows = [(i, 5, "a", float(i), 1.0, 0.0, False) for i in range(40)]
    last = set()
    for shuffled in (rows, rows[::-1], rows[20:] + rows[:20]):
        frame = events(spark, shuffled).drop("event_id").repartition(3)
        stats = rolling_stats(frame)
        last.add(stats.first()["price"])
        assert "SortAggregate" not in stats._jdf.queryExecution().executedPlan().toString()
    assert len(last) == 1


def test_message_ids_order_a_partition_and_are_unique(spark):
    rows = spark.createDataFrame([(p, o) for p in (0, 1, 32_767) for o in (0, 1, 2**48 - 1)], "partition int, offset long")
    ids = [r[0] for r in rows.select(message_id("partition", "offset")).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 9 and ids[0] == 0


def test_single_row_window_has_zero_scores(spark):
    row = build_features(events(spark, [(1, 0, "a", 10.0, 1.0, 0.0, False)])).first()
    assert (row["z_score_price"], row["rolling_price_std"]) == (0.0, 0.0)


def test_columns(spark):
    built = build_features(events(spark, [(1, 0, "a", 10.0, 1.0, 0.0, False)]))
    assert built.columns == FEATURE.names
    assert model_view(built).columns == [
        "symbol", "z_score_price", "z_score_log_return", "z_score_volume",
        "rolling_price_std", "rolling_volume_std", "is_anomaly"]


def test_features_aggregate_before_the_only_shuffle(spark, ticks):
    events_ = ticks.withColumn("log_return", F.lit(0.0))
    plan = build_features(events_)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "SortAggregate" not in plan


def test_log_returns(spark):
    rows = [(1, 1, "a", 100.0), (2, 2, "a", 105.0), (3, 3, "a", 0.0), (4, 4, "a", 7.0), (5, 1, "b", 50.0)]
    frame = spark.createDataFrame(rows, "event_id bigint, second bigint, symbol string, price double")
    got = {r["event_id"]: r["log_return"] for r in with_log_return(
        frame.withColumn("event_time", F.timestamp_seconds("second"))).collect()}
    assert got[1] == 0.0 and got[5] == 0.0
    assert got[2] == pytest.approx(math.log(1.05))
    assert got[3] is None
    assert got[4] == 0.0


def test_window_starts_are_epoch_aligned(spark):
    row = build_features(events(spark, [(1, 125, "a", 10.0, 1.0, 0.0, False)])).first()
    assert row["window_start"] == dt.datetime(1970, 1, 1, 0, 2)
