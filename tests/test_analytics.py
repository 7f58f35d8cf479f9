import math

import pytest
from pyspark.sql import functions as F

from tickwatch.functions.columns import gauge_value, rate_alert, rate_band
from tickwatch.operators import analytics, history
from tickwatch.operators.inject import FADE, KINDS, inject_anomalies
from tickwatch.schema import FEATURES, PREDICTION
from tickwatch.sources.exports import export_csv, read_csv


@pytest.fixture(scope="module")
def predictions(spark):
    """501 rows; every tenth is an anomaly; three symbols, one of them rare."""
    i = F.col("id")
    rows = spark.range(501).select(
        i.alias("seq"),
        F.when(i % 100 == 7, "BNB-USDT").when(i % 3 == 0, "ETH-USDT").otherwise("BTC-USDT").alias("symbol"),
        F.sin(i).alias(FEATURES[0]), F.cos(i * 2).alias(FEATURES[1]), F.lit(1.25).alias(FEATURES[2]),
        (F.sin(i) * 2 + 3).alias(FEATURES[3]), (i / 10).alias(FEATURES[4]),
        (F.sin(i * 7) / 5 - F.when(i % 10 == 0, 1).otherwise(0)).alias("anomaly_score"),
        (i % 10 == 0).alias("is_anomaly"), F.lit("v").alias("model_version"))
    return spark.createDataFrame(rows.collect(), PREDICTION).repartition(5)


def test_history_drops_the_oldest(predictions):
    view = history.history(predictions)
    assert view.count() == 500
    assert view.agg(F.min("seq")).first()[0] == 1


def test_latest(predictions):
    rows = [r["seq"] for r in history.latest(predictions).collect()]
    assert rows == list(range(401, 501))
    eth = history.latest(predictions, 20, "ETH-USDT").collect()
    assert {r["symbol"] for r in eth} == {"ETH-USDT"} and len(eth) == 20
    assert [r["seq"] for r in eth] == sorted(r["seq"] for r in eth)
    assert history.latest(predictions, 500, "All").count() == 500
    assert history.latest(predictions, 500, "none").count() == 0


@pytest.mark.parametrize("limit", [0, 501])
def test_limit_bounds(predictions, limit):
    with pytest.raises(ValueError):
        history.latest(predictions, limit)


def test_recent_anomalies(predictions):
    view = history.latest(predictions, 500)
    assert [r["seq"] for r in history.recent_anomalies(view).collect()] == [460, 470, 480, 490, 500]
    alert = analytics.alerts(history.recent_anomalies(view)).collect()[-1]["alert"]
    assert alert.startswith("BTC-USDT — score: -") and "z_vol: 1.25" in alert


def test_totals(spark, predictions):
    row = analytics.totals(predictions).first()
    assert (row["total_predictions"], row["total_anomalies"], row["anomaly_rate"]) == (501, 51, 10.18)
    empty = analytics.totals(predictions.limit(0)).first()
    assert tuple(empty) == (0, 0, 0.0, 0.0)


def test_nested_stats(predictions):
    row = analytics.stats(history.history(predictions)).first()
    assert row["total_predictions"] == 500
    assert set(row["per_symbol"]) == {"BTC-USDT", "ETH-USDT", "BNB-USDT"}
    assert set(row["feature_stats"]) == set(FEATURES)
    assert row["feature_stats"]["z_score_volume"]["std"] == 0.0
    assert row["score_percentiles"]["p25"] <= row["score_percentiles"]["p99"]
    empty = analytics.stats(predictions.limit(0)).first()
    assert empty["score_percentiles"] is None and empty["feature_stats"] is None
    assert empty["total_predictions"] == 0 and not empty["per_symbol"]


@pytest.mark.parametrize("rows_per_range", [40, None])
def test_bounded_and_whole_table_forms_agree(predictions, rows_per_range):
    def same(a, b):
        cut = [df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]) for df in (a, b)]
        assert cut[0].count() == cut[1].count() and cut[0].exceptAll(cut[1]).count() == 0

    same(analytics.score_percentiles(predictions, "bounded"),
         analytics.score_percentiles(predictions, rows_per_range=rows_per_range))
    same(analytics.feature_box_stats(predictions, "bounded"),
         analytics.feature_box_stats(predictions, rows_per_range=rows_per_range))
    same(analytics.score_timeline(predictions, bounded=True),
         analytics.score_timeline(predictions, rows_per_range=rows_per_range))
    same(analytics.score_heatmap(predictions, bounded=True),
         analytics.score_heatmap(predictions, rows_per_range=rows_per_range))
    same(analytics.score_trend(predictions, bounded=True),
         analytics.score_trend(predictions, rows_per_range=rows_per_range))


def test_constant_feature_has_no_correlation(predictions):
    rows = {(r["feature_x"], r["feature_y"]): r["correlation"]
            for r in analytics.feature_correlation(predictions).collect()}
    assert len(rows) == 25
    assert rows[("z_score_volume", "z_score_price")] is None
    assert rows[("z_score_price", "rolling_price_std")] == pytest.approx(1.0)
    assert rows[("z_score_price", "z_score_log_return")] == rows[("z_score_log_return", "z_score_price")]


def test_histogram(predictions):
    rows = analytics.score_histogram(predictions).orderBy("bin").collect()
    assert len(rows) == 30 and sum(r["n"] for r in rows) == 501
    assert rows[0]["n"] > 0 and rows[-1]["n"] > 0
    same = analytics.score_histogram(predictions.withColumn("anomaly_score", F.lit(0.5))).where("n > 0").collect()
    assert [(r["bin"], r["n"]) for r in same] == [(0, 501)]


def test_box_without_anomalies_has_only_the_normal_class(predictions):
    rows = analytics.feature_box_stats(predictions.where("not is_anomaly"), "bounded").collect()
    assert {r["is_anomaly"] for r in rows} == {False} and len(rows) == 5
    row = next(r for r in rows if r["feature"] == "z_score_volume")
    assert row["q1"] == row["median"] == row["q3"] == row["whisker_low"] == row["whisker_high"] == 1.25


def test_breakdown_and_long_form(predictions):
    assert {r["class"]: r["n"] for r in analytics.class_breakdown(predictions).collect()} == {"Normal": 450, "Anomaly": 51}
    assert [r["n"] for r in analytics.class_breakdown(predictions.limit(0)).collect()] == [0, 0]
    assert analytics.per_symbol_long(predictions).count() == 6


def test_heatmap_pivot(predictions):
    heat = analytics.score_heatmap(predictions.where("symbol = 'BNB-USDT'"), width=2, bounded=True)
    assert analytics.heatmap_pivot(heat, 3).columns == ["symbol", "T0", "T1", "T2"]


def test_kpi_texts(predictions):
    row = analytics.kpis(history.latest(predictions, 100)).first()
    assert row["total_text"] == "100" and row["rate_text"] == "10.0%"


@pytest.mark.parametrize("rate, band, alert", [
    (0.0, "low", False), (5.0, "medium", False), (10.5, "medium", True), (15.0, "high", True), (100.0, "high", True)])
def test_bands(spark, rate, band, alert):
    row = spark.createDataFrame([(rate,)], "r double").select(rate_band("r"), rate_alert("r")).first()
    assert tuple(row) == (band, alert)


@pytest.mark.parametrize("score, flag, value", [(-0.1, True, 100.0), (0.2, False, 4.0), (9.0, False, 100.0)])
def test_gauge(spark, score, flag, value):
    row = spark.createDataFrame([(score, flag)], "s double, f boolean").select(gauge_value("s", "f")).first()
    assert row[0] == pytest.approx(value)


def test_display_table(predictions):
    row = analytics.display_table(predictions.where("seq = 10")).first()
    assert row["is_anomaly"] == "YES" and row["seq"] == "10" and row["z_score_volume"] == "1.2500"


def test_csv_round_trip(spark, predictions, tmp_path):
    path = str(tmp_path / "csv")
    export_csv(history.anomalies_only(predictions), path)
    back = read_csv(spark, path, PREDICTION)
    assert back.columns == PREDICTION.names and back.count() == 51


def test_injection(ticks):
    out = inject_anomalies(ticks, prob=0.2, seed=7)
    rows = {r["event_id"]: r for r in out.collect()}
    assert len(rows) == ticks.count()
    marked = [r for r in rows.values() if r["is_anomaly"]]
    assert 0.15 < len(marked) / len(rows) < 0.25
    assert {r["anomaly_type"] for r in marked} == set(KINDS)
    assert all(r["anomaly_type"] is None for r in rows.values() if not r["is_anomaly"])


def test_injected_prices_move_in_the_right_direction(ticks):
    flat = ticks.withColumn("price", F.lit(100.0))
    once = {r["event_id"]: r for r in inject_anomalies(flat, 0.2, 7, persist=False).collect()}
    for r in once.values():
        if r["anomaly_type"] == "PRICE_SPIKE":
            assert 105 <= r["price"] <= 115
        elif r["anomaly_type"] == "FLASH_CRASH":
            assert 85 <= r["price"] <= 95
        else:
            assert r["price"] == 100.0
    kept = inject_anomalies(flat, 0.2, 7, rows_per_range=50)
    for r in kept.collect():
        if r["anomaly_type"] == "PRICE_SPIKE":
            assert r["log_return"] >= 0
        if r["anomaly_type"] in (None, "VOLUME_SPIKE"):
            assert abs(r["log_return"]) < 1e-9
    one = inject_anomalies(flat, 0.2, 7)
    assert kept.exceptAll(one).count() == 0


def test_injected_effects_fade(ticks):
    flat = ticks.withColumn("price", F.lit(100.0))
    out = inject_anomalies(flat, 0.2, 7, fade=0.5, rows_per_range=50).orderBy("symbol", "event_time", "event_id").collect()
    level, symbol = 0.0, None
    for r in out:
        before = 0.5 * level if r["symbol"] == symbol else 0.0
        symbol, level = r["symbol"], math.log(r["price"] / 100)
        if r["anomaly_type"] not in ("PRICE_SPIKE", "FLASH_CRASH"):
            assert level == pytest.approx(before, abs=2e-4)
    with pytest.raises(ValueError):
        inject_anomalies(flat, fade=0.0)


def test_a_long_series_keeps_its_level(spark):
    """Three million ticks of one symbol: lasting effects that never fade would end near 0."""
    ticks = spark.range(3_000_000).select(
        F.lit("hot").alias("symbol"), F.timestamp_seconds("id").alias("event_time"), F.col("id").alias("event_id"),
        F.lit(100.0).alias("price"), F.lit(1.0).alias("volume"), F.lit(False).alias("is_anomaly"))
    out = inject_anomalies(ticks, fade=FADE, rows_per_range=400_000)
    row = out.agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n"),
                  F.avg(F.when(F.col("event_id") > 2_900_000, F.col("price"))).alias("end")).first()
    assert row["n"] == 3_000_000 and row["low"] > 20 and row["high"] < 500 and 70 < row["end"] < 130


def test_rows_without_score_or_class_are_left_out(spark):
    from tickwatch.schema import FEATURES

    rows = [(flag, *([float(i)] * 5)) for i, flag in enumerate([True, False, False, None])]
    rows.append((False, float("nan"), float("inf"), None, 1.0, 1.0))
    df = spark.createDataFrame(rows, "is_anomaly boolean, " + ", ".join(f"{c} double" for c in FEATURES))
    counts = {r["class"]: r["n"] for r in analytics.class_breakdown(df).collect()}
    assert counts == {"Normal": 3, "Anomaly": 1}
    box = {(r["feature"], r["is_anomaly"]): r for r in analytics.feature_box_stats(df).collect()}
    assert len(box) == 10
    assert all(box[c, False]["mean"] == 1.5 for c in FEATURES[:3])
