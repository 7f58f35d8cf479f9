import json

import pytest
from pyspark.sql import functions as F

from tickwatch.functions.columns import floor_seconds, to_stream_name, to_symbol
from tickwatch.operators.trades import normalize_trades, parse_trades, quarantine, quarantine_counts
from tickwatch.schema import EVENT
from tickwatch.sources.events import decode_events, encode_events, kafka_options


def trade(e="trade", s="BTCUSDT", p="43150.50", q="0.125000", t=1710000000000):
    return json.dumps({"data": {"e": e, "s": s, "p": p, "q": q, "T": t}})


def messages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "event_id bigint, value string")


def test_one_trade(spark):
    row = normalize_trades(messages(spark, [trade()])).first()
    assert row["symbol"] == "BTC-USDT"
    assert (row["price"], row["volume"], row["timestamp"]) == (43150.50, 0.125, 1710000000)
    assert row["is_anomaly"] is False and row["anomaly_type"] is None
    assert row["log_return"] == 0.0


def test_log_return_between_trades(spark):
    texts = [trade(p="105.00", t=1001000), trade(p="100.00", t=1000000)]
    rows = {r["timestamp"]: r["log_return"] for r in normalize_trades(messages(spark, texts)).collect()}
    assert rows[1000] == 0.0
    assert rows[1001] == pytest.approx(0.04879, abs=0.001)


def test_other_messages_are_ignored(spark):
    texts = [trade(e="kline"), "{}", '{"data": {}}']
    parsed = parse_trades(messages(spark, texts))
    assert parsed.count() == 0


def test_bad_messages_go_to_quarantine(spark):
    texts = [trade(), "not json", trade(p="x"), trade(q=None), trade(s=None), trade(t="soon")]
    parsed = parse_trades(messages(spark, texts))
    reasons = {r["event_id"]: r["reject_reason"] for r in quarantine(parsed).collect()}
    assert reasons == {1: "malformed", 2: "price", 3: "quantity", 4: "symbol", 5: "time"}
    assert normalize_trades(messages(spark, texts)).count() == 1
    assert {r["reject_reason"]: r["n"] for r in quarantine_counts(parsed).collect()}["malformed"] == 1


def test_symbol_mapping(spark):
    names = ["BTCUSDT", "ethusdt", "BnbUsdt", "DogeEUR"]
    frame = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in frame.select(to_symbol("s")).collect()] == ["BTC-USDT", "ETH-USDT", "BNB-USDT", "DogeEUR"]
    frame = spark.createDataFrame([("BTC-USDT",), ("SOL-EUR",)], "s string")
    assert [r[0] for r in frame.select(to_stream_name("s")).collect()] == ["btcusdt", "soleur"]


def test_seconds_round_down_also_below_zero(spark):
    frame = spark.createDataFrame([(1999,), (-1,), (-1000,)], "t bigint")
    assert [r[0] for r in frame.select(floor_seconds("t")).collect()] == [1, -1, -1]


def test_decode(spark):
    good = {"timestamp": 60, "symbol": "a", "price": 1.5, "volume": 2.0, "log_return": 0.1,
            "is_anomaly": True, "anomaly_type": "PRICE_SPIKE"}
    texts = [json.dumps(good), "{broken", json.dumps({**good, "price": "n/a"})]
    frame = messages(spark, texts).withColumn("value", F.col("value").cast("binary"))
    rows = {r["event_id"]: r for r in decode_events(frame, keep=("event_id",)).collect()}
    assert rows[0]["price"] == 1.5 and rows[0]["event_time"].minute == 1
    assert rows[1]["symbol"] is None and rows[1]["event_time"] is None
    assert rows[2]["price"] is None and rows[2]["symbol"] == "a"


def test_encode_then_decode(spark):
    rows = [(60, "a", 1.5, 2.0, 0.1, False, None)]
    frame = spark.createDataFrame(rows, EVENT)
    assert [tuple(r)[:7] for r in decode_events(encode_events(frame)).collect()] == rows


def test_kafka_options():
    options = kafka_options("h:9092", "ticks")
    assert options["subscribe"] == "ticks" and options["startingOffsets"] == "latest"
    assert int(options["maxOffsetsPerTrigger"]) > 0


@pytest.mark.parametrize("factor", [1000, 10**6, 10**9, -1])
def test_times_in_another_unit_are_no_event_time(spark, factor):
    from tickwatch.functions.columns import arrival_key

    row = json.dumps({"timestamp": 1710000000 * factor, "symbol": "BTC-USDT", "price": 1.0})
    out = decode_events(messages(spark, [row]), keep=("event_id",)).withColumn("k", arrival_key("event_time", "event_id"))
    got = out.first()
    assert got["event_time"] is None and got["k"] is None and got["price"] == 1.0


@pytest.mark.parametrize("time", [1710000000000 * 1000, 1710000000000 * 10**6, -1, 9 * 10**18])
def test_trades_with_such_times_go_to_quarantine(spark, time):
    parsed = parse_trades(messages(spark, [trade(t=time), trade()]))
    assert [(r["reject_reason"], r["n"]) for r in quarantine_counts(parsed).collect()] == [("time", 1)]
    assert normalize_trades(messages(spark, [trade(t=time), trade()])).count() == 1
