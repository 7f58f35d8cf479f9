"""Scoring requests and the reports of streams."""

import json

import pytest
from pyspark.sql import functions as F

from tickwatch.operators.quality import with_reject_reasons
from tickwatch.plans.catalog import small_forest
from tickwatch.schema import FEATURES
from tickwatch.sources.events import text_message_stream
from tickwatch.sources.model_store import save_model
from tickwatch.streaming import progress, request_stream
from tickwatch.streaming.feature_stream import start_feature_stream

GOOD = dict(zip(["symbol", *FEATURES], ["BTC-USDT", 1.5, 0.8, -0.3, 0.002, 10.0]))


def messages(spark, rows):
    return spark.createDataFrame(rows, "request_id bigint, value string")


@pytest.fixture(scope="module")
def model(features):
    return small_forest(features)


def test_answers_and_refusals(spark, model, tmp_path):
    path = str(tmp_path / "out")
    assert request_stream.predictions(spark, path).count() == request_stream.rejects(spark, path).count() == 0
    rows = [(1, json.dumps(GOOD)), (2, json.dumps(GOOD | {"z_score_price": 200})), (3, "{"), (4, json.dumps(GOOD | {"z_score_volume": "NaN"})),
            (5, json.dumps(GOOD | {"z_score_price": "x"})), (6, json.dumps(GOOD | {"rolling_price_std": -0.001, "z_score_volume": "Infinity"})),
            (7, json.dumps(GOOD | {"extra": 1, "z_score_price": "0.25"})), (8, None), (None, json.dumps(GOOD))]
    request_stream.answer_batch(messages(spark, rows), model, path, 0)
    answers = request_stream.predictions(spark, path).collect()
    assert {r["request_id"] for r in answers} == {1, 7, None} and len({r["seq"] for r in answers}) == 3
    refused = {r["request_id"]: r["reject_reasons"] for r in request_stream.rejects(spark, path).collect()}
    assert refused[2] == ["z_score_price: out of range"] and refused[5] == ["z_score_price: missing"]
    assert refused[4] == ["z_score_volume: not finite"]
    assert refused[6] == ["z_score_volume: not finite", "rolling_price_std: negative"]
    assert len(refused[3]) == len(refused[8]) == 6


def test_a_repeated_batch_doubles_nothing_and_an_unfinished_one_is_not_seen(spark, model, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    first = messages(spark, [(i, json.dumps(GOOD)) for i in range(5)] + [(9, "bad")])
    second = messages(spark, [(i, json.dumps(GOOD)) for i in range(10, 13)] + [(19, "bad")])
    request_stream.answer_batch(first, model, path, 0)
    request_stream.answer_batch(first, model, path, 0)
    assert request_stream.predictions(spark, path).count() == 5 and request_stream.rejects(spark, path).count() == 1

    write = request_stream.write_batch

    def broken(df, place, batch_id):
        if place.endswith("rejects"):
            raise OSError("disk gone")
        write(df, place, batch_id)

    monkeypatch.setattr(request_stream, "write_batch", broken)
    with pytest.raises(OSError):
        request_stream.answer_batch(second, model, path, 1)
    # Predictions of the batch are there, but not its mark.
    assert request_stream.predictions(spark, path).count() == 5
    monkeypatch.setattr(request_stream, "write_batch", write)
    request_stream.answer_batch(second, model, path, 1)
    assert request_stream.predictions(spark, path).count() == 8 and request_stream.rejects(spark, path).count() == 2
    marks = {r["batch_id"]: (r["n_answered"], r["n_refused"]) for r in spark.read.parquet(f"{path}/marks").collect()}
    assert marks == {0: (5, 1), 1: (3, 1)}


def test_the_stream_needs_a_model_and_takes_the_newest(spark, model, features, tmp_path):
    source, store, out, checkpoint = (str(tmp_path / n) for n in ("in", "m", "out", "cp"))

    def push(rows):
        messages(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("request_id bigint, value string").parquet(source)
        request_stream.start_request_stream(stream, store, out, checkpoint, available_now=True).awaitTermination()

    with pytest.raises(Exception, match="no model"):
        push([(1, json.dumps(GOOD))])
    save_model(spark, model, store)
    push([(2, json.dumps(GOOD))])
    newer = small_forest(features.limit(50))
    save_model(spark, newer, store)
    push([(3, json.dumps(GOOD)), (4, "")])
    versions = {r["request_id"]: r["model_version"] for r in request_stream.predictions(spark, out).collect()}
    assert versions == {1: model.version, 2: model.version, 3: newer.version}
    assert with_reject_reasons(features).where(F.size("reject_reasons") > 0).count() == 0


def event(second, event_id, symbol="a"):
    return json.dumps({"timestamp": second, "symbol": symbol, "price": 1.0 + event_id, "volume": 1.0, "log_return": 0.0,
                       "is_anomaly": False, "anomaly_type": None, "event_id": event_id})


def test_reports_of_micro_batches(spark, tmp_path):
    folder, out, checkpoint, log = (tmp_path / n for n in ("in", "out", "cp", "log"))
    folder.mkdir()
    arrivals = [[event(0, 1), event(70, 2), "broken"], [event(1000, 3)],
                [event(5, 4), event(6, 5), event(65, 6), event(990, 7), event(10**15, 8)], [event(5000, 9)]]
    with progress.ProgressLog(spark, str(log)) as reports:
        for i, lines in enumerate(arrivals):
            (folder / f"{i}.txt").write_text("\n".join(lines))
            reports.wait(start_feature_stream(text_message_stream(spark, str(folder)), str(out), str(checkpoint),
                                              extra="event_id bigint", available_now=True))
    rows = progress.read(spark, str(log)).where("n_rows > 0").orderBy("batch_id").collect()
    assert [r["n_rows"] for r in rows] == [3, 1, 5, 1]
    assert [r["n_without_time"] for r in rows] == [1, 0, 1, 0]
    # Of the third arrival two rows of one closed window and one of another; the newest is in an open one.
    assert [r["late_windows"] for r in rows] == [0, 0, 2, 0]
    assert len({r["query_id"] for r in rows}) == 1 and rows[2]["watermark"].startswith("1970-01-01T00:15:40")


def test_a_report_that_cannot_be_kept_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text(event(0, 1))
    (tmp_path / "log").write_text("a file where the table should be")
    with pytest.raises(RuntimeError, match="progress was not kept"):
        with progress.ProgressLog(spark, str(tmp_path / "log" / "x")) as reports:
            reports.wait(start_feature_stream(text_message_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"),
                                              str(tmp_path / "cp"), extra="event_id bigint", available_now=True))
