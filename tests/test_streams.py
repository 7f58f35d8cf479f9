import json
import os
import subprocess
import sys

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickwatch.operators.features import build_features
from tickwatch.operators.returns import with_log_return
from tickwatch.plans.catalog import arrive, small_forest
from tickwatch.schema import EVENT, FEATURES
from tickwatch.session import CHECKPOINT_CONF, scratch_path, shared_dir
from tickwatch.sources.events import decode_events, text_message_stream
from tickwatch.sources.feature_store import read_features, write_features
from tickwatch.sources.model_store import save_model
from tickwatch.streaming.feature_stream import start_feature_stream
from tickwatch.streaming.return_stream import start_return_stream, state_before, stateful_log_return
from tickwatch.streaming.score_stream import start_score_stream
from tickwatch.streaming.trade_stream import start_trade_stream


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def message(second, symbol="a", price=10.0, event_id=0):
    return json.dumps({"timestamp": second, "symbol": symbol, "price": price, "volume": 1.0, "log_return": 0.1,
                       "is_anomaly": False, "anomaly_type": None, "event_id": event_id})


class Feed:
    """A folder of message files and a feature stream over it, one run per file."""

    def __init__(self, spark, tmp_path):
        self.spark, self.folder = spark, tmp_path / "in"
        self.folder.mkdir()
        self.path, self.checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
        self.n = 0

    def push(self, *lines):
        self.n += 1
        (self.folder / f"{self.n:03}.txt").write_text("\n".join(lines))
        messages = text_message_stream(self.spark, str(self.folder), 1)
        query = start_feature_stream(messages, self.path, self.checkpoint, extra="event_id bigint", available_now=True)
        query.awaitTermination()
        return query

    def rows(self):
        try:
            return {(r["symbol"], int(r["window_start"].timestamp()) // 60): r for r in
                    read_features(self.spark, self.path).collect()}
        except FileNotFoundError:
            return {}


def test_windows_close_once_and_late_rows_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(message(0), message(30, price=12.0, event_id=1), "{malformed")
    assert feed.rows() == {}
    feed.push(message(200, event_id=2))
    assert set(feed.rows()) == {("a", 0)}
    # Restarted from the checkpoint: a row of the closed window, and one of an open window.
    feed.push(message(59, price=99.0, event_id=3), message(170, price=11.0, event_id=4))
    feed.push(message(10_000, event_id=5))
    rows = feed.rows()
    assert set(rows) == {("a", 0), ("a", 2), ("a", 3)}
    assert len(list(read_features(spark, feed.path).collect())) == 3
    assert rows[("a", 0)]["rolling_price_std"] == pytest.approx(2 ** 0.5)


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    lines = [message(i * 7, "ab"[i % 2], 10.0 + i % 5, i) for i in range(100)]
    feed = Feed(spark, tmp_path)
    feed.push(*lines)
    feed.push(message(10_000, "z", 1.0, 1000))
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    batch = build_features(decode_events(frame, extra="event_id bigint"))
    got = read_features(spark, feed.path)
    cut = [F.round(c, 9).alias(c) if c in FEATURES else F.col(c) for c in got.columns]
    assert got.count() == batch.count()
    assert got.select(*cut).exceptAll(batch.select(*cut)).count() == 0


def test_an_id_beside_the_message_decides_ties(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [(message(5, price=float(p)), i) for i, p in ((3, 30), (9, 90), (7, 70))] + [(message(1000), 10)]
    schema = "value string, event_id bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    start_feature_stream(spark.readStream.schema(schema).parquet(folder), out, checkpoint, available_now=True).awaitTermination()
    row = read_features(spark, out).first()
    # The last price, 90, lies above the mean of 63.3.
    assert row["z_score_price"] == pytest.approx((90 - 190 / 3) / row["rolling_price_std"])


def test_store_layout(spark, features, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        read_features(spark, path)
    write_features(features, path)
    (tmp_path / "store" / "symbol=click" / "empty.parquet").write_bytes(b"")
    assert read_features(spark, path).count() == features.count()
    plan = read_features(spark, path).where("symbol = 'click'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def tick_files(spark, ticks, folder, parts=3):
    """The ticks in several files, later ones later in time."""
    ordered = ticks.withColumn("_p", F.ntile(parts).over(Window.orderBy("event_time", "event_id")))
    for p in range(1, parts + 1):
        ordered.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(str(folder))


def test_returns_over_micro_batches_equal_batch(spark, ticks, tmp_path):
    folder = tmp_path / "ticks"
    tick_files(spark, ticks, folder)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out, state, checkpoint = (str(tmp_path / n) for n in ("out", "state", "cp"))
    start_return_stream(stream, out, state, checkpoint, available_now=True, rows_per_range=50).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 3
    want = with_log_return(ticks).select("event_id", "log_return")
    assert got.select("event_id", "log_return").exceptAll(want).count() == 0
    assert got.count() == ticks.count()
    assert [p.name for p in sorted((tmp_path / "state").glob("slot=*"))] == ["slot=0", "slot=1", "slot=2"]
    last = spark.read.parquet(state).where("batch_id = 2")
    assert last.count() == ticks.select("symbol").distinct().count()


def test_trade_stream_keeps_bad_messages_apart(spark, tmp_path):
    def trade(price, millis):
        return json.dumps({"data": {"e": "trade", "s": "BTCUSDT", "p": price, "q": "1", "T": millis}})

    folder = tmp_path / "in"
    for i, texts in enumerate([[trade("100.00", 1000), "broken"], [trade("105.00", 2000), trade("x", 3000)]]):
        rows = [(10 * i + j, text) for j, text in enumerate(texts)]
        spark.createDataFrame(rows, "event_id bigint, value string").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("event_id bigint, value string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    paths = [str(tmp_path / n) for n in ("events", "bad", "state", "cp")]
    start_trade_stream(stream, *paths, available_now=True).awaitTermination()
    events = {r["timestamp"]: r for r in spark.read.parquet(paths[0]).collect()}
    assert events[1]["log_return"] == 0.0 and events[1]["symbol"] == "BTC-USDT"
    assert events[2]["log_return"] == pytest.approx(0.04879, abs=0.001)
    assert sorted(r["reject_reason"] for r in spark.read.parquet(paths[1]).collect()) == ["malformed", "price"]


@pytest.mark.parametrize("slice_seconds", [600, 6 * 3600, 10**9])
def test_keyed_state_over_micro_batches_and_a_restart_equals_batch(spark, ticks, tmp_path, slice_seconds):
    folder, out, checkpoint = (tmp_path / "ticks", str(tmp_path / "out"), str(tmp_path / "cp"))
    ordered = ticks.withColumn("p", F.ntile(4).over(Window.orderBy("event_time", "event_id")))
    batches = 0
    for parts in ((1, 2), (3,), (4,)):
        for p in parts:
            ordered.where(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        returns = stateful_log_return(stream, slice_seconds=slice_seconds)
        query = (returns.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        batches += sum(p["numInputRows"] > 0 for p in query.recentProgress)
        plan = query._jsq.explainInternal(False)
        assert "FlatMapGroupsInPandasWithState" not in plan and "TransformWithStateInPySpark" in plan.replace("Pandas", "PySpark")
    assert batches == 4
    got = spark.read.parquet(out).select("event_id", F.round("log_return", 9))
    want = with_log_return(ticks).select("event_id", F.round("log_return", 9))
    assert got.count() == ticks.count() and got.exceptAll(want).count() == 0


def test_late_ticks_still_move_the_kept_price(spark, tmp_path):
    """A tick behind the watermark, of a window that is still open, has a return and is kept."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "symbol string, event_time timestamp, event_id bigint, price double, volume double, is_anomaly boolean"

    def push(*rows):
        spark.createDataFrame([(s, t, i, p, 1.0, False) for s, t, i, p in rows], "symbol string, t long, event_id long, price double, volume double, is_anomaly boolean").select(
            "symbol", F.timestamp_seconds("t").alias("event_time"), "event_id", "price", "volume", "is_anomaly"
        ).coalesce(1).write.mode("append").parquet(folder)
        ticks = spark.readStream.schema(schema).parquet(folder)
        features = build_features(stateful_log_return(ticks), "10 minutes")
        (features.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    push(("a", 10, 1, 100.0), ("a", 300, 2, 110.0), (None, 20, 3, 5.0))
    push(("a", 50, 4, 121.0), (None, 21, 5, 10.0))
    push(("a", 10_000, 6, 1.0))
    rows = {(r["symbol"], r["window_start"].timestamp()): r for r in spark.read.parquet(out).collect()}
    first = rows["a", 0.0]
    # The mean of 100, 110 and the late 121, whose return follows 110.
    assert first["rolling_price_std"] == pytest.approx(10.5, abs=0.02)
    assert rows[None, 0.0]["rolling_price_std"] == pytest.approx(3.5355, abs=1e-3)


def test_keyed_state_in_a_session_with_the_default_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    rows = [(i, i * 400, "ab"[i % 2], 10.0 + i) for i in range(60)]
    schema = "event_id long, t long, symbol string, price double"
    ticks = spark.createDataFrame(rows, schema).select(
        "event_id", F.timestamp_seconds("t").alias("event_time"), "symbol", "price")
    source, out, checkpoint = (scratch_path(spark, n) for n in ("ticks", "returns", "checkpoint"))
    try:
        arrive(ticks, F.unix_seconds("event_time"), source, lambda: (
            stateful_log_return(spark.readStream.schema(ticks.schema).parquet(source)).writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()))
    finally:
        spark.conf.set(name, before)
    got = spark.read.parquet(out).select("event_id", F.round("log_return", 9))
    want = with_log_return(ticks).select("event_id", F.round("log_return", 9))
    assert got.count() == 60 and got.exceptAll(want).count() == 0


def test_arrivals_come_in_order_of_time(spark, ticks, tmp_path):
    seen = []
    path = str(tmp_path / "in")
    arrive(ticks, F.unix_seconds("event_time"), path, lambda: seen.append(
        spark.read.parquet(path).agg(F.count("*"), F.max("event_time")).first()))
    assert len(seen) == 3 and seen[-1][0] == ticks.count()
    assert seen[0][1] < seen[1][1] < seen[2][1]
    arrive(ticks.limit(0), F.unix_seconds("event_time"), str(tmp_path / "none"), lambda: seen.append(None))
    assert len(seen) == 4


def test_score_stream(spark, features, tmp_path):
    store, model, out, rejects, checkpoint = (str(tmp_path / n) for n in ("f", "m", "p", "r", "c"))
    bad = features.limit(3).withColumn("z_score_price", F.lit(500.0))
    features.unionByName(bad).coalesce(2).write.parquet(store)
    stream = spark.readStream.schema(features.schema).option("maxFilesPerTrigger", 1).parquet(store)
    with pytest.raises(Exception, match="no model"):
        start_score_stream(stream, model, out, rejects, checkpoint, available_now=True).awaitTermination()
    save_model(spark, small_forest(features), model)
    start_score_stream(stream, model, out, rejects, checkpoint, available_now=True).awaitTermination()
    predictions = spark.read.parquet(out)
    assert predictions.count() == features.count()
    assert predictions.select("seq").distinct().count() == features.count()
    assert spark.read.parquet(rejects).count() == 3
    assert set(FEATURES) <= set(predictions.columns)


class FakeSession:
    """Settings and a master name, all that shared_dir looks at."""

    def __init__(self, master, **settings):
        self.settings, self.conf = settings, self
        self.sparkContext = type("Context", (), {"master": master})

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_scratch_paths_follow_the_cluster():
    cluster = FakeSession("spark://host:1", **{CHECKPOINT_CONF: "hdfs:///shared/"})
    assert shared_dir(cluster) == "hdfs:///shared"
    one, two = scratch_path(cluster, "x"), scratch_path(cluster, "x")
    assert one != two and one.startswith("hdfs:///shared/")


def test_intermediate_tables_end_with_the_application(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tickwatch.session import build_session, release, stage
spark = build_session("scratch", "local[1]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path)!r})
stage(spark.range(3), "one")
release(spark)
import glob
assert not glob.glob({str(tmp_path)!r} + "/tickwatch/*")
print(stage(spark.range(3), "two").count(), len(glob.glob({str(tmp_path)!r} + "/tickwatch/*/*")))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-2:] == ["3", "1"], out.stderr
    assert not list(tmp_path.glob("tickwatch/*"))


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession("spark://host:1"))
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_event_schema_is_the_message_format():
    assert EVENT.names == ["timestamp", "symbol", "price", "volume", "log_return", "is_anomaly", "anomaly_type"]


def test_only_the_first_batch_may_find_no_state(spark, tmp_path):
    path = str(tmp_path / "none")
    assert state_before(spark, path, 0).isEmpty()
    with pytest.raises(AnalysisException):
        state_before(spark, path, 1)
