"""Stored tables that grow: recent view by batch, compaction, the seven-column store, saved models."""

import datetime

import pytest
from pyspark.sql import functions as F

from tickwatch.operators import history
from tickwatch.operators.features import model_view
from tickwatch.operators.split import stratified_rule
from tickwatch.plans import training
from tickwatch.plans.catalog import small_forest
from tickwatch.schema import FEATURE, FEATURES, LABEL, PREDICTION
from tickwatch.session import partition_numbers
from tickwatch.sources import feature_store, model_store

KEY = ("symbol", "window_start")


def batches(spark, path, sizes):
    """A prediction table with the given number of rows per batch; seq grows with the batch."""
    for batch, size in enumerate(sizes):
        rows = spark.range(size).select(
            (F.lit(batch << 36) + F.col("id")).alias("seq"), F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"),
            *[F.lit(1.0).alias(c) for c in FEATURES], F.lit(-0.5).alias("anomaly_score"), (F.col("id") % 2 == 0).alias("is_anomaly"),
            F.lit("v").alias("model_version"), F.lit(batch).alias("batch_id"))
        rows.coalesce(1).write.mode("append").partitionBy("batch_id").parquet(path)


@pytest.mark.parametrize("sizes, opened", [([5] * 40, 40), ([900] * 12, 1), ([300, 10, 200, 200, 120], 4), ([40], 1)])
def test_the_recent_view_opens_the_newest_batches_alone(spark, tmp_path, sizes, opened):
    path = str(tmp_path / "p")
    batches(spark, path, sizes)
    view = history.stored_view(spark, path)
    whole = history.history(spark.read.parquet(path)).select(*PREDICTION.names)
    assert view.count() == min(500, sum(sizes)) and view.exceptAll(whole).count() == 0
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(batch_id" in plan and f">= {len(sizes) - opened})]" in plan
    table = spark.read.parquet(path).where(F.col("batch_id") >= len(sizes) - opened)
    assert table.select(F.input_file_name()).distinct().count() == opened
    newest = history.latest_stored(spark, path, 30, "s1").collect()
    assert [r["seq"] for r in newest] == [r["seq"] for r in history.latest(spark.read.parquet(path), 30, "s1").collect()]


def test_no_predictions_yet(spark, tmp_path):
    assert history.stored_view(spark, str(tmp_path / "none")).count() == 0
    assert history.latest_stored(spark, str(tmp_path / "none"), 5).columns == PREDICTION.names


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "window_start", *FEATURES).collect())


def test_compaction_bounds_files_and_loses_nothing(spark, features, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        feature_store.read_store(spark, path)
    parts = [features.where(F.pmod(F.xxhash64("window_start"), F.lit(6)) == i) for i in range(6)]
    for i, part in enumerate(parts):
        feature_store.write_features(part.repartition(4), path)
        before = rows_of(feature_store.read_store(spark, path))
        held = feature_store.compact(spark, path, file_rows=60, fanout=3)
        assert rows_of(feature_store.read_store(spark, path)) == before
        # Whole files, and of each symbol fewer than `fanout` small ones and what this write made of it.
        total, symbols = len(before), held.select("symbol").distinct().count()
        assert held.count() <= total // 30 + symbols * 6
    assert before == rows_of(features)
    assert len(feature_store._files(spark, path)) > 3 * held.count()
    # Without new rows it only merges what the last write left small.
    again = feature_store.compact(spark, path, 60, 3)
    assert again.count() <= held.count() and rows_of(feature_store.read_store(spark, path)) == before
    assert len(partition_numbers(spark, f"{path}.manifests", "number")) == feature_store.KEEP_MANIFESTS


def test_a_reader_sees_the_rows_before_or_after_a_compaction(spark, features, tmp_path):
    path = str(tmp_path / "store")
    feature_store.write_features(features, path)
    feature_store.compact(spark, path, 100)
    reader = feature_store.read_store(spark, path)
    feature_store.write_features(features.limit(20), path)
    feature_store.compact(spark, path, 100, fanout=1)
    # The earlier plan still finds its files; a new one has the new rows.
    assert reader.count() == features.count()
    assert feature_store.read_store(spark, path).count() == features.count() + 20
    # A manifest that was not finished does not count.
    number = partition_numbers(spark, f"{path}.manifests", "number")[-1] + 1
    (tmp_path / "store.manifests" / f"number={number}").mkdir()
    assert feature_store.read_store(spark, path).count() == features.count() + 20
    feature_store.compact(spark, path, 100)
    assert feature_store.read_store(spark, path).count() == features.count() + 20


def test_times_of_other_files_are_not_opened(spark, features, tmp_path):
    path = str(tmp_path / "store")
    odd = features.withColumn("symbol", F.when(F.col("symbol") == "click", "a b%/c").otherwise(F.col("symbol")))
    feature_store.write_features(odd, path)
    held = feature_store.compact(spark, path, file_rows=30)
    times = [r["window_start"] for r in features.select("window_start").orderBy("window_start").collect()]
    since, until = times[len(times) // 2], times[len(times) // 2 + 40]
    got = feature_store.read_store(spark, path, since, until)
    want = odd.where((F.col("window_start") >= since) & (F.col("window_start") < until))
    assert rows_of(got) == rows_of(want) and got.count() > 0
    assert len(got.inputFiles()) < held.count() / 2
    assert feature_store.read_store(spark, path, datetime.datetime(2200, 1, 1)).count() == 0


def test_keys_of_the_seven_column_store_outlive_added_files(spark, features, tmp_path):
    path = str(tmp_path / "compat")
    model_view(features).repartition(3).write.partitionBy("symbol").parquet(path)
    first = feature_store.read_compat(spark, path)
    assert set(first.columns) == {"symbol", *FEATURES, LABEL, "row_key"}
    keys = {(r["symbol"], r["row_key"]): r["rolling_price_std"] for r in first.collect()}
    assert len(keys) == features.count()
    model_view(features.limit(50)).write.mode("append").partitionBy("symbol").parquet(path)
    again = {(r["symbol"], r["row_key"]): r["rolling_price_std"] for r in feature_store.read_compat(spark, path).collect()}
    assert len(again) == len(keys) + 50 and all(again[k] == v for k, v in keys.items())


def test_a_saved_model_is_evaluated_on_rows_it_never_saw(spark, features, tmp_path):
    path = str(tmp_path / "m")
    middle = features.agg(F.percentile_approx("window_start", 0.5)).first()[0]
    known = features.where(F.col("window_start") < middle)
    run = training.train(known, n_estimators=10)
    assert run.mode == "labelled"
    training.save_training(spark, run, path)
    split = model_store.load_split(spark, path, run.model.version)
    held = model_store.held_out(features, split, LABEL)
    used = training.train_test(run.rows, run.rule)[0]
    assert held.join(used, list(KEY), "left_semi").count() == 0
    own = training.train_test(run.rows, run.rule)[1]
    assert held.where(F.col("window_start") < middle).count() == own.count()
    added = held.where(F.col("window_start") >= middle).count()
    assert 0.1 < added / features.where(F.col("window_start") >= middle).count() < 0.3
    parts = training.evaluate_saved(spark, path, features)
    assert parts["report"].count() == 5 and "detected" not in parts
    plain = training.train(features.withColumn(LABEL, F.lit(0)), n_estimators=5)
    training.save_training(spark, plain, path)
    assert training.evaluate_saved(spark, path, features)["detected"].first()["n_rows"] == features.count()
    assert training.evaluate_saved(spark, path, features, run.model.version)["report"].count() == 5
    with pytest.raises(RuntimeError):
        training.evaluate_saved(spark, str(tmp_path / "none"), features)


def test_many_label_values_need_no_chain_of_cases(spark, features, tmp_path):
    rows = features.withColumn(LABEL, F.pmod(F.xxhash64(*KEY), F.lit(40)).cast("int"))
    rule = stratified_rule(rows, LABEL, KEY, 0.2, 42)
    model = small_forest(features)
    model_store.save_split(spark, rule, model.version, str(tmp_path / "m"))
    split = model_store.load_split(spark, str(tmp_path / "m"), model.version)
    held = model_store.held_out(rows, split, LABEL)
    want = rows.where(rule.test_column(rows))
    assert held.columns == rows.columns and held.count() == want.count() and held.exceptAll(want).count() == 0
    assert FEATURE.names[0] == "symbol"
