import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwatch.functions import isolation
from tickwatch.operators import forest, metrics
from tickwatch.plans import training
from tickwatch.plans.catalog import small_forest
from tickwatch.plans.domain import market_features
from tickwatch.schema import FEATURES, NODES
from tickwatch.sources import model_store

KEY = ["symbol", "window_start"]


@pytest.fixture(scope="module")
def trained(features):
    return training.train(features, n_estimators=60)


def test_path_norm():
    assert isolation.path_norm([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert float(isolation.path_norm(256)) == pytest.approx(10.244770920, abs=1e-8)
    assert isolation.height_limit(256) == 8


def test_grow_tree_invariants():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(256, 5))
    nodes = isolation.grow_tree(rows, rng)
    by_id = {n[0]: n for n in nodes}
    assert [n[0] for n in nodes] == list(range(len(nodes)))
    assert by_id[0][6] == 256 and max(n[5] for n in nodes) <= 8
    for node_id, feature, threshold, left, right, depth, n in nodes:
        if feature == isolation.LEAF:
            assert left == right == -1
        else:
            assert by_id[left][6] + by_id[right][6] == n
            assert by_id[left][6] > 0 and by_id[right][6] > 0


def test_constant_rows_make_one_leaf():
    assert len(isolation.grow_tree(np.ones((10, 5)), np.random.default_rng(0))) == 1


def test_batch_descent_equals_row_by_row():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(100, 5))
    frame = pd.DataFrame(
        [(t, *n) for t in range(7) for n in isolation.grow_tree(rows, np.random.default_rng(t))],
        columns=NODES.names)
    got = isolation.mean_path(isolation.pack_forest(frame), [rows[:, i].copy() for i in range(5)])
    for i in range(0, 100, 9):
        total = 0.0
        for _, tree in frame.groupby("tree_id"):
            tree = tree.set_index("node_id")
            at = 0
            while tree.loc[at, "feature"] >= 0:
                at = tree.loc[at, "left" if rows[i][tree.loc[at, "feature"]] <= tree.loc[at, "threshold"] else "right"]
            total += tree.loc[at, "depth"] + float(isolation.path_norm(tree.loc[at, "n_samples"]))
        assert got[i] == pytest.approx(total / 7)


def test_subsamples_are_independent_draws(spark):
    rows = spark.range(50_000).withColumn("x", F.rand(1))
    drawn = forest.draw_subsamples(rows, ["id"], 50_000, 40, 256, seed=5)
    sizes = [r["count"] for r in drawn.groupBy("tree_id").count().collect()]
    assert len(sizes) == 40 and all(256 <= s <= 480 for s in sizes)
    assert drawn.groupBy("tree_id", "id").count().where("count > 1").count() == 0
    # No part of the table is favoured and trees overlap only by chance.
    assert abs(drawn.agg(F.avg("id")).first()[0] - 25_000) < 800
    assert drawn.groupBy("id").count().where("count > 4").count() <= 10


def test_small_tables_give_every_row_to_every_tree(spark):
    drawn = forest.draw_subsamples(spark.range(100), ["id"], 100, 5, 100, seed=5)
    assert drawn.count() == 500


def test_training_is_repeatable_for_any_partitioning(features):
    one = forest.fit_forest(features, KEY, n_estimators=20)
    two = forest.fit_forest(features.repartition(7, "is_anomaly"), KEY, n_estimators=20)
    pd.testing.assert_frame_equal(
        one.nodes.sort_values(["tree_id", "node_id"], ignore_index=True)[["tree_id", "feature", "left", "n_samples"]],
        two.nodes.sort_values(["tree_id", "node_id"], ignore_index=True)[["tree_id", "feature", "left", "n_samples"]])


def test_contamination_share_on_training_rows(spark, features):
    model = forest.fit_forest(features, KEY, n_estimators=50, contamination=0.05)
    flagged = forest.score(features, model).where("is_anomaly").count()
    assert flagged == pytest.approx(0.05 * features.count(), abs=2)
    assert model.psi == 256 and model.n_estimators == 50


def test_labels_do_not_change_the_model(features):
    one = forest.fit_forest(features, KEY, n_estimators=5)
    two = forest.fit_forest(features.withColumn("is_anomaly", F.lit(0)), KEY, n_estimators=5)
    assert one.version == two.version


def test_key_that_is_not_unique_is_refused(features):
    with pytest.raises(ValueError):
        forest.fit_trees(features.limit(300).withColumn("k", F.lit(1)), ["k"], 100_000, 3, 256, 1)


def test_scores(spark, features, trained):
    scored = forest.score(features, trained.model)
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1 < low < 0 < high < 1
    assert scored.where("is_anomaly != (anomaly_score < 0)").count() == 0
    assert "label" in scored.columns
    broken = features.limit(1).withColumn("z_score_price", F.lit(None).cast("double"))
    assert forest.score(broken, trained.model).first()["anomaly_score"] is None


def test_scoring_without_a_model(features):
    with pytest.raises(RuntimeError):
        forest.score(features, None)


def test_preset_signs(spark):
    run = training.train(market_features(spark, "/root/testdata/sf0.1", "1 hour"))
    rows = {r["preset"]: r for r in training.score_presets(spark, run.model).collect()}
    assert rows["Normal"]["anomaly_score"] > 0 and not rows["Normal"]["is_anomaly"]
    assert rows["Normal"]["gauge"] == pytest.approx(rows["Normal"]["anomaly_score"] * 20)
    for name in ("Price Spike", "Volume Spike", "Flash Crash"):
        assert rows[name]["is_anomaly"] and rows[name]["gauge"] == 100.0
    flagged = forest.score(run.rows, run.model).where("is_anomaly").count()
    assert flagged / run.rows.count() == pytest.approx(0.01, abs=0.003)


def test_labelled_training_holds_out_a_fifth(trained):
    assert trained.mode == "labelled"
    n = trained.rows.count()
    assert trained.held_out().count() == pytest.approx(0.2 * n, abs=2)
    assert trained.model.n_train == n - trained.held_out().count()
    result = training.evaluate(trained)
    assert set(result) == {"scores", "report", "confusion"}
    assert result["report"].where("class = 'accuracy'").first()["support"] == trained.held_out().count()


def test_unsupervised_training_uses_all_rows(features):
    run = training.train(features.withColumn("is_anomaly", F.lit(0)), n_estimators=10)
    assert run.mode == "unsupervised" and run.rule is None
    result = training.evaluate(run)
    row = result["detected"].first()
    assert row["n_rows"] == features.count()
    assert row["detected_pct"] == pytest.approx(1.0, abs=0.3)


def test_model_store(spark, features, trained, tmp_path):
    path = str(tmp_path / "models")
    assert model_store.load_model(spark, path) is None
    assert model_store.model_info(spark, path).first().asDict() == {"loaded": False}
    model_store.save_model(spark, small_forest(features), path)
    model_store.save_model(spark, trained.model, path)
    model_store.save_model(spark, trained.model, path)
    loaded = model_store.load_model(spark, path)
    assert loaded.version == trained.model.version and loaded.offset == trained.model.offset
    a, b = (forest.score(features, m).select(*KEY, F.round("anomaly_score", 12)) for m in (loaded, trained.model))
    assert a.exceptAll(b).count() == 0
    assert model_store.load_model(spark, path, "small").n_estimators == 3
    info = model_store.model_info(spark, path).first()
    assert info["loaded"] and info["n_estimators"] == 60 and info["feature_names"] == FEATURES
    assert info["model_file_size_kb"] > 0 and info["model_file_modified"].startswith("20")
    assert info["scaler_means"][0] == pytest.approx(trained.model.means[0], abs=1e-6)


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "label int, predicted boolean")


def test_classification_report(spark):
    df = labelled(spark, [(0, False)] * 90 + [(0, True)] * 5 + [(1, False)] * 2 + [(1, True)] * 3)
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rows["1"]["precision"] == pytest.approx(3 / 8) and rows["1"]["recall"] == pytest.approx(3 / 5)
    assert rows["1"]["f1"] == pytest.approx(2 * 0.375 * 0.6 / 0.975)
    assert rows["accuracy"]["f1"] == pytest.approx(0.93) and rows["accuracy"]["precision"] is None
    assert rows["macro avg"]["recall"] == pytest.approx((90 / 95 + 0.6) / 2)
    assert rows["weighted avg"]["support"] == 100
    matrix = [tuple(r) for r in metrics.confusion_matrix(df).collect()]
    assert matrix == [(0, 90, 5), (1, 2, 3)]


def test_report_without_detections(spark):
    rows = {r["class"]: r for r in metrics.classification_report(labelled(spark, [(0, False), (1, False)])).collect()}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == (0.0, 0.0, 0.0)


def test_scoring_is_a_map(features, trained):
    plan = forest.score(features, trained.model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_sample_size_is_bounded():
    assert forest.sample_size(10**9) == 256 and forest.sample_size(100) == 100
    assert forest.sample_size(1000, 64) == 64
    with pytest.raises(ValueError):
        forest.sample_size(10**9, 10**8)


def test_versions_that_are_equal_as_numbers_stay_apart(spark, tmp_path, features):
    import dataclasses

    from tickwatch.plans.catalog import small_forest
    from tickwatch.sources.model_store import load_model, save_model

    model = small_forest(features)
    for version in ("1.0", "1.00"):
        save_model(spark, dataclasses.replace(model, version=version), str(tmp_path))
    for version in ("1.0", "1.00"):
        loaded = load_model(spark, str(tmp_path), version)
        assert len(loaded.nodes) == len(model.nodes) and loaded.version == version
