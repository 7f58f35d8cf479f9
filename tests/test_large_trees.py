"""Trees of large subsamples: grown level by level, kept as a table, scored in parts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwatch.functions import isolation
from tickwatch.operators import forest, tree_levels
from tickwatch.schema import FEATURES, NODES
from tickwatch.sources import model_store

KEY = ["id"]


def normal_rows(spark, n):
    df = spark.range(n).withColumn("is_anomaly", F.lit(None).cast("int"))
    return df.withColumns({c: F.round(F.randn(i), 3) if i else F.lit(1.0) for i, c in enumerate(FEATURES)})


def check_trees(nodes: pd.DataFrame, size: int, samples: pd.DataFrame | None = None):
    limit = isolation.height_limit(size)
    for _, tree in nodes.groupby("tree_id"):
        tree = tree.set_index("node_id").sort_index()
        assert list(tree.index) == list(range(len(tree)))
        assert tree.loc[0, "n_samples"] == size and tree["depth"].max() <= limit
        inner = tree[tree["feature"] >= 0]
        for node in inner.itertuples():
            low, high = tree.loc[node.left], tree.loc[node.right]
            assert low["n_samples"] + high["n_samples"] == node.n_samples and min(low["n_samples"], high["n_samples"]) > 0
            assert low["depth"] == high["depth"] == node.depth + 1
        assert (inner["feature"] != 0).all()
        if samples is not None:
            at = {0: samples}
            for node in inner.itertuples():
                rows = at.pop(node.Index)
                goes = rows[FEATURES[int(node.feature)]] <= node.threshold
                at[int(node.left)], at[int(node.right)] = rows[goes], rows[~goes]
            assert all(len(rows) == tree.loc[i, "n_samples"] for i, rows in at.items())
            for i, rows in at.items():
                spread = (rows[FEATURES].max() - rows[FEATURES].min()).max()
                assert len(rows) <= 1 or spread <= isolation.MIN_SPREAD or tree.loc[i, "depth"] == limit


@pytest.mark.parametrize("subtree_rows", [1, 40, 10**6])
def test_levels_and_subtrees_make_valid_trees(spark, subtree_rows):
    rows = normal_rows(spark, 500)
    samples = rows.withColumn("tree_id", F.explode(F.array(F.lit(0), F.lit(1))))
    nodes = tree_levels.numbered(tree_levels.grow(samples, 500, 7, subtree_rows))
    assert [f.dataType for f in nodes.schema] == [f.dataType for f in NODES]
    check_trees(nodes.toPandas(), 500, rows.toPandas())


def test_levels_do_not_depend_on_partitions(spark):
    samples = normal_rows(spark, 300).withColumn("tree_id", F.lit(0))
    one, two = (tree_levels.grow(df, 300, 7, 30).toPandas().sort_values("path", ignore_index=True)
                for df in (samples, samples.repartition(5, "id")))
    pd.testing.assert_frame_equal(one, two)


def test_equal_rows_and_single_rows_are_leaves(spark):
    same = spark.range(50).withColumns({c: F.lit(2.5) for c in FEATURES}).withColumn("tree_id", F.lit(0))
    grown = tree_levels.grow(same, 50, 1, 1).collect()
    assert [(r["path"], r["feature"], r["n_samples"]) for r in grown] == [(1, -1, 50)]
    assert tree_levels.grow(same.limit(1), 1, 1, 1).first()["n_samples"] == 1


def test_a_hundred_thousand_rows_per_tree(spark):
    rows = normal_rows(spark, 130_000)
    model = forest.fit_forest(rows, KEY, n_estimators=2, max_samples=100_000)
    assert model.psi == 100_000 and model.n_estimators == 2
    roots = model.nodes[model.nodes["node_id"] == 0]
    assert sorted(roots["n_samples"]) == [100_000] * 2
    assert isolation.height_limit(100_000) == 17 and model.nodes["depth"].max() <= 17
    flagged = forest.score(rows, model).where("is_anomaly").count()
    # Few trees score many rows alike; rows at the cut-off itself are not below it.
    assert flagged <= 1_300


def test_a_share_of_all_rows(spark):
    rows = normal_rows(spark, 10_000)
    model = forest.fit_forest(rows, KEY, n_estimators=2, max_samples=0.5)
    assert model.psi == 5_000 and model.max_samples == "0.5"
    check_trees(model.nodes, 5_000)
    for bad in (0.0, 1.5, 0, -3):
        with pytest.raises(ValueError):
            forest.sample_size(100, bad)


def test_a_table_of_nodes_scores_like_a_frame(spark, tmp_path, monkeypatch):
    rows = normal_rows(spark, 3_000)
    model = forest.fit_forest(rows, KEY, n_estimators=6, max_samples=200)
    want = {r["id"]: r["anomaly_score"] for r in forest.score(rows, model).collect()}
    table = spark.createDataFrame(model.nodes, NODES)
    # Two trees of at most 399 nodes at a time.
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 800)
    large = forest.ForestModel(table, model.means, model.scales, model.psi, 0.01, model.offset, 42, 3_000)
    assert large.n_estimators == 6 and len(list(large.parts())) == 3
    got = {r["id"]: r["anomaly_score"] for r in forest.score(rows, large).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in want)
    monkeypatch.setattr(model_store, "NODES_AT_ONCE", 100)
    model_store.save_model(spark, large, str(tmp_path / "m"))
    back = model_store.load_model(spark, str(tmp_path / "m"))
    assert not isinstance(back.nodes, pd.DataFrame) and back.version == large.version
    again = {r["id"]: r["anomaly_score"] for r in forest.score(rows, back).collect()}
    assert np.allclose([again[i] for i in sorted(want)], [want[i] for i in sorted(want)])
