"""Isolation Forest: distributed subsampling and fit, vectorised scoring."""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.functions import isolation
from tickwatch.functions.columns import is_finite
from tickwatch.operators import tree_levels
from tickwatch.operators.quantiles import quantiles, values_at
from tickwatch.operators.scaler import moments, standardize
from tickwatch.schema import FEATURES, LABEL, NODES
from tickwatch.session import ship_package, stage, staged

# Fixed values of the model.
N_ESTIMATORS = 200
CONTAMINATION = 0.01
SEED = 42
AUTO_SAMPLES = 256
# More nodes than this stay a table, and scoring broadcasts as many of them at a time (about 64 MB).
# A tree is broadcast whole, which bounds its subsample; the number of trees and rows is free.
NODES_AT_ONCE = 2_000_000
MAX_SAMPLES = NODES_AT_ONCE // 2


@dataclass
class ForestModel:
    """Scaler and trees together: at most n_estimators * (2 psi - 1) nodes.

    `nodes` is a frame on the driver, or a stored table where there are more than `NODES_AT_ONCE`.
    """

    nodes: pd.DataFrame | DataFrame
    means: list[float]
    scales: list[float]
    psi: int
    contamination: float
    offset: float
    seed: int
    n_train: int
    max_samples: str = "auto"
    version: str = ""
    n_estimators: int = field(init=False)

    def __post_init__(self):
        if isinstance(self.nodes, DataFrame):
            facts = self.nodes.agg(
                F.countDistinct("tree_id"), F.count(F.lit(1)),
                F.hex(F.bit_xor(F.xxhash64("tree_id", "node_id", "feature", "threshold", "n_samples")))).first()
            self.n_estimators, n_nodes, content = facts
        else:
            self.n_estimators, n_nodes = int(self.nodes["tree_id"].nunique()), len(self.nodes)
            content = self.nodes[NODES.names].to_csv(index=False) if not self.version else ""
        limit = self.n_estimators * max(1, 2 * self.psi - 1)
        if n_nodes > limit:
            raise ValueError(f"{n_nodes} nodes, at most {limit} expected")
        if not self.version:
            digest = hashlib.sha1(content.encode())
            digest.update(repr((self.means, self.scales, self.offset)).encode())
            self.version = digest.hexdigest()[:12]

    def parts(self) -> Iterator[pd.DataFrame]:
        """The nodes of whole trees, about `NODES_AT_ONCE` at a time."""
        if not isinstance(self.nodes, DataFrame):
            yield self.nodes
            return
        each = max(1, NODES_AT_ONCE // max(1, 2 * self.psi - 1))
        trees = sorted(r["tree_id"] for r in self.nodes.select("tree_id").distinct().collect())
        for first in range(0, len(trees), each):
            yield self.nodes.where(F.col("tree_id").isin(trees[first:first + each])).toPandas()

    def scaler_rows(self) -> list[tuple]:
        return [(c, i, self.means[i], self.scales[i]) for i, c in enumerate(FEATURES)]

    def meta_row(self) -> tuple:
        return (self.version, self.n_estimators, self.max_samples, self.psi, self.contamination,
                self.offset, self.seed, self.n_train)


def _unit(*columns) -> Column:
    """A repeatable uniform value in [0, 1) from 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def draw_subsamples(
    rows: DataFrame, key: list[str], n_rows: int, n_trees: int, size: int, seed: int, slack: float = 6.0
) -> DataFrame:
    """For every tree an independent random set of about size + slack * sqrt(size) rows.

    Each (row, tree) pair is drawn with the same small probability. A row's first
    tree follows from one hash (a geometric draw), so a row that no tree wants
    costs a single hash, not one per tree; the rest is a map over few rows.
    """
    p = min(1.0, (size + slack * math.sqrt(size)) / n_rows)
    if p >= 1.0:
        chosen = rows.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    else:
        first = F.floor(F.log1p(-_unit(*key, F.lit(seed))) / F.lit(math.log1p(-p)))
        wanted = rows.withColumn("_first", first).where(F.col("_first") < n_trees)
        trees = F.filter(
            F.sequence(F.lit(0), F.lit(n_trees - 1)),
            lambda t: (t == F.col("_first"))
            | ((t > F.col("_first")) & (_unit(*key, t, F.lit(seed + 1)) < p)),
        )
        chosen = wanted.withColumn("tree_id", F.explode(trees)).drop("_first")
    return chosen.withColumn("_draw", F.xxhash64(*key, "tree_id", F.lit(seed + 2)))


def _tree_builder(key: list[str], size: int, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        # Sorting by key makes the tree independent of how rows were partitioned.
        chosen = pdf.sort_values(["_draw", *key]).head(size).sort_values(key)
        rng = np.random.default_rng([seed, tree_id])
        nodes = isolation.grow_tree(chosen[FEATURES].to_numpy(dtype=float), rng)
        return pd.DataFrame([(tree_id, *node) for node in nodes], columns=NODES.names)

    return build


def sample_size(n_rows: int, max_samples="auto") -> int:
    """Rows per tree: 256 (auto), a number, or a share of all rows (a float up to 1.0)."""
    if max_samples == "auto":
        return min(AUTO_SAMPLES, n_rows)
    if isinstance(max_samples, float):
        if not 0 < max_samples <= 1:
            raise ValueError("max_samples as a share must be above 0 and at most 1")
        wanted = max(1, int(max_samples * n_rows))
    else:
        wanted = min(int(max_samples), n_rows)
    if not 1 <= wanted <= MAX_SAMPLES:
        raise ValueError(f"max_samples must be within 1..{MAX_SAMPLES} rows")
    return wanted


def fit_trees(
    scaled: DataFrame, key: list[str], n_rows: int, n_trees: int, size: int, seed: int
) -> pd.DataFrame | DataFrame:
    """All tree nodes. Small subsamples are one group and one task per tree, larger ones grow level by level."""
    ship_package(scaled.sparkSession)
    slack = 6.0
    while True:
        drawn = draw_subsamples(scaled.select(*key, *FEATURES), key, n_rows, n_trees, size, seed, slack)
        nodes = (_small_trees(drawn, key, n_trees, size, seed) if size <= tree_levels.SUBTREE_ROWS
                 else _large_trees(drawn, n_rows, n_trees, size, seed))
        if nodes is not None:
            return nodes
        if slack > 1_000:
            raise ValueError(f"the row key {key} is not unique: subsamples stay incomplete")
        slack *= 4


def _small_trees(drawn: DataFrame, key: list[str], n_trees: int, size: int, seed: int) -> pd.DataFrame | None:
    # Few bytes but much work per tree: adaptive execution would put all trees
    # into one task, so the number of tasks is set here.
    tasks = min(n_trees, 4 * drawn.sparkSession.sparkContext.defaultParallelism)
    nodes = drawn.repartition(tasks, "tree_id").groupBy("tree_id").applyInPandas(
        _tree_builder(key, size, seed), NODES).toPandas()
    roots = nodes[nodes["node_id"] == 0]
    return nodes if len(roots) == n_trees and (roots["n_samples"] == size).all() else None


def _large_trees(drawn: DataFrame, n_rows: int, n_trees: int, size: int, seed: int) -> pd.DataFrame | DataFrame | None:
    """Nodes of large trees; None if a tree drew fewer rows than wanted. No tree is in one task at any time."""
    place = F.shiftrightunsigned("_draw", 11).cast("double")
    rows = stage(drawn.select("tree_id", place.alias("_place"), *FEATURES), "drawn")
    if size < n_rows:
        # The rows with the smallest draws, found by counts.
        cuts = {r["tree_id"]: r["value"] for r in values_at(rows, "_place", [size - 1], ["tree_id"]).collect()}
        if len(cuts) < n_trees:
            return None
        last = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
        rows = rows.where(F.col("_place") <= last[F.col("tree_id")])
    nodes = stage(tree_levels.numbered(tree_levels.grow(rows, size, seed)), "nodes")
    return nodes.toPandas() if nodes.count() <= NODES_AT_ONCE else nodes


def fit_forest(
    train: DataFrame,
    key: list[str],
    n_estimators: int = N_ESTIMATORS,
    max_samples="auto",
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> ForestModel:
    """Fit on complete rows; labels are not looked at. `key` must identify a row."""
    first = moments(train).first()
    n_rows = first["n"]
    if n_rows == 0:
        raise ValueError("no rows to train on")
    means = [first[f"m{i}"] for i in range(len(FEATURES))]
    scales = [first[f"s{i}"] or 1.0 for i in range(len(FEATURES))]
    size = sample_size(n_rows, max_samples)
    nodes = fit_trees(standardize(train, means, scales), key, n_rows, n_estimators, size, seed)
    model = ForestModel(nodes, means, scales, size, contamination, 0.0, seed, n_rows, str(max_samples))
    offset = contamination_threshold(score_samples(train, model), contamination)
    return ForestModel(nodes, means, scales, size, contamination, offset, seed, n_rows, str(max_samples))


def contamination_threshold(scored: DataFrame, contamination: float) -> float:
    """The exact quantile of the training scores below which a row is an anomaly.

    The search reads the scores several times, so they are written out first: one column.
    """
    with staged(scored.select("score_sample"), "scores") as scores:
        return quantiles(scores, "score_sample", [contamination]).first()["quantile"]


def score_samples(features: DataFrame, model: ForestModel) -> DataFrame:
    """Add score_sample = -2^(-mean path / c(psi)); null where a feature is missing or not finite.

    Trees are broadcast `NODES_AT_ONCE` nodes at a time; between two parts of a large
    forest the rows are written with the path lengths so far.
    """
    spark = features.sparkSession
    ship_package(spark)
    norm = float(isolation.path_norm(model.psi)) or 1.0
    complete = F.lit(True)
    for c in FEATURES:
        complete = complete & is_finite(c)
    scaled = [
        (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(FEATURES, model.means, model.scales)
    ]
    rows, before = features, F.lit(0.0)
    parts = model.parts()
    part = next(parts)
    while part is not None:
        path = _path_column(spark, part)
        part = next(parts, None)
        if part is not None:
            rows = stage(rows.withColumn("_path", before + path(*scaled)), "paths")
            before = F.col("_path")
    score = -F.pow(F.lit(2.0), -(before + path(*scaled)) / F.lit(model.n_estimators * norm))
    return rows.withColumn("score_sample", F.when(complete, score)).drop("_path")


def _path_column(spark: SparkSession, nodes: pd.DataFrame):
    """The sum of path lengths over the given trees, as a function of scaled feature columns."""
    shared = spark.sparkContext.broadcast(isolation.pack_forest(nodes))

    @F.pandas_udf("double")
    def path(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        for columns in batches:
            yield pd.Series(isolation.total_path(trees, [c.to_numpy(dtype=float) for c in columns]))

    return path


def score(features: DataFrame, model: ForestModel | None) -> DataFrame:
    """Add anomaly_score (lower is more anomalous), is_anomaly (score below 0), model_version.

    A label the rows may carry in is_anomaly is kept as `label`.
    """
    if model is None:
        raise RuntimeError("no model loaded")
    scored = score_samples(features.withColumnRenamed(LABEL, "label"), model)
    decision = F.col("score_sample") - F.lit(model.offset)
    return (
        scored.withColumn("anomaly_score", decision)
        .withColumn("is_anomaly", F.col("anomaly_score") < 0)
        .withColumn("model_version", F.lit(model.version))
        .drop("score_sample")
    )
