"""Isolation trees of any size, grown level by level in Spark.

A tree of a few thousand rows is grown in one task (`operators/forest.py`). For larger
subsamples all nodes of a level are handled together: one aggregation gives every
node's row count and the least and greatest value of each feature, a hash of the
node picks feature and threshold, and the rows move on to the children. A
node is a task's business only once it has few rows. Nodes stay a table; their
identity is the path from the root (root 1, children 2 p and 2 p + 1).
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.functions import isolation
from tickwatch.functions.columns import uniform
from tickwatch.operators.ordered import scan_in_order
from tickwatch.schema import FEATURES, NODES
from tickwatch.session import ship_package, stage

# A node of so many rows at most is finished in one task.
SUBTREE_ROWS = 4_096
# Nodes of a level are broadcast to the rows up to this number; the table has about 40 bytes a row.
BROADCAST_NODES = 200_000
GROWN = T.StructType([
    T.StructField("tree_id", T.IntegerType()), T.StructField("path", T.LongType()), T.StructField("depth", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("n_samples", T.LongType())])


def node_facts(rows: DataFrame) -> DataFrame:
    """Row count, least and greatest values of every (tree_id, path)."""
    return rows.groupBy("tree_id", "path").agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[f(c).alias(f"{name}_{i}") for i, c in enumerate(FEATURES) for name, f in (("low", F.min), ("high", F.max))])


def with_split(facts: DataFrame, seed: int) -> DataFrame:
    """Add feature and threshold: a feature that varies and a value within its spread, both uniform; -1 for none."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"low_{i}").alias("low"), F.col(f"high_{i}").alias("high"))
                        for i in range(len(FEATURES))])
    usable = F.filter(entries, lambda e: e["high"] - e["low"] > isolation.MIN_SPREAD)
    node = F.concat_ws("/", "tree_id", "path")
    drawn = facts.withColumn("_usable", usable).withColumn(
        "_e", F.get("_usable", F.floor(uniform(node, seed, 1) * F.size("_usable")).cast("int")))
    cut = F.col("_e.low") + uniform(node, seed, 2) * (F.col("_e.high") - F.col("_e.low"))
    return drawn.withColumns({
        "feature": F.coalesce(F.col("_e.i"), F.lit(isolation.LEAF)),
        # Rounding may reach the upper end, which would leave the right child empty.
        "threshold": F.when(cut >= F.col("_e.high"), F.col("_e.low")).otherwise(cut)}).drop("_usable", "_e")


def _value(feature: str) -> Column:
    value = F.lit(None).cast("double")
    for i, c in enumerate(FEATURES):
        value = F.when(F.col(feature) == i, F.col(c)).otherwise(value)
    return value


def _finish(seed: int, limit: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree, path, depth = (int(rows[c].iloc[0]) for c in ("tree_id", "path", "depth"))
        # Sorted by value, so that the subtree does not depend on how rows were partitioned.
        values = rows[FEATURES].sort_values(FEATURES, kind="stable").to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree, path])
        nodes = isolation.grow_tree(values, rng, max(limit - depth, 0))
        paths = {0: path}
        for i, feature, _, left, right, _, _ in nodes:
            if feature != isolation.LEAF:
                paths[left], paths[right] = 2 * paths[i], 2 * paths[i] + 1
        return pd.DataFrame([(tree, paths[i], depth + d, feature, cut, n) for i, feature, cut, _, _, d, n in nodes],
                            columns=GROWN.names)

    return build


def grow(samples: DataFrame, size: int, seed: int, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """The nodes (GROWN) of one tree per tree_id over samples (tree_id and the features)."""
    ship_package(samples.sparkSession)
    limit = isolation.height_limit(size)
    rows = stage(samples.select("tree_id", F.lit(1).cast("long").alias("path"), *FEATURES), "level")
    done, left = [], []
    for depth in range(limit + 1):
        facts = stage(node_facts(rows), "facts")
        count, largest = facts.agg(F.count(F.lit(1)), F.max("n_samples")).first()
        if not count:
            break
        small = (F.col("n_samples") <= subtree_rows) & (F.col("n_samples") > 1) & F.lit(depth < limit)
        nodes = with_split(facts, seed).withColumn("depth", F.lit(depth)).withColumn(
            "feature", F.when(F.lit(depth >= limit) | (F.col("n_samples") <= 1), isolation.LEAF).otherwise(F.col("feature")))
        nodes = nodes.withColumn("threshold", F.when(F.col("feature") != isolation.LEAF, F.col("threshold")))
        done.append(nodes.where(~small).select(*GROWN.names))
        told = F.broadcast if count <= BROADCAST_NODES else (lambda df: df)
        keys = ["tree_id", "path"]
        if subtree_rows > 1 and depth < limit:
            left.append(rows.join(told(nodes.where(small).select(*keys)), keys, "left_semi").withColumn("depth", F.lit(depth)))
        if depth >= limit or largest <= subtree_rows:
            break
        parents = nodes.where(~small & (F.col("feature") != isolation.LEAF)).select(*keys, "feature", "threshold")
        side = F.when(_value("feature") <= F.col("threshold"), F.lit(0)).otherwise(F.lit(1))
        rows = stage(rows.join(told(parents), keys).select(
            "tree_id", (F.col("path") * 2 + side).alias("path"), *FEATURES), "level")
    grown = done[0]
    for part in done[1:]:
        grown = grown.unionByName(part)
    if left:
        rest = left[0]
        for part in left[1:]:
            rest = rest.unionByName(part)
        grown = grown.unionByName(rest.groupBy("tree_id", "path").applyInPandas(_finish(seed, limit), GROWN))
    return stage(grown, "grown")


def numbered(grown: DataFrame) -> DataFrame:
    """NODES rows: node ids 0 .. n - 1 in the order of paths, and children by their ids."""
    ids = stage(scan_in_order(grown, ["tree_id"], ["path"], position="node_id"), "nodes")
    child = ids.select(F.col("tree_id").alias("_tree"), F.col("path").alias("_path"), F.col("node_id").cast("int").alias("_id"))

    def with_child(df: DataFrame, name: str, path: Column) -> DataFrame:
        there = F.col("feature") != isolation.LEAF
        joined = df.join(child, there & (F.col("tree_id") == F.col("_tree")) & (path == F.col("_path")), "left")
        return joined.withColumn(name, F.coalesce("_id", F.lit(isolation.LEAF))).drop("_tree", "_path", "_id")

    both = with_child(with_child(ids, "left", F.col("path") * 2), "right", F.col("path") * 2 + 1)
    return both.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NODES.fields])
