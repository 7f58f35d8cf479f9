"""Numeric helpers of the Isolation Forest (Liu, Ting, Zhou, ICDM 2008).

They only ever see one tree's subsample or one Arrow batch; Spark does the
partitioning, sampling, shuffling and broadcasting around them.
"""

import math

import numpy as np

EULER_GAMMA = 0.5772156649015329
LEAF = -1
# A narrower spread is rounding noise, not a value to split on.
MIN_SPREAD = 1e-7


def path_norm(n):
    """c(n): mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    general = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, general))


def height_limit(psi: int) -> int:
    return max(1, math.ceil(math.log2(max(psi, 2))))


def grow_tree(rows: np.ndarray, rng: np.random.Generator, limit: int | None = None) -> list[tuple]:
    """Random splits until a node is single, constant or at the height limit.

    Returns (node_id, feature, threshold, left, right, depth, n_samples).
    """
    limit = height_limit(len(rows)) if limit is None else limit
    nodes: list[list] = []
    todo = [(np.arange(len(rows)), 0, None, None)]
    while todo:
        index, depth, parent, side = todo.pop()
        node_id = len(nodes)
        if parent is not None:
            nodes[parent][side] = node_id
        node = [node_id, LEAF, None, LEAF, LEAF, depth, len(index)]
        nodes.append(node)
        if depth >= limit or len(index) <= 1:
            continue
        part = rows[index]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high - low > MIN_SPREAD)
        if usable.size == 0:
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        node[1], node[2] = feature, threshold
        goes_left = part[:, feature] <= threshold
        todo.append((index[~goes_left], depth + 1, node_id, 4))
        todo.append((index[goes_left], depth + 1, node_id, 3))
    return [tuple(node) for node in nodes]


def _siblings_adjacent(feature, left, right):
    """An order of the nodes, level by level, in which a right child follows its left one."""
    order = [0]
    for node in order:
        if feature[node] != LEAF:
            order += [left[node], right[node]]
    return np.array(order, dtype=np.intp)


def pack_forest(nodes) -> dict:
    """NODES rows (a pandas frame) as flat arrays, one block per tree.

    Right children sit behind left ones, so one step is left + (x > threshold).
    A leaf points to itself with an infinite threshold: a descent takes the same
    number of steps for every row and needs no masks.
    """
    nodes = nodes.sort_values(["tree_id", "node_id"])
    trees = []
    for _, tree in nodes.groupby("tree_id", sort=True):
        own = tree["node_id"].to_numpy()
        if not np.array_equal(own, np.arange(len(own))):
            raise ValueError("node ids of a tree must be 0..n-1")
        feature = tree["feature"].to_numpy()
        left = tree["left"].to_numpy()
        order = _siblings_adjacent(feature, left, tree["right"].to_numpy())
        place = np.empty(len(order), dtype=np.intp)
        place[order] = np.arange(len(order))
        leaf = feature[order] == LEAF
        depth = tree["depth"].to_numpy(dtype=float)[order]
        trees.append({
            "feature": np.where(leaf, 0, feature[order]).astype(np.intp),
            "threshold": np.where(leaf, np.inf, tree["threshold"].to_numpy(dtype=float)[order]),
            "left": np.where(leaf, place[order], place[left[order]]).astype(np.intp),
            "path": depth + path_norm(tree["n_samples"].to_numpy()[order]),
            "steps": int(depth.max()),
        })
    return {"trees": trees}


def mean_path(forest: dict, columns: list[np.ndarray]) -> np.ndarray:
    """Mean path length of each row of a batch over all trees."""
    return total_path(forest, columns) / len(forest["trees"])


def total_path(forest: dict, columns: list[np.ndarray]) -> np.ndarray:
    """Sum of the path lengths of each row of a batch over all trees; all buffers are reused."""
    n = len(columns[0])
    flat = np.concatenate(columns)
    rows = np.arange(n, dtype=np.intp)
    node, at, down = (np.empty(n, dtype=np.intp) for _ in range(3))
    value, cut, total = np.empty(n), np.empty(n), np.zeros(n)
    right = np.empty(n, dtype=bool)
    for tree in forest["trees"]:
        node.fill(0)
        start = tree["feature"] * n
        for _ in range(tree["steps"]):
            np.take(start, node, out=at, mode="clip")
            np.add(at, rows, out=at)
            np.take(flat, at, out=value, mode="clip")
            np.take(tree["threshold"], node, out=cut, mode="clip")
            np.greater(value, cut, out=right)
            np.take(tree["left"], node, out=down, mode="clip")
            np.add(down, right, out=node)
        np.take(tree["path"], node, out=value, mode="clip")
        total += value
    return total
