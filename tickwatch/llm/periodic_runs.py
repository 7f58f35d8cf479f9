"""Runs: maximal stretches of words that repeat with a period, from suffix classes.

All suffixes of a text that share k words form the classes of level k. Going down
the levels, classes unite (Kruskal's rule over neighbours in suffix order, longest
common prefix first, with union-find); each class holds its positions in order.
When two positions i < j become neighbours in a united class, their longest common
prefix L is exactly the level, so the words from i on repeat with period j - i for
L + j - i words. If j - i <= L this is a square and seeds a run: j - i is its
smallest period, since a smaller one would have put a position in between, and it
ends where the prefix ends. The one seed that cannot be moved to the left gives the run.
Smaller sets are merged into larger ones, so a text of n words costs O(n log^2 n).

A run of `MIN_LENGTH` words and `MIN_EXPONENT` periods has neighbours that share
`max(MIN_LENGTH - q, (MIN_EXPONENT - 1) q)` words at least, so levels below the least
such value are never entered: only words of stretches that occur twice in a text are sorted.

Works row by row in Arrow batches, no shuffle; memory follows the longest text.
Null or empty texts have no words and no runs; a null id, repeated rows and further
columns are fine, each row is a text of its own; an empty table stays empty.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.llm.common import slices, texts
from tickwatch.session import ship_package

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
# Ordered sets are cut into pieces of at most twice this many positions.
PIECE = 512


def least_level(length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> int:
    """The fewest words that two neighbours of a wanted run share."""
    # The first bound falls and the second rises with the period.
    return min(max(length - q, (exponent - 1) * q, 1) for q in range(1, length + 1))


class Positions:
    """An ordered set of positions in pieces of bounded length."""

    __slots__ = ("pieces", "size", "tops")

    def __init__(self, position: int):
        self.pieces, self.tops, self.size = [[position]], [position], 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def add(self, x: int) -> tuple[int, int]:
        """Put x in; the positions before and after it, -1 where there is none."""
        k = bisect_left(self.tops, x) if len(self.tops) > 1 else 0
        if k == len(self.tops):
            k -= 1
        piece = self.pieces[k]
        i = bisect_left(piece, x)
        before = piece[i - 1] if i else self.tops[k - 1] if k else -1
        after = piece[i] if i < len(piece) else self.pieces[k + 1][0] if k + 1 < len(self.pieces) else -1
        piece.insert(i, x)
        if len(piece) > 2 * PIECE:
            self.pieces[k:k + 1] = [piece[:PIECE], piece[PIECE:]]
            self.tops[k:k + 1] = [piece[PIECE - 1], piece[-1]]
        else:
            self.tops[k] = piece[-1]
        self.size += 1
        return before, after


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _pairs(ranks: np.ndarray, step: int) -> np.ndarray:
    """The ranks of stretches of twice the length, or `step` words more; beyond the end nothing follows."""
    behind = np.zeros(len(ranks), np.int64)
    behind[:-step or None] = ranks[step:] + 1 if step < len(ranks) else 0
    return _ranks(ranks * (int(ranks.max(initial=0)) + 2) + behind)


def _shared(ids: np.ndarray, level: int) -> np.ndarray:
    """Whether the `level` words from each position on occur twice; every word that ends a text is unique."""
    ranks, length = ids, 1
    while length < level:
        step = min(length, level - length)
        ranks, length = _pairs(ranks, step), length + step
    return np.bincount(ranks)[ranks] > 1 if len(ranks) else np.zeros(0, bool)


def _neighbours(ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, L): positions that are neighbours in suffix order and their longest common prefix, L >= level."""
    steps, ranks = [ids], ids
    while len(np.unique(ranks)) < len(ranks):
        ranks = _pairs(ranks, 1 << (len(steps) - 1))
        steps.append(ranks)
    order = np.argsort(ranks, kind="stable")
    i, j = order[:-1], order[1:]
    length = np.zeros(len(i), np.int64)
    padded = [np.concatenate([r, [-1]]) for r in steps]
    end = len(ids)
    for k in range(len(steps) - 1, -1, -1):
        a, b = np.minimum(i + length, end), np.minimum(j + length, end)
        same = (padded[k][a] == padded[k][b]) & (a < end) & (b < end)
        length += same.astype(np.int64) << k
    near = length >= level
    return i[near], j[near], length[near]


def seeds(i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(position, distance, common prefix) of newly adjacent positions at distance within the prefix."""
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for k in np.argsort(-shared, kind="stable").tolist():
        a, b, level = int(i[k]), int(j[k]), int(shared[k])
        for x in (a, b):
            if x not in parent:
                parent[x], sets[x] = x, Positions(x)
        a, b = find(a), find(b)
        if sets[a].size < sets[b].size:
            a, b = b, a
        parent[b] = a
        large = sets[a]
        smaller = list(sets.pop(b))
        last = -1
        for x, following in zip(smaller, [*smaller[1:], None]):
            before, after = large.add(x)
            # Two positions of the smaller set that lie next to each other were neighbours already.
            if before >= 0 and before != last and x - before <= level:
                yield before, x - before, level
            # A further one may come in between.
            if after >= 0 and after - x <= level and (following is None or following > after):
                yield x, after - x, level
            last = x


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period, in word numbers of one or several texts.

    Several texts are told apart by a unique number behind each.
    """
    level = least_level(min_length, exponent)
    shared = _shared(ids, level)
    if not shared.any():
        return []
    # Stretches that occur twice, with the words they reach over; a unique number where others were left out.
    reach = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(shared)
    reach[at] += 1
    np.add.at(reach, np.minimum(at + level, len(ids)), -1)
    kept = np.cumsum(reach[:-1]) > 0
    ends = np.flatnonzero(kept & ~np.append(kept[1:], False)) + 1
    places = np.sort(np.concatenate([np.flatnonzero(kept), ends]))
    breaks = np.searchsorted(places, ends, "right") - 1
    compact = np.where(places < len(ids), ids[np.minimum(places, len(ids) - 1)], 0)
    compact[breaks] = int(ids.max()) + 1 + np.arange(len(breaks))
    i, j, common = _neighbours(compact, level)
    runs = []
    for start, period, common_words in seeds(i, j, common):
        length = common_words + period
        if length < min_length or length < exponent * period:
            continue
        first = int(places[start])
        if first and ids[first - 1] == ids[first + period - 1]:
            continue
        runs.append((first, length, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def _stretch(values: list[str], min_length: int, exponent: int):
    """Runs and collapsed text of each value; the texts of a stretch are searched together."""
    numbers: dict[bytes, int] = {}
    split = [v.encode().split() for v in values]
    starts = np.cumsum([0, *[len(w) + 1 for w in split]])
    ids = np.empty(int(starts[-1]), np.int64)
    for start, words in zip(starts.tolist(), split):
        ids[start:start + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    ids[starts[1:] - 1] = len(numbers) + np.arange(len(values))
    found = [[] for _ in values]
    # The same stretch in two texts is no repetition: words are told apart by their text where that matters.
    for start, length, period in find_runs(_by_text(ids, starts), min_length, exponent):
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[k].append((start - int(starts[k]), length, period))
    return [(len(words), runs, collapse(words, runs)) for words, runs in zip(split, found)]


def _by_text(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal words of one text only."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return _ranks(text * (int(ids.max(initial=0)) + 1) + ids)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row."""
    ship_package(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            column = batch.column(1)
            for start, end in slices(column):
                out = _stretch(column.slice(start, end - start).to_pylist(), min_length, exponent)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start), pa.array([n for n, _, _ in out], pa.int64()),
                    pa.array([[dict(zip(RUN.names, r)) for r in runs] for _, runs, _ in out], pa.list_(_ARROW_RUN)),
                    pa.array([text.decode() for _, _, text in out], pa.string())], _SCHEMA.names)

    return texts(docs, id_col, text_col).mapInArrow(scan, _SCHEMA)


def strongest(runs: str | Column) -> Column:
    """The run of greatest length / period; ties: smallest start, then period. Null without runs."""

    def order(x, y):
        # x before y when its exponent is greater; products of lengths and periods stay exact.
        mine, other = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(mine > other, -1).when(mine < other, 1).when(x["start"] < y["start"], -1)
                .when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1)
                .when(x["period"] > y["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, order), 0)
