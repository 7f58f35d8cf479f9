"""Hard negatives of embeddings by exact integer products, many candidates at once.

Components become integers (floor(256 x)). The j-th components of a few thousand
candidates, biased so that none is negative, are written side by side into one
wide integer W_j with a field of fixed width per candidate. For an anchor a the
sum of a_j * W_j holds all its products at once: one multiplication per anchor
component (Kronecker substitution). A constant added to every field keeps fields
from borrowing; unpacked and corrected they are the exact inner products. Field
widths follow from the largest components, so no product is ever rounded.

Candidates lie in blocks of bounded size, spread without regard to id or label;
anchors, one row in a hundred, travel once to every block in each of two passes: the
first finds the best rows of the anchor's label, the second the rows of other labels
whose score is a given share of a positive's. Blocks hand on the best of their own
rows alone, and ranks follow from one shuffle by anchor. A task holds one block and
reads anchors as a stream, so memory does not grow with the table.

Defined results: rows without an id, a label or a vector, or with a null or
non-finite component, take no part; components and scores
saturate at 64 bits. Vectors of different lengths
have no product and do not meet. A row never meets rows of its own id; repeated
anchor rows are mined one by one, repeated rows take a rank each. Ties go to the smaller id.
Further columns are ignored; an empty table gives no rows.
"""

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.session import ship_package, stage

POSITIVES, NEGATIVES = 5, 10
# A negative's score in percent of the positive's.
LEAST, MOST = 30, 90
SCALE = 256
BLOCK_ROWS = 65_536
# Candidates of one wide integer: the integers of one block's components stay in a core's cache.
FIELDS = 4_096
_BEST = T.StructType([T.StructField("anchor_no", T.LongType()), T.StructField("id", T.LongType()),
                      T.StructField("score", T.LongType())])
# Scores saturate here.
_BOUND = 2**63 - 1


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label and integer components of the rows that take part."""
    whole = F.forall(vectors[vector_col], lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    comps = F.transform(vectors[vector_col], lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return vectors.filter(vectors[id_col].isNotNull() & label.isNotNull() & vectors[vector_col].isNotNull() & whole).select(
        vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), comps.alias("comps"))


class Packed:
    """Candidates as wide integers, `FIELDS` of them in each."""

    def __init__(self, comps: np.ndarray):
        self.count, self.dim = comps.shape
        self.comps = comps
        self.bias = int(max(0, -int(comps.min()))) if comps.size else 0
        self.top = int(comps.max()) + self.bias if comps.size else 0
        self.bytes = 0

    def _pack(self, width: int) -> None:
        self.bytes, self.blocks = width, []
        for start in range(0, self.count, FIELDS):
            part = self.comps[start:start + FIELDS]
            if width <= 8:
                fields = np.ascontiguousarray((part + self.bias).astype(f"<u{width}").T)
                wide = [int.from_bytes(row.tobytes(), "little") for row in fields]
            else:
                wide = [int.from_bytes(b"".join((x + self.bias).to_bytes(width, "little") for x in row), "little")
                        for row in part.T.tolist()]
            ones = int.from_bytes((b"\1" + bytes(width - 1)) * len(part), "little")
            self.blocks.append((len(part), wide, ones))

    def products(self, anchor: list[int]) -> np.ndarray:
        """The inner products of all candidates with one anchor, saturated at 64 bits."""
        if not self.comps.size:
            return np.zeros(self.count, np.int64)
        # What a field gains so that it is never negative, and all that a field holds beyond its score.
        offset = self.top * -sum(x for x in anchor if x < 0)
        shift = offset + self.bias * sum(anchor)
        most = max(offset + self.top * sum(x for x in anchor if x > 0), self.top)
        narrow = most + abs(shift) < 2**63
        width = 4 if most < 2**32 else 8 if narrow else most.bit_length() // 8 + 1
        if width > self.bytes:
            self._pack(width)
        k, out = self.bytes, []
        for n, wide, ones in self.blocks:
            raw = sum(map(mul, anchor, wide), offset * ones).to_bytes(n * k, "little")
            if narrow and k <= 8:
                out.append(np.frombuffer(raw, f"<u{k}").astype(np.int64) - shift)
            else:
                out.append(np.array([max(-_BOUND, min(_BOUND, int.from_bytes(raw[i:i + k], "little") - shift))
                                     for i in range(0, len(raw), k)], np.int64))
        return np.concatenate(out)


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` best, by score downwards and then by id."""
    if len(scores) > 4 * most:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        return near[np.lexsort((ids[near], -scores[near]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def _window(positive: int, least: int, most: int) -> tuple[int, int]:
    """The integer scores s with least * positive <= 100 * s <= most * positive."""
    return -(-least * positive // 100), most * positive // 100


class Block:
    """The candidates of one block with one vector length, ready to be met by anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, comps: np.ndarray):
        self.ids, self.labels, self.comps = ids, labels, comps
        self.of_label: dict[int, tuple[np.ndarray, Packed]] = {}
        self.all: Packed | None = None

    def positives(self, own: int, label: int, anchor: list[int], most: int):
        if label not in self.of_label:
            rows = np.flatnonzero(self.labels == label)
            self.of_label[label] = rows, Packed(self.comps[rows])
        rows, packed = self.of_label[label]
        scores = packed.products(anchor)
        other = np.flatnonzero(self.ids[rows] != own)
        best = other[_first(scores[other], self.ids[rows][other], most)]
        return self.ids[rows[best]], scores[best]

    def negatives(self, own: int, label: int, anchor: list[int], positives: list[int], most: int, least: int, top: int):
        if self.all is None:
            self.all = Packed(self.comps)
        scores = self.all.products(anchor)
        windows = {_window(p, least, top) for p in positives}
        fit = (scores >= min(low for low, _ in windows)) & (scores <= max(high for _, high in windows))
        rows = np.flatnonzero(fit & (self.labels != label) & (self.ids != own))
        near, ids = scores[rows], self.ids[rows]
        found: set[int] = set()
        for low, high in windows:
            inside = np.flatnonzero((near >= low) & (near <= high))
            found.update(inside[_first(near[inside], ids[inside], most)].tolist())
        best = np.array(sorted(found), np.int64)
        return ids[best], near[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _meet(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, vector length and kind: a block's candidates (kind 0), then the anchors that meet them.

    `find(block, id, label, components, wanted)` gives ids and scores.
    """
    key, kept, block = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], 1)) + 1
        for start, end in zip([0, *edges], [*edges, len(keys)]):
            where, dim, kind = keys[start].tolist()
            if (where, dim) != key:
                key, kept, block = (where, dim), [], None
            part = batch.slice(start, end - start)
            ids, labels = (part.column(c).to_numpy() for c in (3, 4))
            comps = _matrix(part.column(5), dim)
            if kind == 0:
                kept.append((ids, labels, comps))
                continue
            if not kept:
                continue
            if block is None:
                block = Block(*map(np.concatenate, zip(*kept)))
            numbers, wanted, out = part.column(6).to_pylist(), part.column(7).to_pylist(), ([], [], [])
            for i in range(len(ids)):
                found, scores = find(block, int(ids[i]), int(labels[i]), comps[i].tolist(), wanted[i])
                out[0].extend([numbers[i]] * len(found))
                out[1].extend(found.tolist())
                out[2].extend(scores.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_no", "id", "score"])


def _against_blocks(candidates: DataFrame, anchors: DataFrame, blocks: int, find) -> DataFrame:
    """anchor_no, id, score of what `find` takes from each block for each anchor."""
    rows = candidates.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block"), F.size("comps").cast("long").alias("dim"),
        F.lit(0).cast("long").alias("kind"), "id", "label", "comps", F.lit(None).cast("long").alias("anchor_no"),
        F.lit(None).cast("array<bigint>").alias("wanted"))
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.size("comps").cast("long").alias("dim"), F.lit(1).cast("long").alias("kind"), "id", "label", "comps",
        "anchor_no", "wanted")
    order = ["block", "dim", "kind"]
    dealt = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions(*order)
    return dealt.select(*order, "id", "label", "comps", "anchor_no", "wanted").mapInArrow(
        lambda batches: _meet(batches, find), _BEST)


def block_count(spark: SparkSession, rows: int) -> int:
    """Blocks of `BLOCK_ROWS` rows at most, and enough of them for all cores."""
    return max(3 * spark.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS), 1)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST, blocks: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` says which rows ask (a column over id, label, comps), `label` replaces
    the column of that name. `least` and `most` are percentages of the positive's score.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = stage(integer_rows(vectors, id_col, vector_col, vectors["label"] if label is None else label), "vectors")
    count = blocks or block_count(spark, rows.count())
    asked = stage(rows.filter(anchor).withColumn("anchor_no", F.monotonically_increasing_id()), "anchors")

    def own_label(block, own, kind, comps, wanted):
        return block.positives(own, kind, comps, positives)

    def other_labels(block, own, kind, comps, wanted):
        return block.negatives(own, kind, comps, wanted, negatives, least, most)

    near = _against_blocks(rows, asked.withColumn("wanted", F.lit(None).cast("array<bigint>")), count, own_label)
    best = near.groupBy("anchor_no").agg(_ranked(F.collect_list(F.struct("score", "id"))).alias("found"))
    chosen = stage(best.select("anchor_no", F.slice("found", 1, positives).alias("positives")), "positives")
    again = asked.join(chosen, "anchor_no").withColumn("wanted", F.col("positives.score"))
    far = _against_blocks(rows, again, count, other_labels)
    lists = far.groupBy("anchor_no").agg(_ranked(F.collect_list(F.struct("score", "id"))).alias("found"))
    joined = asked.select("anchor_no", F.col("id").alias("anchor_id")).join(chosen, "anchor_no").join(lists, "anchor_no")
    pairs = joined.select("anchor_id", "found", F.explode("positives").alias("p"))
    fit = F.slice(F.filter("found", lambda n: _fits(n["score"], F.col("p.score"), least, most)), 1, negatives)
    return pairs.select("anchor_id", "p", F.posexplode(fit).alias("i", "n")).select(
        "anchor_id", F.col("p.id").alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"),
        F.col("n.score").alias("negative_score"))


def _ranked(found: Column) -> Column:
    """The found rows by score downwards, then by id; their number is bounded by what blocks hand on."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["score"]).alias("down"), x["id"].alias("id"))))
    return F.transform(ordered, lambda x: F.struct((-x["down"]).alias("score"), x["id"].alias("id")))


def _fits(score: Column, positive: Column, least: int, most: int) -> Column:
    # Decimals, as a hundred times a score may not fit 64 bits.
    s, p = score.cast("decimal(20,0)"), positive.cast("decimal(20,0)")
    return (p * least <= s * 100) & (s * 100 <= p * most)
