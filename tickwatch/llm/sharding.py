"""Reproducible shuffle and shards: a Feistel permutation of global row numbers.

Rows get the numbers 0 to N-1 in the order of their key. A number x is split into
x = r * a + l with a and b near the square root of N and a * b >= N; every round
adds a keyed hash of one half to the other, modulo a or b, which can be undone
without inverting the hash. Results of N or more (fewer than a of them exist) are
permuted again until one below N comes out: cycle walking, so that the numbers
below N are permuted among themselves. Row x goes to shard p % shards at slot
p div shards, p being its new number: shard sizes differ by one at most, slots
have no gaps, and both can be computed from x alone, as x from both (`row_at`).

Only DataFrame functions are used. The numbering shuffles the given columns once,
in ranges of the order; rows that tie in it get neighbouring numbers and are
spread over ranges too, so a repeated key fills no task. The order covers all
columns of the query, so tied rows are equal and results do not depend on files or
partitions. Null keys come first; an empty table stays empty; texts of any length
add their size and checksum alone; other columns are passed on untouched.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch.llm.common import let
from tickwatch.session import stage

SHARDS = 24
# What a row costs besides its text, in bytes.
ROW_BYTES = 8
ROUNDS = 6
# More steps of a walk than this come up once in 2**384 rows; they end in an error.
MAX_WALK = 64
_INDEX_BITS = (1 << 33) - 1


class Permutation:
    """A keyed permutation of 0 .. total - 1 as column expressions."""

    def __init__(self, total: int, key: str, rounds: int = ROUNDS):
        self.total, self.key, self.rounds = total, key, rounds
        self.a = max(1, math.isqrt(max(0, total - 1)) + 1)
        self.b = max(1, -(-total // self.a))

    def _noise(self, turn: Column, half: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(self.key), turn, half).cast("binary"))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")

    def _network(self, x: Column, sign: int) -> Column:
        """The rounds, or with sign -1 their inverse in reverse order."""
        a, b = F.lit(self.a).cast("bigint"), F.lit(self.b).cast("bigint")

        def turn(s, i):
            left = F.pmod(s["l"] + sign * F.pmod(self._noise(i, s["r"]), a), a)
            right = F.pmod(s["r"] + sign * F.pmod(self._noise(i, s["l"]), b), b)
            even = i % 2 == 0
            return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"),
                            F.when(even, s["r"]).otherwise(right).alias("r"))

        turns = range(self.rounds) if sign > 0 else reversed(range(self.rounds))
        start = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("bigint").alias("r"))
        if self.total > 2**52:
            raise ValueError("more rows than doubles can number")
        return F.aggregate(F.array(*[F.lit(i) for i in turns]), start, turn, lambda s: s["r"] * a + s["l"])

    def _walk(self, x: Column, sign: int) -> Column:
        total = F.lit(self.total).cast("bigint")
        steps = max(1, min(MAX_WALK, self.a * self.b - self.total))

        def further(y):
            inside = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y,
                                 lambda z, _: F.when(z < total, z).otherwise(self._network(z, sign)))
            lost = F.raise_error(F.lit("a walk did not end; choose another key")).cast("bigint")
            return F.when(y >= total, let(inside, lambda z: F.when(z >= total, lost).otherwise(z))).otherwise(y)

        return let(self._network(x, sign), further)

    def forward(self, x: Column) -> Column:
        return self._walk(x, 1)

    def inverse(self, p: Column) -> Column:
        return self._walk(p, -1)


def shard_of(p: Column, shards: int) -> Column:
    return F.pmod(p, F.lit(shards).cast("bigint")).cast("int")


def slot_of(p: Column, shards: int) -> Column:
    return F.floor(p / shards).cast("bigint")


def row_at(shard: Column, slot: Column, shuffle: Permutation, shards: int) -> Column:
    """The row number that lies at a slot of a shard; null where no row does."""
    p = slot.cast("bigint") * shards + shard
    there = (shard >= 0) & (shard < shards) & (slot >= 0) & (p < shuffle.total)
    return F.when(there, shuffle.inverse(p))


def number_rows(df: DataFrame, order: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """`df` with its rows numbered from 0 in the given order (nulls first), and their count.

    Ranges of the order are sorted apart; a range starts at the sum of the counts
    before it, a table with one row per range, which is why it may be broadcast.
    """
    part, index, tie = (f"_{number}_{name}" for name in ("part", "index", "tie"))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col(tie)]
    ranges = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(ranges.drop(tie).withColumn(part, F.spark_partition_id()).withColumn(
        index, F.monotonically_increasing_id().bitwiseAND(_INDEX_BITS)), "numbered")
    counts = placed.groupBy(part).agg(F.count("*").alias("_rows"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    rows = placed.join(F.broadcast(firsts), part)
    return rows.withColumn(number, F.col("_first") + F.col(index)).drop(part, index, "_first"), placed.count()


def place_rows(df: DataFrame, order: list[str], shards: int = SHARDS, key: str = "shards") -> DataFrame:
    """`df` with row_number, shard and slot of every row. `order` should tell apart all rows that differ."""
    rows, total = number_rows(df, order)
    p = Permutation(total, key).forward(F.col("row_number"))
    return rows.withColumn("_place", p).withColumns({
        "shard": shard_of(F.col("_place"), shards), "slot": slot_of(F.col("_place"), shards)}).drop("_place")


def write_shards(df: DataFrame, path: str, order: list[str], shards: int = SHARDS, key: str = "shards") -> None:
    """The rows as one folder per shard, each a series of files in the order of slots; no task takes a shard."""
    placed = stage(place_rows(df, order, shards, key), "placed")
    spread = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard").parquet(path)


def document_places(docs: DataFrame, shards: int = SHARDS, key: str = "shards") -> DataFrame:
    """doc_id, size (UTF-8 bytes and `ROW_BYTES`), text_crc32, row_number, shard and slot of every document.

    Documents are numbered by (doc_id, size, checksum). The text is read once.
    """
    content = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    narrow = stage(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32")), "sizes")
    return place_rows(narrow, ["doc_id", "size", "text_crc32"], shards, key)
