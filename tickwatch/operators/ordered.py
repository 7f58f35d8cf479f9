"""Whole-table ordered computations that survive a hot key.

`Window.partitionBy(symbol)` puts a symbol in one task. With a third of all
ticks in one symbol that task never ends, and adaptive execution does not split
window partitions. Here the table is cut into ranges of (by, order) of about
equal size; the window runs inside each range, and what a range needs from the
ranges before it (a last value, a running total) comes from a summary with one
row per range. Only the first key of a range can have earlier rows, so that
summary never has more rows than there are ranges and is safe to broadcast.

`order` must be unique within `by`: that is what makes the answer well defined.

There is one plan for every size: a small table has fewer and smaller ranges, at
least one per core where it has the rows.
"""

import decimal
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwatch.functions.columns import arrival_key
from tickwatch.session import ship_package, stage

RANGE = "_range"
ROWS_PER_RANGE = 2_000_000
# A session can set another size, to suit its executors' memory.
ROWS_PER_RANGE_CONF = "spark.tickwatch.rowsPerRange"
# More ranges than this would only make the driver's list of split points long;
# beyond it the ranges grow instead (a window spills, it does not fail).
MAX_RANGES = 16_384
SAMPLES_PER_RANGE = 16
_HASH_SPACE = 1 << 31


def _sortable(df: DataFrame, name: str) -> tuple[Column, str]:
    """A key as a null-free value of a plain type that sorts the way Spark sorts it."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit("")), "string"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(-(2**62))), "bigint"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(c.cast("double"), F.lit(float("-inf"))), "double"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return F.coalesce(c.cast("bigint"), F.lit(-(2**62))), "bigint"
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return F.coalesce(c.cast("decimal(38,0)"), F.lit(f"-{'9' * 38}").cast("decimal(38,0)")), "decimal(38,0)"
    raise TypeError(f"cannot cut ranges on {name}: {kind.simpleString()}")


def _plain(value):
    return int(value) if isinstance(value, decimal.Decimal) else value


def range_rows(df: DataFrame, rows_per_range: int | None = None) -> int:
    return rows_per_range or int(df.sparkSession.conf.get(ROWS_PER_RANGE_CONF, str(ROWS_PER_RANGE)))


def split_points(df: DataFrame, keys: list[str], rows_per_range: int | None = None) -> list[tuple]:
    """Split points of `keys`, from a hash sample of bounded size.

    Costs one narrow pass that counts the rows and keeps the few with the smallest
    hashes, and a second one where a range per core is not enough; brings at most about
    MAX_RANGES * SAMPLES_PER_RANGE short rows to the driver, which is what a
    range partitioner does as well. The points become constants of the plan, so every
    evaluation has the same ranges.
    """
    plain = [_sortable(df, key)[0].alias(f"k{i}") for i, key in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    # With the row's place in the input, so that equal keys are drawn by their number.
    place = F.pmod(F.xxhash64(*names, "_at"), F.lit(_HASH_SPACE))
    placed = df.select(*plain, F.monotonically_increasing_id().alias("_at"))
    wanted = min(MAX_RANGES, df.sparkSession.sparkContext.defaultParallelism)
    seen = Observation()
    few = placed.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(place, *names).limit(wanted * SAMPLES_PER_RANGE)
    drawn = {tuple(row) for row in few.select(*names).collect()}
    total = seen.get["n"]
    if math.ceil(total / range_rows(df, rows_per_range)) > wanted:
        wanted = min(MAX_RANGES, math.ceil(total / range_rows(df, rows_per_range)))
        share = min(1.0, wanted * SAMPLES_PER_RANGE / total)
        drawn = {tuple(row) for row in placed.where(place < int(share * _HASH_SPACE)).select(*names).collect()}
    ordered = sorted(drawn)
    # The first of `wanted` even stretches needs no point of its own.
    return [ordered[i * len(ordered) // wanted] for i in range(1, min(wanted, len(ordered)))] if total > 1 else []


def with_range(df: DataFrame, keys: list[str], points: list[tuple]) -> DataFrame:
    """Add RANGE: how many split points are at or below the row's key.

    The binary search is a stack of projections, one per step, so it runs in
    generated code without a join, a shuffle or a Python worker.
    """
    df = df.withColumn(RANGE, F.lit(0))
    if not points:
        return df
    parts = [_sortable(df, key) for key in keys]
    values = [part[0] for part in parts]
    bounds = [
        F.from_json(F.lit(json.dumps([_plain(point[i]) for point in points])), f"array<{kind}>")
        for i, (_, kind) in enumerate(parts)
    ]

    def at_or_below(index: Column) -> Column:
        test = F.get(bounds[-1], index) <= values[-1]
        for bound, value in zip(bounds[-2::-1], values[-2::-1]):
            here = F.get(bound, index)
            test = (here < value) | ((here == value) & test)
        return test

    step = 1 << (len(points).bit_length() - 1)
    while step:
        here = F.col(RANGE)
        df = df.withColumn(RANGE, F.when(at_or_below(here + (step - 1)), here + step).otherwise(here))
        step >>= 1
    # Join planning follows a key back through projections by substitution, which
    # for this stack would grow threefold per step. It stops at a generator.
    return df.select(*[c for c in df.columns if c != RANGE], F.explode(F.array(RANGE)).alias(RANGE))


def _order_key(df: DataFrame, order: list[str]) -> Column:
    kinds = [df.schema[name].dataType for name in order]
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and isinstance(kinds[0], T.TimestampType) and isinstance(kinds[1], T.LongType):
        return arrival_key(*order)
    return F.struct(*order)


def scan_in_order(
    df: DataFrame,
    by: list[str],
    order: list[str],
    lag: dict[str, str] | None = None,
    total: dict[str, str] | None = None,
    position: str | None = None,
    affine: dict[str, tuple[str, str]] | None = None,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Lags, running totals, positions and recurrences over `order` within `by`.

    lag:      {new column: column whose previous value it holds}
    total:    {new column: column summed from the first row up to this one}
    position: name of the 0-based row number
    affine:   {new column: (a, b)}, the recurrence x = a * x_before + b from x_before = 0;
              a row with a null in a or b leaves x as it was
    """
    lag, total, affine = lag or {}, total or {}, affine or {}
    df = df.select(*[F.col(c) for c in df.columns])
    keys = by + order
    points = split_points(df.select(*keys), keys, rows_per_range)
    ranged = with_range(df, keys, points)
    inner = Window.partitionBy(*by, RANGE).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    made = {new: F.lag(old).over(inner) for new, old in lag.items()}
    made.update({new: F.sum(old).over(upto) for new, old in total.items()})
    number = F.row_number().over(inner).cast("bigint") - 1
    if position:
        made[position] = number
    if lag or affine:
        made["_number"] = number
    done = ranged.withColumns(made)
    for new, (a, b) in affine.items():
        done = _compose(done, new, a, b)
    if affine:
        # Both the rows and the summary of the ranges are read from it.
        done = stage(done, "composed")
    # One partial aggregation gives each range's contribution ...
    summary = (done if affine else ranged).groupBy(*by, RANGE).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(old, _order_key(df, order)).alias(f"_l_{new}") for new, old in lag.items()],
        *[F.sum(old).alias(f"_t_{new}") for new, old in total.items()],
        *[F.max_by(f"{half}{new}", "_number").alias(f"{half}{new}") for new in affine for half in ("_a_", "_b_")],
    )
    # ... and a window over those few rows turns it into what precedes a range.
    ranges = Window.partitionBy(*by).orderBy(RANGE)
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *by, RANGE,
        F.sum("_n").over(before).alias("_c_n"),
        *[F.lag(f"_l_{new}").over(ranges).alias(f"_c_{new}") for new in lag],
        *[F.sum(f"_t_{new}").over(before).alias(f"_c_{new}") for new in total],
        *[_fold(F.collect_list(F.struct(F.col(f"_a_{new}").alias("a"), F.col(f"_b_{new}").alias("b"))).over(before))
          .alias(f"_c_{new}") for new in affine],
    ).where(F.col("_c_n").isNotNull())
    carry = carry.select(*[F.col(c).alias(f"_by_{c}") for c in by],
                         F.col(RANGE).alias("_carry_range"),
                         *[c for c in carry.columns if c not in (*by, RANGE)])
    match = F.col(RANGE) == F.col("_carry_range")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = done.join(F.broadcast(carry), match, "left")
    final = {new: F.when(F.col("_number") == 0, F.col(f"_c_{new}")).otherwise(F.col(new)) for new in lag}
    final.update({
        new: F.when(F.col(f"_c_{new}").isNull(), F.col(new))
        .otherwise(F.coalesce(F.col(new), F.lit(0)) + F.col(f"_c_{new}"))
        for new in total
    })
    final.update({
        new: F.col(f"_a_{new}") * F.coalesce(F.col(f"_c_{new}"), F.lit(0.0)) + F.col(f"_b_{new}") for new in affine})
    if position:
        final[position] = F.col(position) + F.coalesce(F.col("_c_n"), F.lit(0))
    keep = df.columns + [*lag, *total] + ([position] if position else []) + [*affine]
    return joined.withColumns(final).select(*keep)


def _fold(maps: Column) -> Column:
    """The value of the maps x -> a * x + b, applied one after another from 0."""
    return F.aggregate(maps, F.lit(0.0), lambda x, m: m["a"] * x + m["b"])


def _compose(rows: DataFrame, new: str, a: str, b: str) -> DataFrame:
    """Add _a_new and _b_new: the maps x -> a * x + b of a range composed up to each row.

    The rows come straight from the window over ranges, in its order; a running
    product of maps has no built-in window function, and a quotient of running
    products would leave the range of doubles after some thousand rows.
    """
    ship_package(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(f"_a_{new}", T.DoubleType()),
                           T.StructField(f"_b_{new}", T.DoubleType())])
    names = rows.columns
    at, one, two = names.index("_number"), names.index(a), names.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, shift, last = 1.0, 0.0, -1
        for batch in batches:
            slopes, shifts = [], []
            for number, x, y in zip(*(batch.column(i).to_pylist() for i in (at, one, two))):
                if number == 0:
                    slope, shift = 1.0, 0.0
                elif number != last + 1:
                    raise ValueError("rows of a range are out of order")
                last = number
                if x is not None and y is not None:
                    slope, shift = x * slope, x * shift + y
                slopes.append(slope)
                shifts.append(shift)
            more = [pa.array(slopes, pa.float64()), pa.array(shifts, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return rows.mapInArrow(run, schema)


def trailing_mean(
    df: DataFrame,
    value: str,
    position: str,
    out: str,
    width: int,
    by: list[str] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Mean of the last `width` values up to each row, along a dense 0-based position.

    Rows go to equal blocks of positions; the last width-1 rows of a block are
    also sent to the next one, so every frame is whole inside one block.
    """
    block_rows = max(width, range_rows(df, block_rows))
    by = by or []
    block = F.floor(F.col(position) / block_rows)
    reach = F.pmod(F.col(position), F.lit(block_rows)) >= block_rows - (width - 1)
    spread = df.withColumn("_own", block).withColumn(
        "_block", F.explode(F.when(reach, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    frame = Window.partitionBy(*by, "_block").orderBy(position).rowsBetween(-(width - 1), 0)
    return (
        spread.withColumn(out, F.avg(value).over(frame))
        .where(F.col("_block") == F.col("_own"))
        .drop("_own", "_block")
    )
