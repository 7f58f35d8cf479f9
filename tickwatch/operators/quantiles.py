"""Exact quantiles with linear interpolation: a search by counts, not a sort.

The values are cut into ranges at points from a sample, rows are counted per range,
and the counts tell which ranges hold the wanted ranks. Only those ranges, a few
thousandths of the table, are looked at value by value; where one of them still
has more values than `rows_per_range`, it is cut again. Values are neither written nor
shuffled but for the last step's merged ones, and the steps are the same at any size.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwatch.operators.ordered import RANGE, range_rows, split_points, with_range

# As many (group, quantile) pairs are kept on the driver and broadcast; more are joined by shuffling.
MAX_WANTED = 100_000
# A range of more than so many times the usual size is cut again, so often at most.
CUT_ABOVE, MAX_CUTS = 4, 8


def quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    by: list[str] | None = None,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Rows (by..., prob, quantile); nulls and NaN are left out.

    Reads `df` once per step (three in general), so one that is expensive to
    compute should be a stored table.
    """
    return _search(df, value, probs, by or [], rows_per_range, F.col("prob") * (F.col("_total") - 1))


def values_at(
    df: DataFrame, value: str, ranks: list[int], by: list[str] | None = None, rows_per_range: int | None = None
) -> DataFrame:
    """Rows (by..., rank, value): the values at 0-based ranks of every group that has so many."""
    found = _search(df, value, ranks, by or [], rows_per_range, F.col("prob"))
    return found.withColumnsRenamed({"prob": "rank", "quantile": "value"})


def shares(df: DataFrame, value: str, share: float, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., value): the greatest of the round(share * n) smallest values of each group, where that is one or more."""
    rank = F.floor(F.col("_total") * F.col("prob") + 0.5) - 1
    return _search(df, value, [share], by or [], None, rank).select(*(by or []), F.col("quantile").alias("value"))


def _search(
    df: DataFrame, value: str, probs: list[float], by: list[str], rows_per_range: int | None, rank: Column
) -> DataFrame:
    v = F.col(value).cast("double")
    # Adding zero makes -0.0 and 0.0 one value.
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*by, (v + F.lit(0.0)).alias("_v"))
    rows = with_range(rows, by + ["_v"], split_points(rows, by + ["_v"], rows_per_range))
    groups, wanted, small = list(by), _places(rows, probs, by, rank), False
    for cut in range(MAX_CUTS):
        found = wanted.limit(MAX_WANTED + 1).collect()
        small = len(found) <= MAX_WANTED
        if small:
            wanted = F.broadcast(df.sparkSession.createDataFrame(found, wanted.schema))
        large = CUT_ABOVE * range_rows(df, rows_per_range)
        if not small or not any(r["_n"] > large and r["_least"] < r["_most"] for r in found):
            break
        # The rows of the wanted ranges, with the number of their range as one more group.
        outer = f"_range_{cut}"
        rows = rows.join(wanted, _match(groups), "left_semi").withColumnRenamed(RANGE, outer)
        wanted = wanted.withColumnRenamed("_wanted", f"_by_{outer}")
        groups.append(outer)
        rows = with_range(rows, groups + ["_v"], split_points(rows, groups + ["_v"], rows_per_range))
        wanted = _narrowed(rows, wanted, groups)
    return _read_off(rows, F.broadcast(wanted) if small else wanted, by, groups)


def _counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and range: rows, rows before it in the group, least and greatest value."""
    ranges = Window.partitionBy(*by).orderBy(RANGE)
    counts = rows.groupBy(*by, RANGE).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_before", F.coalesce(before, F.lit(0)))


def _inside(rank: str) -> Column:
    return (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_n"))


def _places(rows: DataFrame, probs: list[float], by: list[str], rank: Column) -> DataFrame:
    """The ranges that hold the two ranks around each quantile."""
    counts = _counts(rows, by).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    return (
        counts.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_lo", F.floor(rank)).withColumn("_hi", F.ceil(rank)).withColumn("_frac", rank - F.col("_lo"))
        .where(_inside("_lo") | _inside("_hi"))
        .select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(RANGE).alias("_wanted"), "_n", "_before", "_least",
                "_most", "prob", "_lo", "_hi", "_frac")
    )


def _same(groups: list[str]) -> Column:
    match = F.lit(True)
    for c in groups:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return match


def _match(groups: list[str]) -> Column:
    return (F.col(RANGE) == F.col("_wanted")) & _same(groups)


def _narrowed(rows: DataFrame, wanted: DataFrame, groups: list[str]) -> DataFrame:
    """The same ranks in the ranges that the wanted ranges were cut into."""
    parts = _counts(rows, groups).withColumnsRenamed(
        {RANGE: "_wanted", "_n": "_part", "_before": "_ahead", "_least": "_low", "_most": "_high"})
    cut = parts.join(wanted.drop("_least", "_most"), _same(groups)).withColumns({
        "_before": F.col("_before") + F.col("_ahead"), "_n": F.col("_part")})
    return cut.where(_inside("_lo") | _inside("_hi")).select(
        *[f"_by_{c}" for c in groups], "_wanted", "_n", "_before", F.col("_low").alias("_least"),
        F.col("_high").alias("_most"), "prob", "_lo", "_hi", "_frac")


def _read_off(rows: DataFrame, wanted: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    """The values at the wanted ranks: equal values of the ranges are merged, then counted in order."""
    needed = wanted.select(*[f"_by_{c}" for c in groups], "_wanted", "_before").distinct()
    held = rows.join(needed, _match(groups)).groupBy(*groups, RANGE, "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*groups, RANGE).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumn("_end", F.col("_before") + F.sum("_c").over(run)).drop("_before")
    ranked = placed.join(wanted.drop("_n", "_before", "_least", "_most"), _match(groups))

    def at(r: str):
        return F.max(F.when((F.col(r) >= F.col("_end") - F.col("_c")) & (F.col(r) < F.col("_end")), F.col("_v")))

    ends = ranked.groupBy(*by, "prob").agg(
        at("_lo").alias("_low"), at("_hi").alias("_high"), F.max("_frac").alias("_frac"))
    # Without the case, equal infinities would give no number.
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac")
    return ends.select(*by, "prob", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("quantile"))


def quantiles_bounded(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """The same rows through the built-in percentile, for inputs of bounded size."""
    return _unnest(df, F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])), probs, by or [])


def quantiles_approx(
    df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, accuracy: int = 10_000
) -> DataFrame:
    """The same rows from a mergeable sketch: one pass, rank error below 1/accuracy."""
    return _unnest(df, F.percentile_approx(value, [float(p) for p in probs], accuracy), probs, by or [])


def _unnest(df: DataFrame, sketch, probs: list[float], by: list[str]) -> DataFrame:
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("_q").alias("quantile"))
    return (
        df.groupBy(*by).agg(sketch.alias("_q")).where(F.col("_q").isNotNull())
        .select(*by, F.explode(pairs).alias("_p"))
        .select(*by, F.col("_p.prob").alias("prob"), F.col("_p.quantile").alias("quantile"))
    )
