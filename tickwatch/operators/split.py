"""Exact stratified hold-out split that never ranks a whole stratum in one task.

Each row has a fixed place in [0, 2^128): the MD5 of its key and the seed. A
stratum's test part is its rows with the smallest hashes. The cut-offs of all strata
are found together, by one search for ranks by counts, so the split itself is a
comparison against one constant per stratum: no window, no shuffle of the data. A row's
side depends only on its key and the kept cut-offs, so rows added later do not
move training rows into the test part.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.operators.quantiles import shares
from tickwatch.session import staged

# So many hexadecimal digits of a hash are a whole number that a double holds exactly.
_DIGITS = 13
# A column with more values than this is no class to split by.
MAX_LABELS = 1_000


@dataclass(frozen=True)
class SplitRule:
    label: str
    key: tuple[str, ...]
    seed: int
    cuts: dict[int, str]

    def test_column(self, df: DataFrame) -> Column:
        """True for rows of the test part; df tells the types of the key columns."""
        test = F.lit(False)
        for value, cut in self.cuts.items():
            test = F.when(F.col(self.label) == value, row_hash(self.key, self.seed, df) <= cut).otherwise(test)
        return test


def _text(df: DataFrame | None, name: str) -> Column:
    """A key column as text: times as epoch microseconds whatever the session's zone, null apart from any text."""
    c = F.col(name)
    c = F.unix_micros(c) if df is not None and dict(df.dtypes)[name] == "timestamp" else c
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))


def row_hash(key: tuple[str, ...], seed: int, df: DataFrame | None = None) -> Column:
    return F.md5(F.concat_ws("\0", *[_text(df, c) for c in key], F.lit(str(seed))))


def stratified_rule(
    df: DataFrame, label: str, key: tuple[str, ...], test_share: float = 0.2, seed: int = 42
) -> SplitRule:
    """Cut-offs that put round(test_share * n) rows of each label value in the test part."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values")
    sizes = {row[label]: row["n"] for row in counts}
    if None in sizes:
        raise ValueError(f"{sizes[None]} rows have no {label}; label or drop them first")
    small = [value for value, n in sizes.items() if n < 2]
    if small:
        raise ValueError(f"each label value needs two rows or more; too few for {small}")
    place = F.conv(F.substring(row_hash(key, seed, df), 1, _DIGITS), 16, 10).cast("double")
    # The places are searched several times and are two columns, whatever the table has.
    with staged(df.select(F.col(label).alias("_label"), place.alias("_place")), "places") as places:
        found = shares(places, "_place", test_share, ["_label"]).collect()
    cuts = {row["_label"]: f"{int(row['value']):0{_DIGITS}x}".ljust(32, "f") for row in found}
    return SplitRule(label, tuple(key), seed, cuts)


def train_test(df: DataFrame, rule: SplitRule) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_test", rule.test_column(df))
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")
