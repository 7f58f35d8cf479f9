"""Per-symbol log returns of ticks (batch)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.functions.columns import log_return
from tickwatch.operators.ordered import scan_in_order


def with_log_return(
    ticks: DataFrame,
    order: tuple[str, ...] = ("event_time", "event_id"),
    price: str = "price",
    out: str = "log_return",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add ln(price / previous price of the symbol)."""
    lagged = scan_in_order(ticks, ["symbol"], list(order), lag={"_previous": price},
                           rows_per_range=rows_per_range)
    return lagged.withColumn(out, log_return(F.col(price), F.col("_previous"))).drop("_previous")
